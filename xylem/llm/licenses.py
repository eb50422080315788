"""Operator 7: licence notices in documents, by a positional index of rare words.

Templates are the words of licence notices; the index holds, for each of their words, the (template, position) postings. The
inverse document frequency of licence words is counted over all documents. For each document its licence words of the highest IDF
are looked up (those that are among a template's ``ANCHORS`` rarest); each occurrence and posting give a relative position,
occurrence minus posting; where the template's other words lie at the same relative position (give or take ``SLACK`` words) is added
up. A template is found where at least ``COVERAGE`` of its words are in place and each of its mandatory phrases stands there word for word.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_word_array, pick, word_hashes

ANCHORS, COVERAGE, SLACK = 3, 0.75, 3

#: (licence, notice, mandatory phrases)
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License", "2.0")),
    ("MIT", "Released under the MIT License", ("MIT License",)),
    ("MIT", "Licensed under the MIT License", ("MIT License",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "this software and associated documentation files")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("GNU General Public License", "version 2")),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License, version 2.1", ("GNU Lesser General Public License", "2.1")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License, version 3", ("GNU Affero General Public License", "version 3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License", "2.0")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms", "with or without modification")),
    ("ISC", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee", "hereby granted")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal", ("CC0 1.0",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    # notices as published
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', ("Apache License", "2.0")),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", ("GNU General Public License", "version 2")),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("GNU General Public License", "version 2")),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", ("GNU General Public License", "version 2")),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU General Public License", "version 3")),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", ("GNU General Public License", "version 3")),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License", ("GNU General Public License", "version 3")),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", ("GNU Lesser General Public License", "version 2.1")),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation", ("GNU Lesser General Public License", "version 2.1")),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License", ("GNU Lesser General Public License", "version 2.1")),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU Lesser General Public License", "version 3")),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation", ("GNU Lesser General Public License", "version 3")),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 3 of the License", ("GNU Lesser General Public License", "version 3")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU Affero General Public License", "version 3")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation", ("GNU Affero General Public License", "version 3")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation; version 3 of the License", ("GNU Affero General Public License", "version 3")),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("all copyright and related and neighboring rights", "public domain worldwide")),
    # headings of the full texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004", ("Apache License Version 2.0",)),
    ("MIT", "MIT License Copyright (c)", ("MIT License Copyright",)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", ("GNU General Public License", "Version 2")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("GNU General Public License", "Version 3")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ("GNU Lesser General Public License", "Version 2.1")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("GNU Lesser General Public License", "Version 3")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("GNU Affero General Public License", "Version 3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0", ("Mozilla Public License Version 2.0",)),
    ("BSD", "BSD 2-Clause License", ("BSD 2-Clause License",)),
    ("BSD", "BSD 3-Clause License", ("BSD 3-Clause License",)),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International", ("Attribution 4.0 International",)),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", ("Attribution-ShareAlike 4.0 International",)),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ("Attribution-NonCommercial 4.0 International",)),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", ("Attribution-NoDerivatives 4.0 International",)),
    ("CC0-1.0", "CC0 1.0 Universal", ("CC0 1.0 Universal",)),
    # full texts, as far as they are short
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
        ("hereby granted free of charge", "to deal in the Software without restriction", "substantial portions of the Software"),
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
        ("for any purpose with or without fee", "this permission notice appear in all copies"),
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("source and binary forms", "this list of conditions and the following disclaimer"),
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("without any express or implied warranty", "alter it and redistribute it freely"),
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software",
        ("any person or organization obtaining a copy", "covered by this license"),
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "commercial or noncommercial and by any means"),
    ),
)


class Index:
    """Templates as word numbers, the vocabulary, and each word's postings."""

    def __init__(self, templates=TEMPLATES):
        self.names = [t[0] for t in templates]
        words = [word_hashes(t[1]) for t in templates]
        phrases = [[word_hashes(p) for p in t[2]] for t in templates]
        self.vocabulary = np.unique(np.concatenate([*words, *(p for ps in phrases for p in ps)]))
        number = lambda w: np.searchsorted(self.vocabulary, w)
        self.templates = [number(w) for w in words]
        self.phrases = [[number(p).tolist() for p in ps] for ps in phrases]
        self.postings = defaultdict(list)
        for t, w in enumerate(self.templates):
            for q, word in enumerate(w.tolist()):
                self.postings[word].append((t, q))

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a document the licence words are, and their numbers."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == words)
        return hit, at[hit]

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """IDF from document counts; a template's anchors are its rarest distinct words."""
        self.idf = np.log((1 + n_docs) / (1 + df))
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.templates):
            rare = sorted(set(w.tolist()), key=lambda x: (-self.idf[x], x))[:ANCHORS]
            for word in rare:
                self.anchors[word] += [p for p in self.postings[word] if p[0] == t]
        self.is_anchor = np.zeros(len(self.vocabulary), bool)
        self.is_anchor[list(self.anchors)] = True


def search(index: Index, at: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(template, first word, words, coverage) of every notice in a document, given where its licence words are; of overlapping places the best, then the first."""
    found = []
    hot = np.flatnonzero(index.is_anchor[number])
    offsets: dict[int, set[int]] = defaultdict(set)
    for i in hot:
        for t, q in index.anchors[int(number[i])]:
            offsets[t].add(int(at[i]) - q)
    if not offsets:
        return found
    places = dict(zip(at.tolist(), number.tolist()))
    for t, starts in offsets.items():
        words = index.templates[t].tolist()
        best: list[tuple[float, int]] = []
        for start in sorted(starts):
            # the template's words in their order, each at most SLACK words off its relative position
            last, hits = start - SLACK - 1, 0
            for q, word in enumerate(words):
                for p in sorted(range(max(last + 1, start + q - SLACK), start + q + SLACK + 1), key=lambda p: (abs(p - start - q), p)):
                    if places.get(p) == word:
                        last, hits = p, hits + 1
                        break
            if hits >= COVERAGE * len(words) - 1e-9:
                lo, hi = start - SLACK, start + len(words) + SLACK
                if all(any(all(places.get(p + k) == w for k, w in enumerate(phrase)) for p in range(lo, hi)) for phrase in index.phrases[t]):
                    best.append((hits / len(words), start))
        taken: list[int] = []
        for share, start in sorted(best, key=lambda x: (-x[0], x[1])):
            if all(abs(start - s) >= len(words) for s in taken):
                taken.append(start)
                found.append((t, max(start, 0), len(words), share))
    # of overlapping notices of one licence the best stays, then the longest, then the first template
    kept: list[tuple[int, int, int, float]] = []
    for x in sorted(found, key=lambda x: (-x[3], -x[2], x[0], x[1])):
        if all(index.names[x[0]] != index.names[y[0]] or x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[0]))


def _count(index: Index):
    """(word number, documents) over the task's texts, under -1 the number of documents."""

    def of(batches):
        df, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for words in each_word_array(batch.column(0)):
                n += 1
                df[np.unique(index.places(words)[1])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], names=["word", "n"])

    return of


_OUT = "doc_id long, license string, template int, first_word int, n_words int, coverage double"


def _scan(index: Index):
    def of(batches):
        for batch in batches:
            out = []
            for doc_id, words in zip(batch.column(0).to_pylist(), each_word_array(batch.column(1))):
                at, number = index.places(words)
                if len(at):
                    out += [(doc_id, index.names[t], t, start, n, share) for t, start, n, share in search(index, at, number)]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "license", "template", "first_word", "n_words", "coverage"])

    return of


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, template, first_word, n_words, coverage): every notice in every document.

    Two passes over the texts: document counts of the licence words, whose number is that of the templates' words and which
    alone come to the driver; then the search. Nothing is shuffled but those counts. Null and empty texts have no notices; null and repeated
    doc_ids pass through, each row for itself; further columns are ignored; an empty table gives an empty result.
    """
    index = Index(templates)
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    counted = {r["word"]: r["n"] for r in base.select("text").mapInArrow(_count(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index.weigh(np.array([counted.get(k, 0) for k in range(len(index.vocabulary))]), counted.get(-1, 0))
    return base.mapInArrow(_scan(index), _OUT)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
