import re

from xylem.llm import licenses as l

from .conftest import NO_DOCS, hostile, word


def brute(text):
    """Licences whose notice stands in the text word for word."""
    clean = lambda t: " ".join(w for w in (re.sub(r"[\W_]+", "", p.lower()) for p in t.split()) if w)
    return {name for name, notice, _ in l.TEMPLATES if f" {clean(notice)} " in f" {clean(text)} "}


def test_notices_are_found_where_they_are(spark, rng):
    docs = []
    for i in range(120):
        words = [word(rng) for _ in range(rng.randint(10, 120))]
        if i % 2:
            at = rng.randrange(len(words))
            notice = l.TEMPLATES[i // 2 % len(l.TEMPLATES)][1]
            words[at:at] = (notice.upper() if i % 3 else notice).split()
        docs.append((i, " ".join(words)))
    got = {}
    for r in l.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.coverage == 1.0
        w = [x for x in (re.sub(r"[\W_]+", "", p.lower()) for p in docs[r.doc_id][1].split()) if x]
        assert " ".join(w[r.first_word : r.first_word + r.n_words]) == " ".join(x for x in (re.sub(r"[\W_]+", "", p.lower()) for p in l.TEMPLATES[r.template][1].split()) if x)
    assert got == {i: brute(t) for i, t in docs if brute(t)} and len(got) == 60


def brute_edited(words, index):
    """(licence, template) of every notice, by trying each template at every place of the text, without anchors."""
    found = set()
    for t, template in enumerate(index.templates):
        own = [index.vocabulary[x] for x in template]
        for start in range(-l.SLACK, len(words)):
            last, hits = start - l.SLACK - 1, 0
            for q, w in enumerate(own):
                near = [p for p in range(max(last + 1, start + q - l.SLACK, 0), min(len(words), start + q + l.SLACK + 1)) if words[p] == w]
                if near:
                    last, hits = min(near, key=lambda p: (abs(p - start - q), p)), hits + 1
            if hits < l.COVERAGE * len(own) - 1e-9:
                continue
            around = words[max(0, start - l.SLACK) : start + len(own) + l.SLACK + max(map(len, index.phrases[t]))].tolist()
            phrases = [[int(index.vocabulary[x]) for x in p] for p in index.phrases[t]]
            if all(any(around[k : k + len(p)] == p for k in range(len(around))) for p in phrases):
                found.add((index.names[t], t))
    return found


def test_edited_notices_against_brute_force(spark, rng):
    """Words of notices, full texts among them, replaced, left out and put in. Found are those that keep one of their rarest words in place."""
    index, docs = l.Index(), []
    for i, (_, notice, _) in enumerate(l.TEMPLATES * 2):
        words = notice.split()
        for _ in range(rng.randint(0, max(1, len(words) // 10))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[word(rng)], [], [words[at], word(rng)]])
        docs.append((i, " ".join([word(rng) for _ in range(9)] + words + [word(rng) for _ in range(9)])))
    got = {}
    for r in l.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    missed = 0
    for i, text in docs:
        want = {name for name, _ in brute_edited(l.word_hashes(text), index)}
        assert got.get(i, set()) <= want, text
        missed += len(want - got.get(i, set()))
    assert len(got) > 60 and missed <= 2, missed


def test_edited_notices_and_missing_phrases(spark):
    docs = [
        (1, "x Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files y"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files"),
        (3, "the licensed MIT work was released under a license of this software and files"),
        (4, "Licensed under the Apache License, Version 1.1"),
        (5, "Released under the MIT License. Some words. Released under the MIT License."),
    ]
    got = [(r.doc_id, r.license, round(r.coverage, 2)) for r in l.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "MIT", 0.95), (5, "MIT", 1.0), (5, "MIT", 1.0)]


def test_notices_as_published(spark):
    later = "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the"
    docs = [
        (1, f"{free} GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or {later}", "GPL-3.0"),
        (2, f"{free} GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or {later}", "GPL-2.0"),
        (3, f"{free} GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or {later}", "LGPL-2.1"),
        (4, f"{free} GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or {later}", "AGPL-3.0"),
        (5, "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.", "GPL-2.0"),
        (6, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.", "LGPL-3.0"),
        (7, f"{free} GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0"),
        (8, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
        (9, "BSD 3-Clause License\n\nCopyright (c) 2020, the authors", "BSD"),
        (10, "Creative Commons Attribution-ShareAlike 4.0 International Public License", "CC-BY-SA-4.0"),
    ]
    got = l.license_scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, name) for i, _, name in docs]


def test_hostile_tables(spark):
    docs = hostile(spark, [(9, "Licensed under CC BY 4.0", None, None, None, None, None), (None, "Licensed under CC BY 4.0", None, None, None, None, None)])
    assert sorted((r.doc_id or 0, r.license) for r in l.license_scan(docs).collect()) == [(0, "CC-BY-4.0"), (9, "CC-BY-4.0")]
    assert l.license_scan(spark.createDataFrame([], NO_DOCS)).collect() == []
