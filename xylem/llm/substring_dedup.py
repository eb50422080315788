"""Operator 1: substring dedup over sliding runs of sentences.

A text is cut into sentences; every run of ``span`` consecutive sentences is hashed; the hashes are
joined over all documents; each run but the first of its kind (by doc_id, then position) is repeated
text, and the sentences that such a run covers are removed.

A sentence ends after a white-space separated piece that ends with one of ``. ! ? ; : ,`` and at a line end (so
that a long sentence gives several, and a passage has enough of them); a stretch without words goes with what follows,
at the end of the text with what precedes.  A sentence of more than ``LONG`` words (text without signs) is cut after each word whose
hash ``CUT`` divides: where the cuts lie depends on the words alone, so copies are cut alike.  What is hashed are the words (see ``common``): case, punctuation and spacing don't matter.
Every run of ``span`` sentences is extended over the following ones until it has ``min_words`` words, and likewise
backwards; runs that reach a text's edge before that are not hashed.

Of the runs that a task sees with one hash only the first goes to the global join; the others are known to be repeated. So a run that a third of all
documents share has one row for each ``COMBINED`` runs there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _NOT_WORD, each_word_array, mix, pick, positional, run_hashes

SPAN = 3
MIN_WORDS = 20
LONG, CUT = 12, 8
#: Runs that a task looks through at once for repeated ones.
COMBINED = 500_000

_FIND = re.compile(r"\S+").finditer


def _starts(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The index of each sentence's first word, and the number of words."""
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(ends) + 1])
    long = np.diff(starts) > LONG
    if long.any():
        cuts = np.repeat(long, np.diff(starts)) & (words % np.uint64(CUT) == 0)
        starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(ends | cuts) + 1])
    return starts


def runs(starts: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every run, distinct: the shortest from each sentence on, and up to each sentence."""
    n = len(starts) - 1
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.arange(n)
    last = np.maximum(np.searchsorted(starts, starts[:-1] + min_words, "left") - 1, i + span - 1)
    first = np.minimum(np.searchsorted(starts, starts[1:] - min_words, "right") - 1, i - span + 1)
    code = np.unique(np.concatenate([(i * n + last)[last < n], (first * n + i)[first >= 0]]))
    return code // n, code % n


def _hash_runs(span: int, min_words: int):
    def of(batches):
        out, size = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).tolist()
            null, keys = np.asarray(batch.column(0).is_null()).tolist(), batch.column(1).to_numpy(zero_copy_only=False).tolist()
            for k, (words, ends) in enumerate(each_word_array(batch.column(2), ends=True)):
                starts = _starts(words, ends)
                a, b = runs(starts, span, min_words)
                if len(a):
                    out.append((ids[k], null[k], keys[k], a, b, run_hashes(words, starts[a], starts[b + 1])))
                    size += len(a)
                if size > COMBINED:
                    yield from _combined(out)
                    out, size = [], 0
        if out:
            yield from _combined(out)

    return of


def _combined(found: list[tuple]):
    """Rows for (doc_id, whether it is null, dk, a, b, h) of some documents.

    Of runs with one hash only the first of these documents can be the first of all. The others are ``repeated`` already: they get a key of their own, so that
    a run that very many documents share isn't one group of as many rows.
    """
    doc_id, null, dk, a, b, h = zip(*found)
    length = [len(x) for x in a]
    doc_id, null, dk = (np.repeat(np.array(x, t), length) for x, t in ((doc_id, np.int64), (null, bool), (dk, np.int64)))
    a, b, h = np.concatenate(a).astype(np.int32), np.concatenate(b).astype(np.int32), np.concatenate(h)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    repeated = np.zeros(len(h), bool)
    if same.any():
        some = order[np.append(same, False) | np.insert(same, 0, False)]  # rows whose hash isn't alone
        some = some[np.lexsort((a[some], dk[some], doc_id[some], null[some], h[some]))]
        new = np.insert(h[some][1:] != h[some][:-1], 0, True)
        least = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
        repeated[some] = (null[some] != null[least]) | (doc_id[some] != doc_id[least]) | (dk[some] != dk[least]) | (a[some] != a[least])
        h = np.where(repeated, mix(dk.view(np.uint64) + a.astype(np.uint64)), h)
    for lo in range(0, len(h), 100_000):
        x = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[x].view(np.int64)), pa.array(doc_id[x], mask=null[x]), pa.array(dk[x]), pa.array(a[x]), pa.array(b[x]), pa.array(repeated[x])], names=["h", "doc_id", "dk", "a", "b", "repeated"]
        )


def remove(text: str, starts: np.ndarray, drop: np.ndarray) -> str:
    """The text without the sentences whose numbers are in ``drop``, each from its first word's piece up to the next one's."""
    gone = np.zeros(len(starts) - 1, bool)
    gone[drop] = True
    begins = [m.start() for m in _FIND(text) if _NOT_WORD("", m.group().lower())]
    edges = [0, *(begins[i] for i in starts[1:-1]), len(text)]
    kept = "".join(text[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone))
    return kept.rstrip() if gone[-1] else kept


def _rewrite():
    def of(batches):
        for batch in batches:
            out, drops = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            changed = [k for k, ranges in enumerate(drops) if ranges]
            cut = [0] * len(out)
            for k, (words, ends) in zip(changed, each_word_array(batch.column(0).take(pa.array(changed, pa.int64())), ends=True)):
                drop = np.unique(np.concatenate([np.arange(r["a"], r["b"] + 1) for r in drops[k]]))
                out[k], cut[k] = remove(out[k], _starts(words, ends), drop), len(drop)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()), pa.array(cut, pa.int32()), *batch.columns[2:]], names=["text", "n_removed", *batch.schema.names[2:]]
            )

    return of


def repeated_runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, dk, drop array<struct<a,b>>): the runs of each document that are not the first of their kind.

    dk is a hash of doc_id and text: rows with the same doc_id but other texts are told apart, repeated rows aren't.
    """
    base = pick(docs, "doc_id", "text").where(F.col("text").isNotNull())
    base = base.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("dk"), "text")
    hashed = base.mapInArrow(_hash_runs(span, min_words), "h long, doc_id long, dk long, a int, b int, repeated boolean")
    w = Window.partitionBy("h", "repeated").orderBy(F.col("doc_id").asc_nulls_last(), "dk", "a")
    return (
        hashed.withColumn("r", F.rank().over(w))
        .where("r > 1 or repeated")
        .groupBy("doc_id", "dk")
        .agg(F.collect_list(F.struct("a", "b")).alias("drop"))
    )


def _cleaned(docs: DataFrame, span: int, min_words: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns _0, _1, ... but for the cleaned ``text`` and ``n_removed``, and the new names in the order of the old."""
    drop = repeated_runs(docs, span, min_words).select(F.col("doc_id").alias("r_id"), F.col("dk").alias("r_dk"), "drop")
    plain, at = positional(docs, "doc_id", "text")
    joined = plain.join(drop, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("r_id")) & (F.xxhash64(at["doc_id"], at["text"]) == F.col("r_dk")), "left")
    cols = [c for c in plain.columns if c != at["text"]]
    types = dict(plain.dtypes)
    schema = ", ".join(["text string", "n_removed int", *[f"`{c}` {types[c]}" for c in cols]])
    done = joined.select(at["text"], "drop", *cols).mapInArrow(_rewrite(), schema)
    return done, ["text" if c == at["text"] else c for c in plain.columns]


def substring_dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_removed`` (sentences taken out of the row's text).

    The first run of its kind, by (doc_id, position), stays; a null doc_id comes last. Null texts stay null, empty
    ones empty; a text of fewer than ``span`` sentences or ``min_words`` words has no runs. Rows that agree in doc_id
    and text count as one document and get the same result; rows that share a doc_id with other texts are ordered by a hash
    of the text. A text may become empty; its row stays. An empty table gives an empty result. Any further columns pass
    through unchanged (one called ``n_removed`` gives way).
    """
    done, columns = _cleaned(docs, span, min_words)
    result = [F.col(c).alias(name) for c, name in zip(columns, docs.columns) if name != "n_removed"]
    return done.select(*result, "n_removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "text", "n_removed")


def clean(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated sentences removed and exactly its columns; ``n_chars``, if there, counts the new text."""
    done, columns = _cleaned(docs, span, min_words)
    if "n_chars" in docs.columns:
        own = columns[docs.columns.index("n_chars")]
        done = done.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text").cast(dict(done.dtypes)[own])).otherwise(F.col(own)))
    return done.select(columns).toDF(*docs.columns)
