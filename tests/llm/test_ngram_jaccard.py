import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from xylem.llm import common
from xylem.llm import ngram_jaccard as j

from .conftest import NO_DOCS, hostile, word


def grams(text, n=j.N):
    w = [x for x in (re.sub(r"[\W_]+", "", p.lower()) for p in (text or "").split()) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b)


def near_copies(rng, n=60):
    docs = []
    for g in range(n // 4):
        words = [word(rng) for _ in range(rng.choice([3, 12, 40, 120]))]
        for c in range(4):
            own = list(words)
            for _ in range(c * len(own) // 40 if len(own) > 3 else 0):
                own[rng.randrange(len(own))] = word(rng)
            docs.append((len(docs), " ".join(own[: len(own) - (c == 3) * len(own) // 3])))
    return docs


def brute_pairs(docs):
    sets = {}
    for i, t in docs:
        if g := grams(t):
            sets.setdefault(g, []).append(i)
    lists, out = sorted(sets.items(), key=lambda x: x[1][0]), set()
    for k, (a, ia) in enumerate(lists):
        if len(ia) > 1:
            out.add((tuple(ia), tuple(ia), len(a), len(a), len(a)))
        for b, ib in lists[k + 1 :]:
            if similarity(a, b) >= j.THRESHOLD:
                out.add((tuple(ia), tuple(ib), len(a), len(b), len(a & b)))
    return out


def brute_rows(docs):
    """(doc_id, class_id, n_links) of every document with words and one text."""
    group, links = {i: i for i, t in docs if grams(t)}, {i: 0 for i, t in docs if grams(t)}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for left, right, *_ in brute_pairs(docs):
        for x in left:
            for y in right:
                a, b = find(x), find(y)
                group[max(a, b)] = min(a, b)
                if left != right:
                    links[x], links[y] = links[x] + 1, links[y] + 1
                elif x != y:
                    links[x] += 1
    return {(i, find(i), n) for i, n in links.items()}


def rows(df, **options):
    return {tuple(r) for r in j.ngram_jaccard_join(df, **options).collect()}


def test_against_brute_force(spark, rng, monkeypatch):
    docs = near_copies(rng)
    monkeypatch.setattr(j, "MERGE_POSTINGS", 50)  # several parts to a shard
    monkeypatch.setattr(j, "FREQUENT_LEAST", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(df)
    assert got == brute_rows(docs) and sum(n > 0 for _, _, n in got) > 30


def test_large_groups(spark, rng, monkeypatch):
    """A group with more pairs than one cell holds."""
    monkeypatch.setattr(j, "CELL_PAIRS", 40)
    words = [word(rng) for _ in range(60)]
    docs = [(i, " ".join(words[:30] + [word(rng)] + words[31:])) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(df) == {(i, 0, 24) for i in range(25)} == brute_rows(docs)
    assert [r.doc_id for r in j.keep_one_of_each_group(df).collect()] == [0]


def test_merging_holds_few_pairs_at_once(rng):
    """2,500 texts with a common passage are 3,123,750 pairs: all come, and nowhere near all are held."""
    passage = " ".join(word(rng) for _ in range(12))
    texts = [f"{passage} own{i} text{i}" for i in range(2500)]
    none = np.empty(0, np.uint64)
    blobs = list(j._postings(j.N, j.THRESHOLD, 1, none, none)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    tracemalloc.start()
    try:
        pairs = sum(len(b) for b in j._merge(j.THRESHOLD, 1)(iter(blobs)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == 2500 * 2499 // 2 and most < 80e6


def test_many_shards_make_few_units(spark, rng, monkeypatch):
    """Lists of one document are dropped in 40 shards, the rest is merged in two units, few pairs at a time."""
    docs = near_copies(rng, 120) + [(1000, near_copies(rng, 4)[0][1])]
    monkeypatch.setattr(j, "SHARD_GRAMS", sum(len(grams(t)) for _, t in docs) // 40)
    for name, value in (("LEAST_SHARDS", 2), ("MERGE_POSTINGS", 50), ("BLOB_POSTINGS", 30), ("MERGE_PAIRS", 7)):
        monkeypatch.setattr(j, name, value)
    got = rows(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute_rows(docs) and sum(n > 0 for _, _, n in got) > 60


def test_copies_extended_to_twice_the_length(spark, rng, monkeypatch):
    """Common n-grams are frequent, so the longer text's short lists end with its own n-grams and a few common ones."""
    monkeypatch.setattr(j, "LEAST_SHARDS", 1)
    docs = []
    for g in range(3):
        words = [word(rng) for _ in range(300)]
        docs += [(len(docs) + c, " ".join(words[:-1] + [word(rng)])) for c in range(j.FREQUENT_LEAST + 2)]
        docs += [(len(docs) + c, " ".join(words + [word(rng) for _ in range(300)])) for c in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(df) == brute_rows(docs) and sum(a != b for _, _, a, b, _ in brute_pairs(docs)) == 3 * 2 * (j.FREQUENT_LEAST + 2)


@pytest.mark.parametrize("size", [40, 200])
def test_a_passage_inside_much_longer_texts(spark, rng, size):
    """A passage and 40 documents of two and a half times its length that contain it: similarity exactly at the threshold."""
    passage = [word(rng) for _ in range(size + j.N - 1)]
    docs = [(0, " ".join(passage))]
    for i in range(1, 41):
        docs.append((i, " ".join(passage + [f"{word(rng)}{i}" for _ in range(size * 3 // 2)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(df)
    assert got == brute_rows(docs) and (0, 0, 40) in got and {c for _, c, _ in got} == {0}
    assert [r.doc_id for r in j.keep_one_of_each_group(df).collect()] == [0]


def test_sizes_from_equal_to_two_fifths(spark, rng):
    """Parts of one text, of all sizes, with shared passages that are frequent elsewhere."""
    shared = [word(rng) for _ in range(30)]
    docs = []
    for g in range(4):
        words = [word(rng) for _ in range(100)] + shared
        docs += [(len(docs) + k, " ".join(words[: 130 - 10 * k] + [word(rng) for _ in range(k)])) for k in range(9)]
    docs += [(len(docs) + k, " ".join([word(rng) for _ in range(40)] + shared)) for k in range(20)]
    assert rows(spark.createDataFrame(docs, "doc_id long, text string")) == brute_rows(docs)


def test_one_of_each_group_stays(spark, rng):
    docs = near_copies(rng)
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for left, right, *_ in brute_pairs(docs):
        for x in (*left, *right):
            a, b = find(x), find(left[0])
            parent[max(a, b)] = min(a, b)
    kept = {r.doc_id for r in j.keep_one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in docs if find(i) == i}


def test_chains_are_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    roots = dict(j.components(edges).collect())
    assert {roots[i] for i in range(1, 41)} == {0} and roots[101] == roots[102] == 100


def test_hostile_tables(spark):
    docs = hostile(spark, [(7, "some PLAIN text, here", "en", "d", 3, 3, "q")])
    assert rows(docs) == {(1, 1, 1), (7, 1, 1)} | {(i, i, 0) for i in (2, 3, 4, 5, 6)}
    kept = j.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 6)] + [(True, 0)]
    none = spark.createDataFrame([], NO_DOCS)
    assert j.ngram_jaccard_join(none).collect() == [] and j.keep_one_of_each_group(none).collect() == []


def test_what_a_shard_hands_on_is_small_rows_in_small_row_groups(spark):
    """Rows of several megabytes, in row groups of 128 MB, took an executor's memory as units were merged; none of the postings may be lost."""
    n = 120_000
    columns = [[np.arange(n, dtype=np.int64)], [np.full(n, 9, np.uint32)], [np.zeros(n, np.uint32)], [np.ones(n, np.uint32)], [(np.arange(n) // 2).astype(np.uint32)]]
    found = list(j._shared_lists(columns))
    assert max(len(blob) for _, blob, _ in found) < 512 * 1024  # half a region of a heap of 2 GB: no object of its own kind
    sids = np.concatenate([np.frombuffer(blob, np.int64, k) for k, blob, _ in found])
    grams = np.concatenate([np.frombuffer(blob, np.uint32, -1, 20 * k) for k, blob, _ in found])
    assert (sids == np.arange(n)).all() and (grams == np.arange(n) // 2).all() and sum(g for *_, g in found) == n
    rows = [(0, k, os.urandom(len(blob)), g) for k, blob, g in found] * 20
    df = spark.createDataFrame(rows, "shard int, n int, blob binary, grams long").coalesce(1)
    back = common.cut(df, row_group=j.BLOB_ROW_GROUP)
    at = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in back.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in at for i in range(m.num_row_groups)]
    assert back.count() == len(rows) and max(groups) < 2 * j.BLOB_ROW_GROUP < sum(groups)
