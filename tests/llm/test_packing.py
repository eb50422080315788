from xylem.llm import packing as p

from .conftest import NO_DOCS, hostile, word


def brute(sizes, bits, capacity):
    """Best fit by trying every bin."""
    bins, out = [], []
    for size, own in zip(sizes, bits):
        fits = [(room, k) for k, (room, held) in enumerate(bins) if room >= size and not held & own]
        if fits:
            room, k = min(fits)
        else:
            room, k = capacity, len(bins)
            bins.append([capacity, 0])
        bins[k] = [room - size, bins[k][1] | own & ~1]
        out.append(k)
    return out


def test_against_brute_force(rng):
    for _ in range(60):
        capacity, n = rng.choice([10, 64, 100]), rng.randint(1, 120)
        sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
        bits = [1 | rng.choice([0, 2, 4, 8, 6, 16]) for _ in range(n)]
        assert p.pack(sizes, bits, capacity) == brute(sizes, bits, capacity)


def test_constraints_and_cover(spark, rng):
    docs = []
    for i in range(300):
        text = " ".join(word(rng) for _ in range(rng.choice([3, 20, 60, 200]))) if i % 5 else "the same few words here"
        docs.append((i, text, rng.choice(["hot"] * 3 + [f"s{i % 40}", None])))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = p.best_fit_packing(df, capacity=128, shard_docs=100).collect()
    assert len({r.shard for r in rows}) > 1
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    from xylem.llm.tokens import chunks

    for i, text, _ in docs:  # every token once
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == chunks().length(text)
    for own in bins.values():
        assert sum(r.length for r in own) <= 128
        sources = [r.source for r in own if r.source]
        assert len(sources) == len(set(sources)) and len({r.doc_id for r in own}) == len(own)
        assert sum(docs[r.doc_id][1] == "the same few words here" for r in own) <= 1


def test_given_clusters(spark, rng):
    docs = [(i, " ".join(word(rng) for _ in range(12)), f"s{i}") for i in range(60)]
    named = [(i, i % 3) for i in range(30)] + [(5, 9), (31, None), (None, 1), (99, 1)]
    df, clusters = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(named, "doc_id long, class_id long")
    free = p.best_fit_packing(df, capacity=4096).collect()
    assert len({r.bin for r in free}) == 1
    rows = p.best_fit_packing(df, capacity=4096, clusters=clusters).collect()
    bins = {r.doc_id: r.bin for r in rows}
    assert len(rows) == len(bins) == 60 and len(set(bins.values())) == 10
    for k in range(3):
        own = [bins[i] for i in range(k, 30, 3)]
        assert len(set(own)) == 10
    empty = p.best_fit_packing(df, capacity=4096, clusters=clusters.where("false")).collect()
    assert sorted(empty) == sorted(free)


def test_hostile_tables(spark):
    docs = hostile(spark)
    rows = p.best_fit_packing(docs).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5, 6, None}
    same = [r.bin for r in rows if r.doc_id in (1, None)]
    assert len(same) == len(set(same)) == 3  # repeated rows are one cluster
    assert sum(r.length for r in rows if r.doc_id == 5) > 50_000
    assert p.best_fit_packing(spark.createDataFrame([], NO_DOCS)).collect() == []
