from xylem.llm import decontamination as d
from xylem.llm.common import word_hashes

from .conftest import NO_DOCS, hostile, word


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(map(max, h))


def case(rng):
    items = [" ".join(word(rng) for _ in range(rng.randint(20, 40))) for _ in range(12)]
    docs = []
    for i in range(80):
        words = [word(rng) for _ in range(rng.randint(30, 200))]
        if i % 4 == 0:
            copy = items[i % 12].split()
            for _ in range(i // 8):  # more and more edits
                k = rng.randrange(len(copy))
                copy[k : k + rng.choice([0, 1, 1])] = [word(rng)] * rng.choice([0, 1, 1])
            at = rng.randrange(len(words))
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    return items, docs


def test_alignment_against_brute_force(rng):
    for _ in range(30):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert d.smith_waterman(word_hashes(" ".join(a)), word_hashes(" ".join(b)))[0] == brute_align(a, b)


def test_against_brute_force(spark, rng):
    items, docs = case(rng)
    want = {(i, k): brute_align(item.split(), text.split()) / (d.MATCH * len(item.split())) for i, text in docs for k, item in enumerate(items)}
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (d.BROADCAST_SEEDS, 0):  # seeds sent to the tasks, and joined by a shuffle
        got = {(r.doc_id, r.item_id): r for r in d.decontaminate(docs_df, items_df, broadcast_seeds=limit).collect()}
        assert {k: round(r.score, 9) for k, r in got.items()} == {k: round(x, 9) for k, x in want.items() if x >= d.THRESHOLD}
        assert len(got) >= 12
    exact = got[0, 0]
    assert " ".join(docs[0][1].split()[exact.first_word : exact.after_word]) == items[0]
    kept = {r.doc_id for r in d.drop_contaminated(docs_df, items_df).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_hostile_tables(spark):
    items = spark.createDataFrame([(1, "Some plain text here", 1), (1, "Some plain text here", 2), (2, None, 3), (3, "", 4), (None, "plain text", 5), (4, "Viktor", 6)], "item_id long, text string, TEXT int")
    docs = hostile(spark)
    for limit in (d.BROADCAST_SEEDS, 0):
        got = d.decontaminate(docs, items, broadcast_seeds=limit).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.score) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0), (6, 4, 1.0)]
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 3, 4, 5]
    none = spark.createDataFrame([], NO_DOCS)
    assert d.decontaminate(none, items).collect() == [] and d.decontaminate(docs, items.limit(0)).collect() == []
    assert d.drop_contaminated(docs, items.limit(0)).count() == docs.count()
