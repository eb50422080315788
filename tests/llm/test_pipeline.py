"""The pipeline and the registered queries over a small folder of tables, against brute force; the SQL of those that have one."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests import oracle
from xylem.llm import decontamination, packing, toxicity
from xylem.llm.tokens import chunks

from .conftest import word
from .test_decontamination import brute_align
from .test_ngram_jaccard import brute_pairs
from .test_substring_dedup import brute as brute_runs
from .test_toxicity import labelled


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(21)
    texts, labels = labelled(240)
    passages = [". ".join(" ".join(word(rng) for _ in range(10)) for _ in range(6)) + "." for _ in range(3)]
    items = [" ".join(word(rng) for _ in range(25)) for _ in range(5)]
    docs = []
    for i, text, lang in texts:
        if i % 10 == 3:
            text = f"{text}. {passages[i % 3]} {' '.join(word(rng) for _ in range(60))}."
        if i % 24 == 5:
            text = f"{text} {items[i % 5]} {' '.join(word(rng) for _ in range(30))}"
        if i % 12 == 7:
            text = docs[i - 2][1] + " and a little more"
        docs.append((i, text, lang, f"s{i % 7}", len(text)))
    docs += [(900, None, "en", "s1", None), (901, "", None, None, 0)]
    at = tmp_path_factory.mktemp("tables")
    columns = list(zip(*docs))
    pq.write_table(pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": columns[1], "lang": columns[2], "source": columns[3], "n_chars": pa.array(columns[4], pa.int64())}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([y for _, y in labels], pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(5), pa.int64()), "text": items}), at / "benchmark.parquet")
    return str(at), docs, items


def test_each_stage_against_brute_force(spark, folder):
    at, docs, items = folder
    now = spark.read.parquet(f"{at}/documents.parquet")
    schema, texts, results = now.dtypes, {d[0]: d[1] for d in docs}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{at}/stage-{k}"
        stage(spark, now, at).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        results[name] = (before.collect(), now.collect())
        assert k == 4 or now.dtypes == schema
    model = toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    before, after = results["toxicity"]
    rejected = {r.doc_id for r in before if model.scores(toxicity.features(pa.array([r.text], pa.string())))[0] >= model.threshold(r.lang)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == rejected and 30 < len(rejected) < 120

    before, after = results["n-gram Jaccard join"]
    group = {r.doc_id: r.doc_id for r in before}
    changed = True
    pairs = brute_pairs([(r.doc_id, r.text) for r in before])
    while changed:
        changed = False
        for left, right, *_ in pairs:
            least = min(group[i] for i in (*left, *right))
            for i in (*left, *right):
                changed |= group[i] != least
                group[i] = least
    assert {r.doc_id for r in after} == {i for i, g in group.items() if i == g} and len(before) > len(after)

    before, after = results["substring dedup"]
    gone = brute_runs([(r.doc_id, r.text or "") for r in before], 3, 20)
    old = {r.doc_id: r for r in before}
    assert {r.doc_id for r in after} == set(old) and gone
    for r in after:
        assert (r.text == old[r.doc_id].text) == (r.doc_id not in gone)
        assert r.n_chars == (len(r.text) if r.doc_id in gone else old[r.doc_id].n_chars)

    before, after = results["benchmark decontamination"]
    bad = {r.doc_id for r in before for x in items if r.text and brute_align(x.split(), r.text.lower().replace(".", "").split()) / (decontamination.MATCH * len(x.split())) >= decontamination.THRESHOLD}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == bad and bad

    before, after = results["best-fit packing"]
    sizes = {r.doc_id: chunks().length(r.text) for r in before if r.text}
    assert {i: sum(r.length for r in after if r.doc_id == i) for i in sizes} == sizes and {r.doc_id for r in after} == {i for i, n in sizes.items() if n}
    for b in {r.bin for r in after}:
        own = [r for r in after if r.bin == b]
        assert sum(r.length for r in own) <= packing.CAPACITY and len({r.source for r in own}) == len(own)
    assert texts


def test_run_gives_the_last_stage(spark, folder):
    at, docs, _ = folder
    rows = corpus_pipeline.run(spark, at).collect()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{at}/again-{k}"
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
    assert rows and sorted(map(str, rows)) == sorted(map(str, docs.collect()))


def write_tables(at, docs, labels, items, more=()):
    columns = list(zip(*docs)) or [()] * 5
    kinds = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())))
    arrays = {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)}
    pq.write_table(pa.table(list(arrays.values()) + [pa.array([0] * len(docs), pa.int64()) for _ in more], names=[*arrays, *more]), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([y for _, y in labels], pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), at / "benchmark.parquet")
    return str(at)


def test_run_on_hostile_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows, and columns whose names the operators use themselves."""
    for name in ("none", "some"):
        (tmp_path / name).mkdir()
    assert corpus_pipeline.run(spark, write_tables(tmp_path / "none", [], [], [])).collect() == []
    rng = random.Random(3)
    texts = {i: ". ".join(" ".join(word(rng) for _ in range(8)) for _ in range(5)) + "." for i in range(3)}
    docs = [(i, t, "en", f"s{i}", len(t)) for i, t in texts.items()] + [(1, texts[1], "en", "s1", len(texts[1])), (7, None, None, None, None), (None, "no name, few words", None, None, None), (8, "", "de", "s1", 0)]
    rows = corpus_pipeline.run(spark, write_tables(tmp_path / "some", docs, [], [], ("sid", "tie", "cell", "h"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 0), (False, 1), (False, 2), (True, 0)]


def test_what_run_writes_on_its_way_is_deleted(spark, folder):
    from xylem.llm.common import written

    before = written()
    corpus_pipeline.run(spark, folder[0])
    assert written() - before < 5


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_decontamination", "op5_toxicity", "op7_license_scan", "op8_token_codes", "op9_token_counts", "op10_best_fit_packing"])
def test_registered_queries_take_the_whole_table(spark, folder, name):
    at, docs, _ = folder
    rows = entry.queries()[name](spark, at).collect()
    if name in ("op1_substring_dedup", "op5_toxicity", "op8_token_codes", "op9_token_counts"):
        assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    if name == "op2_decontamination":
        assert {r.doc_id for r in rows} == {d[0] for d in docs if d[1] and any(i in d[1] for i in folder[2])}


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op4_exact_topk"])
def test_queries_against_sql(spark, name):
    if not os.path.isdir(oracle.SF):
        pytest.skip("no test tables here")
    oracle.assert_same(spark, oracle.connection(), entry.queries()[name], entry.oracle_sql()[name])


def test_toxicity_on_held_out_documents(spark):
    """Accuracy over labelled documents that neither training nor the thresholds saw."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    unseen = toxicity.score(docs, model).join(labels.where("doc_id % 5 = 0").withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").toPandas()
    right = unseen["toxic"].to_numpy() == (unseen["truth"].to_numpy() == 1)
    truth = unseen["truth"].to_numpy() == 1
    print("held out:", len(right), "accuracy", right.mean(), "recall", right[truth].mean(), "clean kept", right[~truth].mean())
    assert len(right) > 500 and right.mean() > 0.97 and right[truth].mean() > 0.93 and right[~truth].mean() > 0.99 and np.isfinite(right.mean())


def test_the_second_stage_sends_small_batches_to_python(spark):
    """Its rows of postings are large: 1,000 of them would be a whole shard."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "one text of a few words"), (2, "one text of a few words"), (3, "quite another one")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [1, 3]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8_000_000
