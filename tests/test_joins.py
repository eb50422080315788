"""What plans over stored nodes look like: no broadcast, no join where the path or the parent's number is enough."""

import pytest

from xylem.operators.frame import XmlFrame
from xylem.sources import markup, store, workspace


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, "<r><l f='R'><p>1</p><q>2</q></l><l><p>3</p></l><c>x</c> t</r>"), (2, "<r/>")], "doc_id long, xml string")
    return store.write(docs, f"file://{tmp_path_factory.mktemp('nodes')}/s")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_not_broadcast(stored):
    for df in (stored.texts_of("//p"), stored.xpath("//l[q]/p"), stored.xpath("//q/ancestor::r"), stored.eval("count(//l)", "root"), stored.xpath_text("//p")):
        assert "BroadcastExchange" not in _plan(df)


@pytest.mark.parametrize("path", ["/r/descendant-or-self::l/@f", "/r/l[1]/@f"])
def test_no_join(stored, path):
    assert "Join" not in _plan(stored.xpath(path, "root"))


def test_no_repetitions_to_remove(stored):
    plan = _plan(stored.xpath("/r/l[last()]/preceding::p", "root"))
    assert "LeftSemi" in plan and "Aggregate" not in plan


def test_shred_reads_named_children_once(stored):
    df = stored.shred("//l", {"p": ("p", "int"), "q": ("q", "int"), "c": ("../c", "string"), "n": ("count(../l)", "int")})
    assert sorted(map(tuple, df.drop("pre").collect()), key=repr) == [(1, 1, 2, "x", 2), (1, 3, None, "x", 2)]
    assert _plan(df).count("FileScan") == 4


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "<r><l f='R'><q>2</q></l></r>")], "doc_id long, xml string")
    found = XmlFrame(docs).xpath_string("//l[@f = 'R']/q", "root")
    assert "MapInArrow" not in _plan(found) and [r["value"] for r in found.collect()] == ["2"]


def test_batches_and_partitions_follow_the_size(spark, tmp_path):
    name, at = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", tmp_path / "large"
    at.write_bytes(b"")
    with open(at, "r+b") as f:
        f.truncate(400_000_000)
    before = spark.conf.get(name, None)
    try:
        workspace.spread(spark, f"file://{at}")
        assert int(spark.conf.get(name)) == 100
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    markup.parse(spark.createDataFrame([(1, "<a/>")], "doc_id long, xml string"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8_000_000
