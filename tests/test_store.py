"""The stored node table, files, SQL functions and streams."""

from xylem.functions import sql as sql_functions
from xylem.sources import files, store
from xylem.streaming import documents as streams


def test_store_and_refresh(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<a/>"), (None, "<b/>"), (4, None)], "doc_id long, xml string")
    path = f"file://{tmp_path}/one"
    f = store.write(docs, path)
    assert [r.value for r in f.xpath_string("//b/text()", "root").collect()] == ["x"]
    assert store.stale(docs, path).collect() == []
    changed = spark.createDataFrame([(1, "<a><b>y</b></a>"), (2, "<a/>"), (5, "<b>z</b>")], "doc_id long, xml string")
    assert {r.doc_id for r in store.stale(changed, path).collect()} == {1, 5}
    g = store.refresh(changed, path, f"file://{tmp_path}/two")
    assert sorted(r.value for r in g.xpath_string("//b", "root").collect()) == ["y", "z"]
    assert {r.doc_id for r in g.count_batch("//a").collect()} == {1, 2, 5}
    h = store.load_or_write(changed, f"file://{tmp_path}/two")
    assert sorted(r.value for r in h.xpath_string("//b", "root").collect()) == ["y", "z"]
    i = store.load_or_write(docs, f"file://{tmp_path}/two")  # in place: one document changed back, one new, one gone
    assert [r.value for r in i.xpath_string("//b", "root").collect() if r.doc_id] == ["x"] and store.stale(docs, f"file://{tmp_path}/two").isEmpty()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]


def test_summaries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<a><!-- <b> --></a>"), (3, "<a/>"), (4, None), (5, "<b\u00a0c='1'/><x:y z='<w>'/>")], "doc_id long, xml string")
    store.write(docs, f"file://{tmp_path}/s")
    assert {r.doc_id: r.tags for r in store.summaries(spark, f"file://{tmp_path}/s").collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["a"], 4: None, 5: ["b", "x:y", "w"]}
    lazy = store.load_lazy(spark, f"file://{tmp_path}/s")
    assert [(r.doc_id, r.text) for r in lazy.xpath_text("//b", "root").collect()] == [(1, "x")]
    assert {r.doc_id: r.n for r in lazy.count_batch("//b").collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    plan = lazy.xpath("//b", "root")._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" in plan


def test_pushdown(spark, tmp_path):
    f = store.write(spark.createDataFrame([(1, "<a><b>x</b></a>")], "doc_id long, xml string"), f"file://{tmp_path}/s")
    plan = f.xpath("/a/b", "root")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,b)" in plan and "value" not in plan.split("ReadSchema")[1] and "Exchange" not in plan and "Join" not in plan


def test_files_and_records(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<all><rec n='1'>a</rec>\n<rec n='2'>b</rec><record/></all>")
    whole = files.read_files(spark, f"file://{tmp_path}/x.xml")
    assert whole.count() == 1 and whole.columns == ["doc_id", "uri", "xml"]
    for record in ("rec", None):
        assert sorted(r.xml for r in files.read_records(spark, f"file://{tmp_path}/x.xml", record).collect()) == ["<rec n='1'>a</rec>", "<rec n='2'>b</rec>"]


def test_sql_functions(spark):
    sql_functions.register(spark)
    spark.createDataFrame([(1, "<a><b>x</b><b/>y</a>", "//b"), (2, None, "//b"), (3, "<a/>", None)], "id int, xml string, e string").createOrReplaceTempView("t")
    assert [tuple(r) for r in spark.sql("SELECT id, result FROM t, LATERAL xpath_text(xml, e)").collect()] == [(1, "x")]
    rows = spark.sql("SELECT id, xml_strings(xml, e) s, xml_fragments(xml, e) f, xml_decode('&lt;') d FROM t ORDER BY id").collect()
    assert [(r.s, r.f, r.d) for r in rows] == [(["x", ""], ["<b>x</b>", "<b/>"], "<"), ([], [], "<"), ([], [], "<")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.xml").write_text(f"<a><b>{k}</b></a>")
    found = streams.strings(streams.file_stream(spark, f"file://{tmp_path}/in", 2), "//b")
    q = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert sorted(r.value for r in spark.table("found").collect()) == ["0", "1", "2"]
