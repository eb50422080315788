"""The registered queries over XML documents and their SQL oracles.

Documents are made from the whole tables of the given folder (``sources.relational``), parsed once a session into a stored node
table in the shared folder, and queried from there. The oracles compute the same answers from the relational tables, without any XML.
"""

from __future__ import annotations

import io
import math
import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.functions import sql as sql_functions
from xylem.operators.frame import XmlFrame, merged, standalone, strings_per_document
from xylem.sources import files, markup, relational, store, workspace
from xylem.streaming import documents as streams

_STORES: dict[tuple[str, str, str], str] = {}
_DOCUMENTS: dict[tuple[str, str, str], str] = {}


def frame(spark: SparkSession, sf_dir: str, kind: str) -> XmlFrame:
    """The stored node table of one kind of documents; made when first asked for in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORES:
        path = workspace.new_path(spark, f"nodes-{kind}")
        store.write(relational.documents(spark, sf_dir, kind), path)
        _STORES[key] = path
    return store.load(spark, _STORES[key])


def documents(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Where the stored documents of one kind are, without nodes unless those are there anyway."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key in _STORES:
        return _STORES[key]
    if key not in _DOCUMENTS:
        path = workspace.new_path(spark, f"documents-{kind}")
        store.write_documents(relational.documents(spark, sf_dir, kind), path)
        _DOCUMENTS[key] = path
    return _DOCUMENTS[key]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, links): heading and number of links of every page."""
    return _titles(spark, sf_dir)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "page")
    heads = pages.xpath_text("//h1/text()", "root").groupBy("doc_id").agg(F.min_by("text", "pre").alias("title"))
    links = pages.count_batch("//a/@href")
    return links.join(merged(heads), "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.col("n").alias("links"))


_OL = (
    "WITH ol AS (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty, CAST(l_partkey AS VARCHAR) AS part, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS k, "
    "count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) "
)


def _lines(value: str, where: str = "TRUE") -> str:
    return f"{_OL}SELECT l_orderkey AS doc_id, {value} AS value FROM ol WHERE {where}"


def _orders(value: str, where: str = "TRUE") -> str:
    return f"SELECT o_orderkey AS doc_id, {value} AS value FROM orders WHERE {where}"


_OID = "CAST(o_orderkey AS VARCHAR)"
_HAS = "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {})"


def _per_order(value: str, default: str) -> str:
    """An aggregate over each order's lines, also for orders without lines."""
    return f"SELECT o_orderkey AS doc_id, coalesce(v, {default}) AS value FROM orders LEFT JOIN (SELECT l_orderkey, {value} AS v FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"


def _parts(value: str, where: str = "TRUE") -> str:
    return f"SELECT p_partkey AS doc_id, {value} AS value FROM part WHERE {where}"


def _customers(value: str, where: str = "TRUE") -> str:
    return f"SELECT c_custkey AS doc_id, {value} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {where}"


#: name: (documents, XPath, SQL for doc_id and value). A node-set gives one row for each node.
XPATHS: dict[str, tuple[str, str, str]] = {
    # axes
    "axis_child": ("order", "/order/lines/line/part", _lines("part")),
    "axis_descendant": ("order", "//qty", _lines("qty")),
    "axis_descendant_or_self": ("order", "/order/lines/descendant-or-self::line/@flag", _lines("l_returnflag")),
    "axis_parent": ("order", "//qty[. > 40]/../@flag", _lines("l_returnflag", "l_quantity > 40")),
    "axis_ancestor": ("order", "//line[qty = 50]/ancestor::order/@id", _orders(_OID, _HAS.format("l_quantity = 50"))),
    "axis_ancestor_or_self": ("order", "//line[qty = 50]/ancestor-or-self::*[@flag]/qty", _lines("qty", "l_quantity = 50")),
    "axis_following_sibling": ("order", "/order/lines/line[1]/following-sibling::line/@n", _lines("CAST(l_linenumber AS VARCHAR)", "k > 1")),
    "axis_preceding_sibling": ("order", "/order/lines/line[last()]/preceding-sibling::line/qty", _lines("qty", "k < n")),
    "axis_following": ("order", "/order/lines/line[2]/following::qty", _lines("qty", "k > 2")),
    "axis_preceding": ("order", "/order/lines/line[last()]/preceding::part", _lines("part", "k < n")),
    "axis_self": ("order", "//line/self::line/@status", _lines("l_linestatus")),
    "axis_attribute": ("order", "/order/@*", " UNION ALL ".join(_orders(x) for x in (_OID, "o_orderstatus", "o_orderpriority"))),
    "axis_namespace": ("prefixed", "//y:size/namespace::*", " UNION ALL ".join(_parts(f"'{u}'") for u in ("urn:p", "urn:s", "http://www.w3.org/XML/1998/namespace"))),
    # node tests
    "test_wildcard": ("order", "/order/lines/*/part", _lines("part")),
    "test_text": ("order", "//qty/text()", _lines("qty")),
    "test_node": ("part", "/part/node()", " UNION ALL ".join(_parts(x) for x in ("'  '", "p_name", "' tail '", "CAST(p_partkey AS VARCHAR)", "p_brand", "p_type"))),
    "test_comment": ("part", "//comment()", _parts("CAST(p_partkey AS VARCHAR)")),
    "test_pi": ("part", "/processing-instruction('size')", _parts("CAST(p_size AS VARCHAR)")),
    "test_prefixed": ("prefixed", "/x:part/x:brand", _parts("p_brand")),
    "test_prefix_wildcard": ("prefixed", "//y:*", _parts("CAST(p_size AS VARCHAR)")),
    # predicates
    "pred_attr_eq": ("order", "//line[@flag = 'R']/qty", _lines("qty", "l_returnflag = 'R'")),
    "pred_position": ("order", "/order/lines/line[2]/part", _lines("part", "k = 2")),
    "pred_last": ("order", "//line[last()]/part", _lines("part", "k = n")),
    "pred_range": ("order", "/order/lines/line[position() > 1 and position() < 4]/qty", _lines("qty", "k > 1 AND k < 4")),
    "pred_arithmetic": ("order", "/order/lines/line[last() - 1]/part", _lines("part", "k = n - 1")),
    "pred_reverse_position": ("order", "/order/lines/line[last()]/preceding-sibling::line[1]/part", _lines("part", "k = n - 1")),
    "pred_exists": ("order", "/order[lines/line]/@id", _orders(_OID, _HAS.format("TRUE"))),
    "pred_not_exists": ("order", "/order[not(lines/line)]/@id", _orders(_OID, "NOT " + _HAS.format("TRUE"))),
    "pred_nodeset_cmp": ("order", "/order[lines/line/qty > 45]/@id", _orders(_OID, _HAS.format("l_quantity > 45"))),
    "pred_nodeset_pair": ("order", "/order[lines/line/part = lines/line/qty]/@id", _orders(_OID, "o_orderkey IN (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_quantity)")),
    "pred_nodeset_less": ("order", "/order[lines/line[@flag = 'R']/qty < lines/line[@flag = 'A']/qty]/@id", _orders(_OID, "o_orderkey IN (SELECT r.l_orderkey FROM lineitem r JOIN lineitem a ON r.l_orderkey = a.l_orderkey AND r.l_returnflag = 'R' AND a.l_returnflag = 'A' AND r.l_quantity < a.l_quantity)")),
    "pred_and_or": ("order", "//line[@flag = 'R' and qty > 10 or @status = 'F' and qty < 5]/part", _lines("part", "l_returnflag = 'R' AND l_quantity > 10 OR l_linestatus = 'F' AND l_quantity < 5")),
    "pred_multi": ("order", "//line[@flag = 'R'][2]/part", f"{_OL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS j FROM ol WHERE l_returnflag = 'R') SELECT l_orderkey AS doc_id, part AS value FROM r WHERE j = 2"),
    "pred_multi_order": ("order", "//line[2][@flag = 'R']/part", _lines("part", "k = 2 AND l_returnflag = 'R'")),
    "pred_nested": ("order", "//line[qty[. > 48]]/part", _lines("part", "l_quantity > 48")),
    "pred_negative": ("order", "/order/lines/line[-(-2)]/part", _lines("part", "k = 2")),
    "pred_string": ("part", "/part[string(name)]['x'][not('')]/brand", _parts("p_brand", "p_name <> ''")),
    "pred_union": ("order", "/order[lines/gift | lines/line]/@id", _orders(_OID, _HAS.format("TRUE"))),
    "pred_filter": ("order", "/order[(lines/line)[3]]/@id", _orders(_OID, "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3)")),
    "lang_of_no_language": ("order", "count(//*[lang('')])", _orders("CAST(0 AS DOUBLE)")),
    "pred_count": ("order", "/order[count(lines/line) = 3]/@id", _orders(_OID, "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 3)")),
    # paths
    "global_filter": ("order", "(//line)[3]/part", _lines("part", "k = 3")),
    "filter_path": ("order", "(//line[@flag = 'A'])/qty", _lines("qty", "l_returnflag = 'A'")),
    "union": ("order", "//part | //qty", f"{_lines('part')} UNION ALL SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem"),
    "union_overlap": ("order", "//line[@flag = 'R']/qty | //line[qty > 30]/qty", _lines("qty", "l_returnflag = 'R' OR l_quantity > 30")),
    "id_fn": ("region", "id('n1 n3 n5 n7')/name", "SELECT n_regionkey AS doc_id, n_name AS value FROM nation WHERE n_nationkey IN (1, 3, 5, 7)"),
    # functions and operators
    "fn_count": ("order", "count(//line)", _per_order("CAST(count(*) AS DOUBLE)", "0")),
    "fn_sum": ("order", "sum(//qty)", _per_order("CAST(sum(l_quantity) AS DOUBLE)", "0")),
    "fn_string": ("order", "string(//line[1]/part)", "SELECT o_orderkey AS doc_id, coalesce(part, '') AS value FROM orders LEFT JOIN (" + _OL + "SELECT l_orderkey, part FROM ol WHERE k = 1) ON l_orderkey = o_orderkey"),
    "fn_concat": ("customer", "concat(/customer/name, '/', /customer/@nation, '/', 7)", _customers("c_name || '/' || n_name || '/7'")),
    "fn_contains": ("part", "/part[contains(name, 'ring')]/brand", _parts("p_brand", "contains(p_name, 'ring')")),
    "fn_starts_with": ("part", "/part[starts-with(name, 'small')]/brand", _parts("p_brand", "starts_with(p_name, 'small')")),
    "fn_substring": ("part", "substring(/part/name, 3, 4)", _parts("substring(p_name, 3, 4)")),
    "fn_substring_rounding": ("part", "substring(/part/name, 1.5, 2.6)", _parts("substring(p_name, 2, 3)")),
    "fn_substring_before": ("part", "substring-before(/part/name, ' ')", _parts("CASE WHEN strpos(p_name, ' ') > 0 THEN substring(p_name, 1, strpos(p_name, ' ') - 1) ELSE '' END")),
    "fn_substring_after": ("part", "substring-after(/part/brand, '#')", _parts("CASE WHEN strpos(p_brand, '#') > 0 THEN substring(p_brand, strpos(p_brand, '#') + 1) ELSE '' END")),
    "fn_string_length": ("text", "string-length(/doc/body)", "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS value FROM documents"),
    "fn_normalize_space": ("part", "normalize-space(/part)", _parts("p_name || ' tail ' || p_brand || p_type")),
    "fn_translate": ("part", "translate(/part/name, 'aeiou', 'AEI')", _parts("replace(replace(translate(p_name, 'aei', 'AEI'), 'o', ''), 'u', '')")),
    "fn_number": ("part", "number(/part/@size) * 2", _parts("CAST(p_size * 2 AS DOUBLE)")),
    "fn_floor": ("part", "floor(/part/@size div 4)", _parts("floor(p_size / 4.0)::DOUBLE")),
    "fn_ceiling": ("part", "ceiling(/part/@size div 4)", _parts("ceil(p_size / 4.0)::DOUBLE")),
    "fn_round": ("part", "round(/part/@size div 4)", _parts("floor(p_size / 4.0 + 0.5)::DOUBLE")),
    "fn_boolean": ("order", "boolean(//line[qty = 50])", _orders(_HAS.format("l_quantity = 50"))),
    "fn_not": ("order", "not(//line)", _orders("NOT " + _HAS.format("TRUE"))),
    "fn_name": ("prefixed", "name(/*/*[2])", _parts("'y:size'")),
    "fn_local_name": ("prefixed", "//*[local-name() = 'brand']", _parts("p_brand")),
    "fn_namespace_uri": ("prefixed", "namespace-uri(//*[2])", _parts("'urn:s'")),
    "fn_lang": ("text", "/doc/source[lang('de')]", "SELECT doc_id, source AS value FROM documents WHERE lang = 'de'"),
    "fn_true_false": ("region", "true() and not(false())", "SELECT r_regionkey AS doc_id, TRUE AS value FROM region"),
    "op_arithmetic": ("part", "(/part/@size + 3) * 2 - 1", _parts("CAST((p_size + 3) * 2 - 1 AS DOUBLE)")),
    "op_div_mod": ("part", "/part/@size mod 7", _parts("CAST(p_size % 7 AS DOUBLE)")),
    "op_negate": ("part", "-/part/@size", _parts("CAST(-p_size AS DOUBLE)")),
    "op_compare": ("part", "/part/@size >= 25", _parts("p_size >= 25")),
    "op_not_equal": ("order", "/order[lines/line/@flag != 'R']/@id", _orders(_OID, _HAS.format("l_returnflag <> 'R'"))),
    "number_text": ("part", "string(/part/@size div 8)", _parts("CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE CAST(p_size / 8.0 AS VARCHAR) END")),
    "entities": ("text", "string(/doc/body)", "SELECT doc_id, coalesce(text, '') AS value FROM documents"),
}


def _xpath(kind: str, xpath: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, kind).eval(xpath, "root").select("doc_id", "value")


def _text_output(spark, sf_dir):
    return frame(spark, sf_dir, "page").xpath_text("//h1", "root").select("doc_id", "text")


def _string_output(spark, sf_dir):
    return frame(spark, sf_dir, "order").xpath_string("/order/lines", "root").select("doc_id", "value")


def _raw_output(spark, sf_dir):
    return frame(spark, sf_dir, "order").xpath_raw("//line[@flag = 'R']/qty", "root").select("doc_id", "raw")


def _json_output(spark, sf_dir):
    return frame(spark, sf_dir, "order").json("//line/part")


def _display_output(spark, sf_dir):
    return frame(spark, sf_dir, "order").display("//qty", "root")


def _batch_text(spark, sf_dir):
    return frame(spark, sf_dir, "order").batch_text("//qty").select("doc_id", F.array_join("texts", ",").alias("texts"))


def _batch_count(spark, sf_dir):
    return frame(spark, sf_dir, "order").count_batch("//line[@flag = 'R']")


def _batch_prefilter(spark, sf_dir):
    """Parsing only the documents and elements that the query needs, with nothing stored."""
    docs = relational.documents(spark, sf_dir, "page")
    return XmlFrame(docs).xpath_text("//h1", "root").select("doc_id", "text")


def _matching(spark, sf_dir):
    return frame(spark, sf_dir, "order").matching("//line[qty = 50]")


def _relative_context(spark, sf_dir):
    return frame(spark, sf_dir, "order").xpath_string("lines/line/qty", "element").select("doc_id", "value")


def _whole_documents(spark, sf_dir):
    """Evaluation inside one map over the documents, without node table or shuffle."""
    return strings_per_document(relational.documents(spark, sf_dir, "page"), "//a/@href").select("doc_id", "ord", "value")


def _top_tags(spark, sf_dir):
    return frame(spark, sf_dir, "order").info()


def _summary(spark, sf_dir):
    found = frame(spark, sf_dir, "order").summary()
    return found.select("doc_id", "n_tags", "n_text", "max_depth", F.array_join("tag_names", ",").alias("tag_names"))


def _nav_children(spark, sf_dir):
    return frame(spark, sf_dir, "part").children("/part").select("doc_id", "name", F.col("ordinal").cast("int").alias("ordinal"))


def _nav_texts(spark, sf_dir):
    found = frame(spark, sf_dir, "part").texts_of("/part/name")
    return found.select("doc_id", "name", "text", "tail", "all_text")


def _nav_attributes(spark, sf_dir):
    return frame(spark, sf_dir, "order").attributes("//line").select("doc_id", "name", "value")


def _canonical(spark, sf_dir):
    return store.load_lazy(spark, documents(spark, sf_dir, "order")).canonical("/order").select("doc_id", F.col("xml").alias("canonical"))


def _udtf(spark, sf_dir):
    sql_functions.register(spark)
    relational.documents(spark, sf_dir, "part").createOrReplaceTempView("xylem_part_docs")
    return spark.sql("SELECT doc_id, result FROM xylem_part_docs, LATERAL xpath_text(xml, '/part/name')")


def _expression_column(spark, sf_dir):
    """The expression comes from a column."""
    sql_functions.register(spark)
    docs = relational.documents(spark, sf_dir, "part")
    docs = docs.withColumn("expr", F.when(F.col("doc_id") % 2 == 0, "/part/name").otherwise("/part/brand"))
    return docs.select("doc_id", F.expr("element_at(xml_strings(xml, expr), 1)").alias("value"))


def _events_per_type(spark, sf_dir):
    found = frame(spark, sf_dir, "event").attributes("/user/event").where("name = 'type'")
    return found.groupBy("doc_id", F.col("value").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _chat_turns(spark, sf_dir):
    found = frame(spark, sf_dir, "chat").xpath_string("/conv/turn", "root")
    w = Window.partitionBy("doc_id").orderBy("pre")
    return found.select("doc_id", F.row_number().over(w).cast("long").alias("k"), "value")


def _xpath_from(spark, sf_dir):
    orders = frame(spark, sf_dir, "order")
    return orders.xpath_from(orders.xpath("//line[@flag = 'R']", "root"), "qty | ../../cust").select("doc_id", "name", "value")


def _shred(spark, sf_dir):
    columns = {"part": ("part", "bigint"), "qty": ("qty", "double"), "flag": ("@flag", "string"), "customer": ("../../cust", "bigint"), "gift": ("gift", "string"), "siblings": ("count(../line)", "int")}
    return frame(spark, sf_dir, "order").shred("//line", columns).drop("pre")


def _files_of(spark, sf_dir, kind: str, name: str) -> str:
    """A folder with a file for each document of a kind that has few."""
    path = workspace.new_path(spark, name)
    docs = relational.documents(spark, sf_dir, kind)
    docs.select(F.col("doc_id").alias("id"), "xml").repartition("id").write.partitionBy("id").text(path)
    return path


def _files(spark, sf_dir):
    docs = files.read_files(spark, _files_of(spark, sf_dir, "region", "files") + "/id=*/*.txt")
    return XmlFrame(docs).xpath_string("//nation/name").select("value")


def _records(spark, sf_dir):
    """Large files of many records, split while they are read."""
    path = workspace.new_path(spark, "records")
    relational.documents(spark, sf_dir, "order").select("xml").write.text(path)
    return XmlFrame(files.read_records(spark, path, "order")).xpath_string("//line[@flag = 'R']/qty").select("value")


def _changed(spark, sf_dir) -> DataFrame:
    """The documents of parts as they were: every third one isn't there, every second one has another text."""
    docs = relational.documents(spark, sf_dir, "part").where("doc_id % 3 > 0")
    return docs.withColumn("xml", F.when(F.col("doc_id") % 2 == 0, F.replace("xml", F.lit("<name>"), F.lit("<name>old "))).otherwise(F.col("xml")))


def _stale(spark, sf_dir):
    path = workspace.new_path(spark, "stale")
    store.write(_changed(spark, sf_dir), path)
    return store.stale(relational.documents(spark, sf_dir, "part"), path).select("doc_id")


def _refresh(spark, sf_dir):
    old, new = workspace.new_path(spark, "old"), workspace.new_path(spark, "new")
    store.write(_changed(spark, sf_dir), old)
    return store.refresh(relational.documents(spark, sf_dir, "part"), old, new).xpath_string("/part/name", "root").select("doc_id", "value")


def _load_or_write(spark, sf_dir):
    """Made, brought up to date, and loaded as it is."""
    path = workspace.new_path(spark, "kept")
    now = relational.documents(spark, sf_dir, "part")
    for docs in (_changed(spark, sf_dir), now, now):
        found = store.load_or_write(docs, path)
    return found.xpath_string("/part/name", "root").select("doc_id", "value")


def _summaries(spark, sf_dir):
    return store.summaries(spark, documents(spark, sf_dir, "order")).where(F.array_contains("tags", "line")).select("doc_id")


def _lazy_store(spark, sf_dir):
    """Documents whose summary lacks a name that the query needs aren't parsed."""
    return store.load_lazy(spark, documents(spark, sf_dir, "order")).xpath_text("//line[@flag = 'R']/qty", "root").select("doc_id", "text")


def _stream(spark, sf_dir):
    """All files there are, as a stream that ends, into a table."""
    path, out = _files_of(spark, sf_dir, "region", "arrived"), workspace.new_path(spark, "stream")
    found = streams.strings(streams.file_stream(spark, path + "/id=*/*.txt", 2), "//nation/name")
    query = found.writeStream.format("parquet").option("checkpointLocation", out + "-at").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("doc_id long, ord int, value string").parquet(out).select("value")


def _command_line(spark, sf_dir):
    """The lines that the command line prints."""
    from xylem.__main__ import main

    path, out = _files_of(spark, sf_dir, "region", "printed"), io.StringIO()
    code = main(["-H", "//nation[@key < 10]/name", path + "/id=*/*.txt"], out, spark)
    return spark.createDataFrame([(code, line) for line in out.getvalue().splitlines()], "code int, line string")


def _child_counts(spark, sf_dir):
    return frame(spark, sf_dir, "order").child_counts("/order/lines").select("doc_id", "n")


def _child_at(spark, sf_dir):
    return frame(spark, sf_dir, "part").child_at("/part", 1).select("doc_id", "name")


def _extents(spark, sf_dir):
    found = frame(spark, sf_dir, "part").extents("/part/brand")
    return found.select("doc_id", (F.col("end") - F.col("pre")).alias("below"), (F.col("end_off") - F.col("start_off")).alias("chars"))


def _itertext(spark, sf_dir):
    return frame(spark, sf_dir, "part").itertext("/part").select("doc_id", "ord", "text")


def _totals(spark, sf_dir):
    return frame(spark, sf_dir, "order").totals().drop("chars")


def _parse_errors(spark, sf_dir):
    docs = relational.documents(spark, sf_dir, "part")
    cut = F.when(F.col("doc_id") % 2 == 0, F.expr("substring(xml, 1, length(xml) - 1)")).otherwise(F.col("xml"))
    return markup.parse_errors(docs.withColumn("xml", cut)).select("doc_id", F.regexp_replace("error", r"\d+$", "").alias("error"))


def _sql_functions(spark, sf_dir):
    sql_functions.register(spark)
    docs = relational.documents(spark, sf_dir, "part")
    first = lambda f, path: F.expr(f"element_at({f}(xml, '{path}'), 1)")
    return docs.select("doc_id", first("xml_texts", "/part/name").alias("name"), first("xml_fragments", "/part/brand").alias("brand"), F.expr("xml_decode(element_at(xml_fragments(xml, '/part/type/text()'), 1))").alias("type"))


_STANDALONE = [
    ("1 div 0", "number", "Infinity"), ("-1 div 0", "number", "-Infinity"), ("0 div 0", "number", "NaN"), ("-5 mod 2", "number", "-1"), ("1 div 3", "number", "0.333333333333333"), ("1e20", "number", "1e+20"),
    ("round(-2.5)", "number", "-2"), ("floor(-1.5)", "number", "-2"), ("ceiling(1.2) * 3", "number", "6"), ("concat('a', 1, true())", "string", "a1true"), ("substring('12345', 1.5, 2.6)", "string", "234"),
    ("'a' = 'b' or 2 > 1", "boolean", "true"), ("not('x')", "boolean", "false"), ("string-length('héé')", "number", "3"), ("translate('bar', 'abc', 'AB')", "string", "BAr"), ("number('x') = number('x')", "boolean", "false"),
]


def _standalone(spark, sf_dir):
    return standalone(spark, *[x for x, _, _ in _STANDALONE])


def expressions() -> list[tuple[str, str, str]]:
    """(expression, type, value) of a public conformance suite's expressions that need no document; numbers with six significant digits."""
    with open(os.path.join(os.path.dirname(__file__), "expressions.tsv"), encoding="utf-8") as f:
        return [tuple(line.rstrip("\n").split("\t")) for line in f]


def six_digits(x: float) -> str:
    return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else f"{x + 0.0:.5e}"


def _expressions(spark, sf_dir):
    found = standalone(spark, *[x for x, _, _ in expressions()])
    number = F.col("value").try_cast("double")
    digits = F.when(F.col("value").isin("NaN", "Infinity", "-Infinity"), F.col("value")).otherwise(F.format_string("%.5e", number))
    return found.select("expr", "type", F.when(F.col("type") == "number", digits).otherwise(F.col("value")).alias("value"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decode_column(spark, sf_dir):
    """Entities replaced in a column, by expressions of the JVM alone."""
    from xylem.functions.values import decoded

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", decoded(relational.escape(F.col("text"))).alias("text"))


#: name: (query, SQL).
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "page_titles_links": (
        _titles,
        "SELECT page_id AS doc_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links FROM pages",
    ),
    "text_output": (_text_output, "SELECT page_id AS doc_id, t AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS t FROM pages) WHERE t <> ''"),
    "string_output": (_string_output, f"{_OL}SELECT o_orderkey AS doc_id, coalesce(v, '') AS value FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(part || qty, '' ORDER BY k) AS v FROM ol GROUP BY l_orderkey) ON l_orderkey = o_orderkey"),
    "raw_output": (_raw_output, f"{_OL}SELECT l_orderkey AS doc_id, '<qty>' || qty || '</qty>' AS raw FROM ol WHERE l_returnflag = 'R'"),
    "json_output": (_json_output, f"""{_OL}SELECT l_orderkey AS doc_id, '{{"matches":["' || string_agg(part, '","' ORDER BY k) || '"]}}' AS json FROM ol GROUP BY l_orderkey"""),
    "display_output": (_display_output, f"{_OL}SELECT o_orderkey AS doc_id, coalesce(v, '') AS value FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(qty, chr(10) ORDER BY k) AS v FROM ol GROUP BY l_orderkey) ON l_orderkey = o_orderkey"),
    "batch_text": (_batch_text, f"{_OL}SELECT o_orderkey AS doc_id, coalesce(v, '') AS texts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(qty, ',' ORDER BY k) AS v FROM ol GROUP BY l_orderkey) ON l_orderkey = o_orderkey"),
    "batch_count": (_batch_count, "SELECT o_orderkey AS doc_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey"),
    "batch_prefilter": (_batch_prefilter, "SELECT page_id AS doc_id, t AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS t FROM pages) WHERE t <> ''"),
    "matching_documents": (_matching, "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_quantity = 50"),
    "relative_context": (_relative_context, _lines("qty")),
    "whole_documents": (_whole_documents, "SELECT page_id AS doc_id, CAST(i - 1 AS INTEGER) AS ord, h[i] AS value FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))"),
    "doc_info_top_tags": (
        _top_tags,
        "SELECT * FROM (SELECT 'order' AS name, count(*) AS n FROM orders UNION ALL SELECT 'cust', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM orders "
        "UNION ALL SELECT 'line', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM lineitem UNION ALL SELECT 'qty', count(*) FROM lineitem)",
    ),
    "doc_summary": (
        _summary,
        "SELECT o_orderkey AS doc_id, 3 + 3 * count(l_orderkey) AS n_tags, 1 + 2 * count(l_orderkey) AS n_text, CAST(CASE WHEN count(l_orderkey) > 0 THEN 3 ELSE 1 END AS INTEGER) AS max_depth, "
        "CASE WHEN count(l_orderkey) > 0 THEN 'cust,line,lines,order,part,qty' ELSE 'cust,lines,order' END AS tag_names FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    ),
    "nav_children": (_nav_children, " UNION ALL ".join(f"SELECT p_partkey AS doc_id, '{n}' AS name, CAST({i} AS INTEGER) AS ordinal FROM part" for i, n in enumerate(("name", "brand", "type")))),
    "nav_texts": (_nav_texts, "SELECT p_partkey AS doc_id, 'name' AS name, p_name AS text, ' tail ' AS tail, p_name AS all_text FROM part"),
    "nav_attributes": (
        _nav_attributes,
        "SELECT l_orderkey AS doc_id, 'n' AS name, CAST(l_linenumber AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_orderkey, 'flag', l_returnflag FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem",
    ),
    "canonicalize": (
        _canonical,
        f"""{_OL}SELECT o_orderkey AS doc_id, '<order id="' || o_orderkey || '" priority="' || o_orderpriority || '" status="' || o_orderstatus || '"><cust>' || o_custkey || '</cust><lines>' || coalesce(v, '') || '</lines></order>' AS canonical """
        """FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('<line flag="' || l_returnflag || '" n="' || l_linenumber || '" status="' || l_linestatus || '"><part>' || part || '</part><qty>' || qty || '</qty></line>', '' ORDER BY k) AS v FROM ol GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    ),
    "udtf_xpath_text": (_udtf, "SELECT p_partkey AS doc_id, p_name AS result FROM part"),
    "expression_column": (_expression_column, "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS value FROM part"),
    "events_per_type": (_events_per_type, "SELECT user_id AS doc_id, event_type AS type, count(*) AS n FROM events GROUP BY user_id, event_type"),
    "chat_turns": (_chat_turns, "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, coalesce(text, '') AS value FROM conversations"),
    "xpath_from": (_xpath_from, "SELECT l_orderkey AS doc_id, 'qty' AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"),
    "shred_rows": (_shred, f"{_OL}SELECT l_orderkey AS doc_id, l_partkey AS part, l_quantity AS qty, l_returnflag AS flag, o_custkey AS customer, CAST(NULL AS VARCHAR) AS gift, CAST(n AS INTEGER) AS siblings FROM ol JOIN orders ON l_orderkey = o_orderkey"),
    "standalone": (_standalone, "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(x)}, '{t}', '{v}')" for x, t, v in _STANDALONE) + ") AS t(expr, type, value)"),
    "standalone_suite": (_expressions, "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(x)}, '{t}', {_quoted(v)})" for x, t, v in expressions()) + ") AS t(expr, type, value)"),
    "source_files": (_files, "SELECT n_name AS value FROM nation"),
    "source_records": (_records, f"SELECT value FROM ({_lines('qty', "l_returnflag = 'R'")})"),
    "store_stale": (_stale, "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0"),
    "store_refresh": (_refresh, _parts("p_name")),
    "store_load_or_write": (_load_or_write, _parts("p_name")),
    "store_summaries": (_summaries, "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem"),
    "store_lazy": (_lazy_store, f"SELECT doc_id, value AS text FROM ({_lines('qty', "l_returnflag = 'R'")})"),
    "stream_files": (_stream, "SELECT n_name AS value FROM nation"),
    "command_line": (_command_line, "SELECT CAST(0 AS INTEGER) AS code, n_name AS line FROM nation WHERE n_nationkey < 10"),
    "nav_child_counts": (_child_counts, "SELECT o_orderkey AS doc_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "nav_child_at": (_child_at, "SELECT p_partkey AS doc_id, 'brand' AS name FROM part"),
    "nav_extents": (_extents, "SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS below, CAST(length(p_brand) + 15 AS INTEGER) AS chars FROM part"),
    "nav_itertext": (_itertext, " UNION ALL ".join(f"SELECT p_partkey AS doc_id, CAST({i} AS INTEGER) AS ord, {x} AS text FROM part" for i, x in enumerate(("'  '", "p_name", "' tail '", "p_brand", "p_type")))),
    "info_totals": (
        _totals,
        "SELECT o AS documents, 3 * o + 3 * l AS tags, o + 2 * l AS texts, CAST(3 AS INTEGER) AS max_depth, CAST(6 AS BIGINT) AS unique_tags FROM (SELECT count(*) AS o FROM orders), (SELECT count(*) AS l FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))",
    ),
    "parse_errors": (_parse_errors, "SELECT p_partkey AS doc_id, 'tag not closed at ' AS error FROM part WHERE p_partkey % 2 = 0"),
    "sql_functions": (_sql_functions, "SELECT p_partkey AS doc_id, p_name AS name, '<brand>' || p_brand || '</brand>' AS brand, p_type AS type FROM part"),
    "decode_entities": (_decode_column, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(_xpath, kind, xpath) for k, (kind, xpath, _) in XPATHS.items()} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, _, sql) in XPATHS.items()} | {k: sql for k, (_, sql) in OTHERS.items()}
