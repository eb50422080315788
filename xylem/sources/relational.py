"""XML documents made from tables: one document for each key, children in the order of a full tuple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace


def escape(c: Column) -> Column:
    """Text or attribute content; null counts as empty. Only strings can hold signs to be replaced, which is decided when the plan is made."""
    plain = out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.typeof(c) == "string", out).otherwise(plain)


def element(name: str, *content: Column, **attributes: Column) -> Column:
    """``<name attribute="...">content</name>``; ``xml_lang`` and the like write a colon for the underscore."""
    parts: list[Column] = [F.lit(f"<{name}")]
    for a, c in attributes.items():
        parts += [F.lit(f' {a.replace("_", ":")}="'), escape(c), F.lit('"')]
    return F.concat(*parts, F.lit(">"), *content, F.lit(f"</{name}>"))


def children(rows: DataFrame, key: str, order: list[str], xml: Column) -> DataFrame:
    """(key, kids): the pieces of each key's rows, sorted by ``order`` and joined."""
    grouped = rows.select(F.col(key).alias("k"), F.struct(*order, xml.alias("xml")).alias("row")).groupBy("k")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["xml"]), "").alias("kids"))


def _with_kids(parents: DataFrame, key: str, kids: DataFrame) -> DataFrame:
    return parents.join(kids, F.col(key) == F.col("k"), "left").withColumn("kids", F.coalesce("kids", F.lit("")))


def _doc(key: str, xml: Column) -> list[Column]:
    return [F.col(key).cast("long").alias("doc_id"), xml.alias("xml")]


def _text(name: str, column: str) -> Column:
    return element(name, escape(F.col(column)))


def orders(read) -> DataFrame:
    line = element("line", _text("part", "l_partkey"), element("qty", F.col("l_quantity").cast("long").cast("string")), n=F.col("l_linenumber"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"))
    kids = children(read("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"], line)
    doc = element("order", _text("cust", "o_custkey"), element("lines", F.col("kids")), id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
    return _with_kids(read("orders"), "o_orderkey", kids).select(*_doc("o_orderkey", doc))


def regions(read) -> DataFrame:
    nation = element("nation", _text("name", "n_name"), key=F.col("n_nationkey"), id=F.concat(F.lit("n"), F.col("n_nationkey")))
    kids = children(read("nation"), "n_regionkey", ["n_nationkey"], nation)
    doc = element("region", _text("name", "r_name"), F.col("kids"), key=F.col("r_regionkey"))
    return _with_kids(read("region"), "r_regionkey", kids).select(*_doc("r_regionkey", doc))


def customers(read) -> DataFrame:
    joined = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(*_doc("c_custkey", element("customer", _text("name", "c_name"), segment=F.col("c_mktsegment"), nation=F.col("n_name"))))


def parts(read) -> DataFrame:
    doc = F.concat(F.lit('<?xml version="1.0"?><?size '), F.col("p_size").cast("string"), F.lit("?>"), element("part", F.lit("  "), _text("name", "p_name"), F.lit(" tail "), F.lit("<!--"), F.col("p_partkey").cast("string"), F.lit("-->"), _text("brand", "p_brand"), _text("type", "p_type"), size=F.col("p_size")))
    return read("part").select(*_doc("p_partkey", doc))


def events(read) -> DataFrame:
    one = element("event", id=F.col("event_id"), type=F.col("event_type"))
    kids = children(read("events"), "user_id", ["event_id"], one)
    return kids.select(*_doc("k", element("user", F.col("kids"), id=F.col("k"))))


def chats(read) -> DataFrame:
    turn = element("turn", escape(F.col("text")), n=F.col("turn"), role=F.col("role"))
    kids = children(read("conversations"), "conv_id", ["turn", "role", "text"], turn)
    return kids.select(*_doc("k", element("conv", F.col("kids"), id=F.col("k"))))


def texts(read) -> DataFrame:
    return read("documents").select(*_doc("doc_id", element("doc", _text("source", "source"), _text("body", "text"), id=F.col("doc_id"), xml_lang=F.col("lang"))))


def prefixed(read) -> DataFrame:
    doc = F.concat(F.lit('<x:part xmlns:x="urn:p"><x:brand>'), escape(F.col("p_brand")), F.lit('</x:brand><y:size xmlns:y="urn:s" y:unit="cm">'), F.col("p_size").cast("string"), F.lit("</y:size></x:part>"))
    return read("part").select(*_doc("p_partkey", doc))


def pages(read) -> DataFrame:
    return read("pages").select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").alias("xml"))


KINDS = {"order": orders, "region": regions, "customer": customers, "part": parts, "event": events, "chat": chats, "text": texts, "prefixed": prefixed, "page": pages}


def documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(doc_id, xml) of one kind, from the whole tables in ``sf_dir``."""

    def read(table: str) -> DataFrame:
        workspace.spread(spark, f"{sf_dir}/{table}.parquet")
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    return KINDS[kind](read)
