"""A stored node table: parsed once, then queried with column pruning and filters pushed into the scan.

Layout: ``nodes/`` (Parquet, sorted by doc_id and pre within files), ``docs/`` (doc_id, xml, tags) and ``manifest/`` (doc_id,
hash of the text, version). A document whose hash differs is stale. ``tags`` is the summary of a document, the names that may be those of its
tags: a scan of that column alone tells which documents a query can pass over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators.frame import XmlFrame, distinct_docs

from . import markup, workspace

VERSION = 2
#: Documents in a file, at most: parsing takes far longer than reading, so its tasks shouldn't be few.
FILE_DOCS = 10_000


def write(docs: DataFrame, path: str) -> XmlFrame:
    """Parse and store documents; returns the stored ones. Of several texts with one doc_id the first in order counts."""
    spark = docs.sparkSession
    _write(docs, path, "errorifexists")
    return load(spark, path)


def _write_docs(docs: DataFrame, path: str, mode: str) -> None:
    plain = markup.docs_of(docs)
    plain.withColumn("tags", markup.tag_names("xml")).write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", FILE_DOCS).parquet(f"{path}/docs")


def _stored_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, xml string, tags array<string>").parquet(f"{path}/docs")


def _write_manifest(docs: DataFrame, path: str, mode: str) -> None:
    manifest = docs.select("doc_id", F.xxhash64("xml").alias("hash"), F.lit(VERSION).alias("version"))
    manifest.write.mode(mode).option("compression", "zstd").parquet(f"{path}/manifest")


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Store documents and their summaries alone, for ``load_lazy`` and ``summaries``; returns the stored ones."""
    spark = docs.sparkSession
    _write_docs(docs, path, mode)
    stored = _stored_docs(spark, path)
    # the ids alone are looked at, in what is written: documents aren't made twice
    if not stored.groupBy("doc_id").count().where("count > 1").isEmpty():
        _write_docs(distinct_docs(docs), path, "overwrite")
    return stored


def _write(docs: DataFrame, path: str, mode: str) -> None:
    stored = write_documents(docs, path, mode)
    markup.write(stored, f"{path}/nodes", mode)
    _write_manifest(stored, path, mode)


def load(spark: SparkSession, path: str) -> XmlFrame:
    """The stored documents and their nodes, as an XmlFrame."""
    workspace.spread(spark, f"{path}/nodes")
    return XmlFrame(_stored_docs(spark, path).select("doc_id", "xml"), markup.read(spark, f"{path}/nodes"))


def load_lazy(spark: SparkSession, path: str) -> XmlFrame:
    """The stored documents alone: each query parses those whose summary it can't pass over."""
    return XmlFrame(_stored_docs(spark, path), tags=True)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tags): the summary of each stored document; neither texts nor nodes are read."""
    return _stored_docs(spark, path).select("doc_id", "tags")


def stale(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, xml) of documents that the store lacks or has with another text or an older version."""
    spark = docs.sparkSession
    known = spark.read.parquet(f"{path}/manifest").select(F.col("doc_id").alias("m_id"), "hash", "version")
    now = distinct_docs(docs)
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.xxhash64("xml") == F.col("hash")) & (F.col("version") == VERSION)
    return now.join(known, same, "left_anti")


def refresh(docs: DataFrame, path: str, new_path: str) -> XmlFrame:
    """A store of exactly ``docs`` at ``new_path``; only stale documents are parsed again, the others' nodes are taken over."""
    spark = docs.sparkSession
    changed = stale(docs, path)
    now = distinct_docs(docs)
    kept = now.join(changed.select(F.col("doc_id").alias("c_id")), F.col("doc_id").eqNullSafe(F.col("c_id")), "left_anti")
    old = markup.read(spark, f"{path}/nodes")
    taken = old.join(kept.select(F.col("doc_id").alias("k_id")), F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    _write_docs(now, new_path, "errorifexists")
    taken.unionByName(markup.parse(changed)).write.option("compression", "zstd").parquet(f"{new_path}/nodes")
    _write_manifest(now, new_path, "errorifexists")
    return load(spark, new_path)


def load_or_write(docs: DataFrame, path: str) -> XmlFrame:
    """The store at ``path``, made where there is none. Of stale documents, new or changed ones, only their nodes are made anew; the store then has exactly ``docs``.

    The new store is written beside the old one, which gives way when it is whole.
    """
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(f"{path}/manifest/_SUCCESS")):
        _write(docs, path, "overwrite")
    elif not stale(docs, path).isEmpty():
        fresh, old = (f"{path.rstrip('/')}-{uuid.uuid4().hex}" for _ in range(2))
        refresh(docs, path, fresh)
        if not (fs.rename(at(path), at(old)) and fs.rename(at(fresh), at(path))):
            raise OSError(f"{fresh} can't take the place of {path}")
        fs.delete(at(old), True)
    return load(spark, path)
