"""Files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import ELEMENT, Tree


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, uri, xml): one document a file, decoded as UTF-8. doc_id is a hash of the path, so it doesn't depend on the order of files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("xml"))


def record_name(spark: SparkSession, path: str) -> str:
    """The name of the first element inside the document element of the first file: usually that of its records. Only the file's beginning is read."""
    pieces = [r["value"] for r in spark.read.option("lineSep", ">").text(path).limit(1000).collect()]
    tree = Tree(">".join(pieces).rpartition(">")[0] + ">")
    names = [name for kind, depth, name in zip(tree.kind, tree.depth, tree.name) if kind == ELEMENT and depth == 2]
    if not names:
        raise ValueError(f"no element inside another at the beginning of {path}")
    return names[0]


def read_records(spark: SparkSession, path: str, record: str | None = None) -> DataFrame:
    """(doc_id, uri, xml): one document for each ``<record>`` element of files too large for one row; by default the first element's inside the document element.

    The files are split at the end tag while they are read, so that one file feeds many tasks. Records mustn't hold
    records of the same name; what stands before the first start tag in a piece is dropped.
    """
    record = record or record_name(spark, path)
    pieces = spark.read.option("lineSep", f"</{record}>").text(path)
    at = F.regexp_instr("value", F.lit(rf"<{record}(?=[\s/>])"))
    whole = F.concat(F.col("value").substr(at, F.length("value")), F.lit(f"</{record}>"))
    found = pieces.select(F.col("_metadata.file_path").alias("uri"), F.when(at > 0, whole).alias("xml"))
    found = found.where("xml is not null")
    return found.select(F.xxhash64("uri", "xml").alias("doc_id"), "uri", "xml")
