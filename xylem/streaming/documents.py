"""XPath over streams of documents. Evaluation is a map over each document: no state, no watermark, exactly what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators.frame import strings_per_document
from xylem.sources import markup


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(doc_id, xml) of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.decode("content", "UTF-8").alias("xml"))


def strings(docs: DataFrame, xpath: str, context: str = "element") -> DataFrame:
    """(doc_id, ord, value) for each document of the stream."""
    return strings_per_document(docs, xpath, context)


def nodes(docs: DataFrame) -> DataFrame:
    """The node table of a stream, to be appended to a stored one."""
    return markup.parse(docs)
