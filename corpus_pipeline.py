"""The corpus pipeline: STAGES, applied to documents one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.

Rows with a null text or doc_id, and those without words, pass all stages but packing, which gives no row for a text without tokens. Of repeated rows (one
doc_id, one text) one stays at the second stage. An empty table of documents gives an empty result; without labels nothing is toxic, without benchmark items
nothing is contaminated. Columns besides doc_id, text, lang, source and n_chars pass through, whatever their names, until packing drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm import decontamination, ngram_jaccard, packing, substring_dedup, toxicity
from xylem.llm.common import cut, swept, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return ngram_jaccard.keep_one_of_each_group(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated runs go; n_chars follows the text."""
    return substring_dedup.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents' tokens fill."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]
#: Alignment, the classifier and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next, and what the stage had written on its way is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = swept(cut(docs), before)
    return docs
