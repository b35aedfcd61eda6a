"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and the next stage
gets what was written. All stages but the last return the columns of documents. Stages work on all that
their predecessor kept; null and empty texts, repeated rows and empty tables pass through as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, remove, scratch, shared_path, small_side, table
from quantloom.llm.decontamination import decontaminated
from quantloom.llm.jaccard_join import jaccard_components
from quantloom.llm.line_dedup import LineIndex
from quantloom.llm.packing import pack
from quantloom.llm.quality import accepted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those labelled good, does not reject."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return accepted(docs.select(*COLUMNS), trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are in at least ten of them; n_chars follows the text."""
    found = LineIndex(spark, min_docs=10, min_chars=1).insert(docs).dedup(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; of equal rows of one id, one stays."""
    groups = jaccard_components(docs.select("doc_id", "text"), width=5, percent=80)
    gone = materialize(groups.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = docs.select(*COLUMNS).join(small_side(gone, 2_000_000), F.col("doc_id") == F.col("gone"), "left_anti")
    twice = materialize(docs.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1 and twice is not null").select("twice"), "twice")
    if twice.isEmpty():
        return left
    repeated = F.col("doc_id") == F.col("twice")
    return left.join(twice, repeated, "left_anti").unionByName(left.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word windows of benchmark items."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return pack(docs, capacity=4096, end_id=1)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The packing stage needs a tokenizer, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage writes for itself is removed at its end, and its input when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
