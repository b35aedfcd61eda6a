"""Landed feed files: items of XML feeds, in batch or as a stream.

Files may be absent, empty, cut off or no XML at all: what can't be read gives no rows, and the rows of items that can be read in part
have the text of the item in ``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements of an item. A source is text, or a text with attributes.
ITEM = "guid string, title string, description string, pubDate string, source string, _corrupt_record string"
OPTIONS = {"rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false", "attributePrefix": "_"}


def _articles(items: DataFrame, feed: str) -> DataFrame:
    """Items as articles; an item needs a title or a description."""
    rows = items.where(F.col("title").isNotNull() | F.col("description").isNotNull())
    return rows.select(
        F.expr("try_cast(guid as bigint)").alias("article_id"), "title", "description", F.struct(F.col("source").alias("name")).alias("source"), F.col("pubDate").alias("published_at"),
        F.lit(feed).alias("feed"), "_corrupt_record",
    )


def read(spark: SparkSession, path: str, feed: str) -> DataFrame:
    try:
        items = spark.read.format("xml").options(**OPTIONS).schema(ITEM).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        items = spark.createDataFrame([], ITEM)
    return _articles(items, feed)


def read_stream(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """New files below path as they land; path must be there."""
    return _articles(spark.readStream.format("xml").options(**OPTIONS).schema(ITEM).load(path), feed)


def write(articles: DataFrame, path: str) -> None:
    """Articles as feed files."""
    items = articles.select(F.col("article_id").alias("guid"), "title", "description", F.col("published_at").alias("pubDate"), F.col("source.name").alias("source"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").mode("error").save(path)
