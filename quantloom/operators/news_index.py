"""An inverted index of articles, for searches that come again.

Two tables below a path: ``postings`` (term, pos, article_id, feed, n, rest) in folders by a hash of the term and sorted by term, so that a search reads the folders
of its terms and of these only the row groups that may hold them; and ``articles`` (what scoring needs, without the text) in folders by a hash of
the id. A search meets postings only until its first 3 * count articles are known; these few are then looked up by id. For the most similar articles of all
that match, postings give an upper bound of each similarity, and only articles whose bound reaches the k-th score are looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import news

POSTING = "term string, pos long, article_id long, feed string, n long, rest double, bucket int"
ARTICLE = f"article_id long, pos long, feed string, title string, published_at string, ta {news.TERMS}, bucket int"
BUCKETS = 64
#: A search whose first articles are this few names their folders in the plan.
FEW_IDS = 10_000
#: Queries of up to so many terms leave at least as many of an article's most frequent terms among those that count.
SURE_TERMS = news.MAX_TERMS // 2


def _bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def write(articles: DataFrame, path: str, mode: str = "error") -> None:
    """Index articles (article_id, pos, feed, title, description, published_at); with mode 'append' further ones, whose ids must be new.

    A posting list is spread over as many tasks as adaptive execution sees fit, as no task must hold all of a frequent term.
    """
    rows = news.counted(articles)
    rows = rows.withColumn("rest", F.aggregate(F.slice("ta", 1, SURE_TERMS), F.lit(0.0), lambda s, t: s + t["n"] * t["n"]))
    each = rows.select("pos", "article_id", "feed", "rest", F.explode_outer("terms").alias("t")).where("t is not null").select("t.term", "pos", "article_id", "feed", "t.n", "rest").withColumn("bucket", _bucket(F.col("term")))
    each.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "pos").write.partitionBy("bucket").mode(mode).parquet(f"{path}/postings")
    kept = rows.select("article_id", "pos", "feed", "title", "published_at", "ta").withColumn("bucket", _bucket(F.col("article_id")))
    kept.hint("rebalance", "bucket").sortWithinPartitions("bucket", "article_id").write.partitionBy("bucket").mode(mode).parquet(f"{path}/articles")


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of terms; their folders are literals of the plan."""
    folders = [r.b for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")).alias("b")).distinct().collect()]
    return spark.read.schema(POSTING).parquet(f"{path}/postings").where(F.col("bucket").isin(folders) & F.col("term").isin(terms))


def matched(spark: SparkSession, path: str, queries: news.Queries, feed: str | None = None) -> DataFrame:
    """One row for each query and article that share a term, from postings only: the query's fields, pos, rest, and has, the shared terms."""
    terms = sorted({t for q, _ in queries for t in news.query_terms(q)})
    found = postings(spark, path, terms)
    found = found if feed is None else found.where(F.col("feed") == feed)
    wanted = news.asked(found, queries, lambda q: F.array_contains(F.transform(q["tq"], lambda t: t["term"]), F.col("term")))
    # A query's postings become one row an article: its terms are few, so their list is short.
    fields = [F.first(c).alias(c) for c in ("count", "keywords", "tq", "pos", "rest")]
    return wanted.groupBy("query", "article_id").agg(*fields, F.collect_list(F.struct("term", "n")).alias("has"))


def _with_terms(first: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches with what scoring needs of their articles."""
    names = lambda c: F.transform(c, lambda t: t["term"])
    both = F.concat(F.col("ta"), F.filter("has", lambda t: ~F.array_contains(names("ta"), t["term"])))
    return first.drop("pos", "rest").join(rows.drop("bucket"), "article_id").withColumn("ta", both).drop("has")


def searched(spark: SparkSession, path: str, queries: news.Queries, feed: str | None = None) -> DataFrame:
    """As news.searched, from the index."""
    first = news.first_rows(matched(spark, path, queries, feed), queries, 3)
    rows = spark.read.schema(ARTICLE).parquet(f"{path}/articles")
    if sum(3 * n for _, n in queries) <= FEW_IDS:
        from quantloom.sources.market import materialize

        first = materialize(first, "found")
        ids = [r.article_id for r in first.select("article_id").distinct().collect()]  # at most 3 * count a query
        folders = [r.b for r in spark.createDataFrame([(i,) for i in ids], "id long").select(_bucket(F.col("id")).alias("b")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(folders) & F.col("article_id").isin(ids))
    return _with_terms(first, rows)


def bound() -> Column:
    """No less than the similarity of a match, from its posting rows.

    With x the squares of an article's counts of shared terms, the cosine is at most sqrt(x) over the article's norm. At least SURE_TERMS of its most frequent
    terms count, and any that is not shared has weight ln(1.5) + 1; so the norm is at least sqrt(x + weight ** 2 * (rest - x)). This grows with x.
    """
    x = F.aggregate("has", F.lit(0.0), lambda s, t: s + t["n"] * t["n"])
    other = (math.log(1.5) + 1) ** 2 * F.greatest(F.col("rest") - x, F.lit(0.0))
    return F.when(F.size("tq") <= SURE_TERMS, F.sqrt(x / (x + other))).otherwise(1.0)


def most_similar(spark: SparkSession, path: str, queries: news.Queries, feed: str | None = None) -> DataFrame:
    """query, rank, article_id, similarity: of all matches the ``count`` most similar, ties by id; the same as if all pairs were scored.

    First the 2 * count matches of the largest bounds are scored. The k-th of these scores is a floor, and of all other matches those whose bound reaches it.
    """
    from quantloom.sources.market import materialize

    found = materialize(matched(spark, path, queries, feed).withColumn("bound", bound()), "matched")
    rows = spark.read.schema(ARTICLE).parquet(f"{path}/articles")
    score = lambda df: _with_terms(df, rows).select("query", "count", "article_id", F.round(news.cosine(F.col("ta"), F.col("tq")), 9).alias("similarity"))
    ordered = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
    ranked = found.withColumn("_k", ordered(F.desc("bound"), "article_id"))
    sure = materialize(score(ranked.where(F.col("_k") <= 2 * F.col("count")).drop("_k", "bound")), "sure")
    floors = sure.withColumn("_k", ordered(F.desc("similarity"), "article_id")).where(F.col("_k") == F.col("count")).select("query", (F.col("similarity") - 1e-9).alias("floor"))
    # At most MAX_QUERIES rows; a query without a k-th score needs no more matches, as it has had all.
    more = found.join(F.broadcast(floors), "query").where("bound >= floor").join(sure.select("query", "article_id"), ["query", "article_id"], "left_anti").drop("floor", "bound")
    best = sure.unionByName(score(more)).where("similarity > 0").withColumn("rank", ordered(F.desc("similarity"), "article_id"))
    return best.where(F.col("rank") <= F.col("count")).select("query", "rank", "article_id", "similarity")


def top_relevant(spark: SparkSession, path: str, queries: news.Queries, asof: str, feed: str | None = None) -> DataFrame:
    """As news.top_relevant, from the index."""
    return news.best(searched(spark, path, queries, feed), asof)
