"""Portfolio valuation, watchlists, universe and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import substring


def price(default: Column) -> Column:
    return F.coalesce("currentPrice", "regularMarketPrice", default)


def valued(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Positions with price, value, cost, gain and gain in percent.

    A position whose quote has no price is valued at its buying price; one without any quote row is shown at
    cost and marked as not counted.
    """
    q = quotes.select("symbol", "currentPrice", "regularMarketPrice").withColumn("counted", F.lit(True))
    df = positions.where("shares >= 0.001").join(q, "symbol", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
    df = df.withColumn("price", price(F.col("buy_price"))).withColumn("value", F.col("price") * F.col("shares")).withColumn("cost", F.col("buy_price") * F.col("shares"))
    gain = F.col("value") - F.col("cost")
    return df.withColumn("gain", gain).withColumn("gain_pct", F.when(F.col("cost") > 0, gain / F.col("cost") * 100).otherwise(0.0)).drop("currentPrice", "regularMarketPrice")


def totals(rows: DataFrame) -> DataFrame:
    """One row a portfolio over its counted positions."""
    df = rows.where("counted").groupBy("portfolio_id").agg(F.sum("value").alias("value"), F.sum("cost").alias("cost"))
    gain = F.col("value") - F.col("cost")
    return df.withColumn("gain", gain).withColumn("gain_pct", F.when(F.col("cost") > 0, gain / F.col("cost") * 100).otherwise(0.0))


def counts(positions: DataFrame, watchlist: DataFrame) -> DataFrame:
    a = positions.groupBy("portfolio_id").agg(F.count("*").alias("positions"))
    b = watchlist.groupBy("portfolio_id").agg(F.count("*").alias("watched"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return a.join(b, "portfolio_id", "full").select("portfolio_id", zero("positions"), zero("watched"))


def holdings_filter(positions: DataFrame, query: str) -> DataFrame:
    """Positions whose symbol holds the text, case aside."""
    return positions.where(F.upper(F.col("symbol").cast("string")).contains(query.upper()))


def watchlist_state(log: DataFrame) -> DataFrame:
    """Current members from a log (portfolio_id, symbol, op, at)."""
    last = log.groupBy("portfolio_id", "symbol").agg(F.max_by("op", "at").alias("op"))
    return last.where("op = 'add'").select("portfolio_id", "symbol")


def watched(positions: DataFrame, watchlist: DataFrame, member: bool = True) -> DataFrame:
    return positions.join(watchlist, ["portfolio_id", "symbol"], "left_semi" if member else "left_anti")


def universe(constituents: DataFrame, fallback: list[tuple[str, str]], popular: list[str]) -> DataFrame:
    """Distinct symbols of all indexes and popular ones; an index without rows takes those of the fallback."""
    spark = constituents.sparkSession
    static = spark.createDataFrame(fallback, "index_name string, symbol string")
    rows = constituents.unionByName(static.join(constituents.select("index_name").distinct(), "index_name", "left_anti"))
    fixed = F.when(F.col("index_name") == "sp500", F.translate("symbol", ".", "-")).otherwise(F.col("symbol"))
    return rows.select(fixed.alias("symbol")).unionByName(spark.createDataFrame([(s,) for s in popular], "symbol string")).distinct()


def symbol_search(symbols: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query, rank, symbol: the first k symbols in order that hold each query; none for an empty query."""
    q = queries.select("query", F.upper(F.trim("query")).alias("_q")).where("_q <> ''")
    found = substring.holding(symbols.select("symbol"), "symbol", q.select("_q"), "_q").join(q, "_q")
    order = Window.partitionBy("query").orderBy("symbol")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "symbol")


def symbol_resolve(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """query, symbol: the first match, else the query itself in upper case."""
    first = symbol_search(symbols, queries, 1).select("query", F.col("symbol").alias("found"))
    return queries.select("query").distinct().join(first, "query", "left").select("query", F.coalesce("found", F.upper("query")).alias("symbol"))
