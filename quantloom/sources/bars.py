"""Stored daily bars: written once, in a folder a month, with a fixed schema; scans read the months they need.

Beside the bars, ``depth`` tells how many bars each symbol has in each month: a small table from which a scan for the last k bars of every symbol learns how far
back it must read. Symbols that have ceased to trade must be read further back than others; only their months are, not all months since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.schemas import BARS

#: Months that a scan reads whole, for all symbols; what older ones hold is read for single symbols.
RECENT_MONTHS = 6


def month(d: Column) -> Column:
    """yyyymm as a number."""
    return (F.year(d) * 100 + F.month(d)).cast("int")


def _numbered(month: Column) -> Column:
    """Months since year 0."""
    return F.floor(month / 100) * 12 + month % 100


def write(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write bars (symbol, d, open, high, low, close, volume). With mode 'append' whole new months.

    A month's rows are dealt by folder and split where adaptive execution finds them large; within a file they are sorted by symbol.
    """
    rows = bars.select(*[F.col(c) for c in ("symbol", "d", "open", "high", "low", "close", "volume")], month(F.col("d")).alias("month"))
    rows.hint("rebalance", "month").sortWithinPartitions("month", "symbol", "d").write.partitionBy("month").mode(mode).parquet(f"{path}/bars")
    stored = read(bars.sparkSession, path)
    if mode == "append":
        known = [r.month for r in bars.sparkSession.read.parquet(f"{path}/depth").select("month").distinct().collect()]  # one a month
        stored = stored.where(~F.col("month").isin(known))
    stored.groupBy("symbol", "month").agg(F.count("*").alias("n")).write.mode(mode).parquet(f"{path}/depth")


def read(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The bars from a day on; its month is a partition filter, the day itself a filter of the Parquet scan."""
    df = spark.read.schema(BARS).parquet(f"{path}/bars")
    if since is None:
        return df
    first = spark.range(1).select(month(F.to_date(F.lit(since)))).first()[0]
    return df.where((F.col("month") >= first) & (F.col("d") >= F.to_date(F.lit(since))))


def since(period: str, asof: str, spark: SparkSession) -> str:
    """The first day of a calendar lookback (1mo, 3mo, 6mo, 1y, 5y)."""
    return str(spark.range(1).select(ind.first_day(period, asof)).first()[0])


def lookback(spark: SparkSession, path: str, period: str, asof: str) -> DataFrame:
    """As ind.lookbacks() of one period; for 5d the last five bars of each symbol."""
    rows = last(spark, path, 5) if period == "5d" else read(spark, path, since(period, asof, spark))
    return rows.drop("month").select(F.lit(period).alias("period"), "*")


def last(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The last k bars of each symbol, as ind.lookback_bars()."""
    depth = spark.read.schema("symbol long, n long, month int").parquet(f"{path}/depth")
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = depth.withColumn("_newer", newer).where(F.col("_newer") < k).select("symbol", "month")
    newest = depth.agg(F.max(_numbered(F.col("month")))).first()[0]
    if newest is None:
        return read(spark, path)
    old = needed.where(_numbered(F.col("month")) <= newest - RECENT_MONTHS)
    from quantloom.sources.market import materialize

    old = materialize(old, "older-months")
    months = sorted(r.month for r in old.select("month").distinct().collect())  # at most the months there are
    edge = newest - RECENT_MONTHS + 1
    first = (edge - 1) // 12 * 100 + (edge - 1) % 12 + 1
    bars = read(spark, path)
    rows = bars.where(F.col("month") >= first)
    if months:
        rows = rows.unionByName(bars.where(F.col("month").isin(months)).join(old, ["symbol", "month"], "left_semi").select(*bars.columns))
    return ind.lookback_bars(rows, k)
