"""Market tables derived from the landed star-schema tables: bars, quotes, positions, articles, ticks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom import schemas

ASOF_NEWS = "2024-01-31 00:00:00"
LOT_KEY = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table by its declared schema, so that no file is opened to learn it, and a file that differs fails instead of changing results."""
    return spark.read.schema(schemas.LANDED[name]).parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, or setCheckpointDir); on one machine a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    base = base or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lots(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Trades: px in whole cents, so that rounded results do not depend on the engine. A first day is a filter of the Parquet scan."""
    rows = read(spark, sf_dir, "lineitem")
    rows = rows if since is None else rows.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("d"))
    return rows.withColumn("px", 100 + F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5) / 100)


def bars_from(trades: DataFrame, symbol: str, key: tuple[str, ...] = LOT_KEY) -> DataFrame:
    """Daily bars; one aggregation, combined before the shuffle."""
    order = F.struct(*key)
    return trades.groupBy(F.col(symbol).alias("symbol"), "d").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def bars_long(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    return bars_from(lots(spark, sf_dir, since), "l_suppkey")


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from(lots(spark, sf_dir), "l_partkey")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def quotes(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """One snapshot row an instrument; any field can be missing."""
    bars = bars_long(spark, sf_dir) if bars is None else bars
    back = Window.partitionBy("symbol").orderBy(F.desc("d"))
    recent = bars.withColumn("back", F.row_number().over(back)).where("back <= 252").groupBy("symbol").agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("back") == 2, F.col("close"))).alias("prev"),
        F.max(F.when(F.col("back") == 1, F.col("volume"))).alias("volume"), F.max("high").alias("fiftyTwoWeekHigh"), F.min("low").alias("fiftyTwoWeekLow"),
    )
    s = F.col("s_suppkey")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")  # 25 rows
    rows = read(spark, sf_dir, "supplier").join(recent, s == F.col("symbol"), "left").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        s.alias("symbol"), F.col("s_name").alias("longName"), _unless(s % 5 == 0, F.col("last")).alias("currentPrice"), _unless(s % 10 == 0, F.col("last")).alias("regularMarketPrice"),
        ((F.try_divide("last", "prev") - 1) * 100).alias("regularMarketChangePercent"), "volume", (F.col("s_acctbal") * 1e6).alias("marketCap"),
        _unless(s % 9 == 0, F.col("s_acctbal") / 200).alias("trailingPE"), (F.col("s_acctbal") / 1e3).alias("trailingEps"), _unless(s % 7 == 0, (s * 23 % 40) / F.lit(1e1) - 0.5).alias("pegRatio"),
        _unless(s % 11 == 0, (s * 37 % 61 - 20) / F.lit(1e2)).alias("earningsGrowth"), _unless(s % 13 == 0, (s * 17 % 41 - 10) / F.lit(1e2)).alias("profitMargins"), _unless(s % 3 == 0, (s % 6) / F.lit(1e2)).alias("dividendYield"),
        "fiftyTwoWeekHigh", "fiftyTwoWeekLow", F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), _unless(s % 8 == 0, s * 100).alias("fullTimeEmployees"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lots(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("symbol"), F.col("l_quantity").alias("shares"), F.col("px").alias("buy_price"))


def lot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of positions: a lot is put in the year it was bought, and those returned are removed in the next; with ``version``, the year."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lots(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    changes = F.array(F.struct(F.lit("put").alias("op"), F.year("d").alias("version")), F.when(F.col("l_returnflag") == "R", F.struct(F.lit("remove").alias("op"), (F.year("d") + 1).alias("version"))))
    return rows.select(
        F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("symbol"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("paid"),
        F.col("l_quantity").alias("shares"), F.col("px").alias("buy_price"), F.explode(F.array_compact(changes)).alias("c"),
    ).select("*", "c.*").drop("c")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as a careless source sends them: some prices missing, not numbers or negative, some days twice."""
    h = F.pmod(F.col("symbol") * 31 + F.datediff("d", F.lit("1970-01-01").cast("date")), F.lit(97))
    rows = bars_long(spark, sf_dir)
    spoilt = rows.withColumn("close", F.when(h == 3, None).when(h == 5, float("nan")).when(h == 7, -F.col("close")).otherwise(F.col("close"))).withColumn("high", F.when(h == 11, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(h == 13, -1.0).otherwise(F.col("volume")))
    return spoilt.unionByName(rows.where(h == 17).withColumn("close", F.col("close") + 1))


def watchlist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of watchlists, in the order of ``at``."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lots(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "add").otherwise("remove").alias("op"), F.struct("d", *LOT_KEY).alias("at"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist_log(spark, sf_dir).where("op = 'add'").select("portfolio_id", "symbol").distinct()


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_name, symbol as the index publishes it: dots in one index, dashes in the other."""
    name = F.col("p_name")
    parts = read(spark, sf_dir, "part").select("p_name").distinct()
    sp = parts.where(~name.startswith("red")).select(F.lit("sp500").alias("index_name"), F.upper(F.translate(name, " ", ".")).alias("symbol"))
    nasdaq = parts.where(name.startswith("red") | name.startswith("blue")).select(F.lit("nasdaq").alias("index_name"), F.upper(F.translate(name, " ", "-")).alias("symbol"))
    return sp.unionByName(nasdaq).distinct()


def articles(spark: SparkSession, sf_dir: str, asof: str = ASOF_NEWS) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    at = F.to_timestamp(F.lit(asof)) - F.make_interval(hours=(i % 400).cast("int"))
    return read(spark, sf_dir, "documents").select(
        i.alias("article_id"), F.substring_index(text, "\n", 1).alias("title"), F.when(i % 3 == 0, F.concat(F.lit("<p>"), text, F.lit("</p>"))).otherwise(text).alias("description"),
        F.struct(F.when(i % 19 != 0, F.col("source")).alias("name")).alias("source"),
        F.when(i % 23 == 0, "unknown").when(i % 4 == 1, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
        F.when(i % 2 == 0, "primary").otherwise("backup").alias("feed"), i.alias("pos"), "lang",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def json_list(spark: SparkSession, path: str, schema: str = schemas.POSITION_JSON, whole: bool = True) -> DataFrame:
    """Records of JSON lists, one a file, or one a line if not whole; missing, malformed or other content gives no rows."""
    try:
        text = spark.read.text(path, wholetext=whole)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    rows = text.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", schema, {"mode": "PERMISSIVE"})).alias("record"))
    return rows.select("record.*") if "struct" in schema else rows.select(F.col("record").alias("symbol"))


def write_json(df: DataFrame, path: str, by: str) -> None:
    """One JSON list of records a line for each value of ``by``, such as a portfolio. Replaces what is at path, which df must not read from."""
    records = F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c != by])))
    df.groupBy(by).agg(records.alias("value")).select("value").write.mode("overwrite").text(path)
