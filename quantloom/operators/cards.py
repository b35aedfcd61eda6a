"""Instrument cards and the ticker strip: typed columns first, text last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "N/A"


def billions(c: Column) -> Column:
    """Market value in billions with two decimals, halves up, from a billion on."""
    v = F.floor(c / 1e7 + 0.5)
    return F.when(c > 1e9, F.concat(F.lit("$"), F.format_string("%.2f", v / 100), F.lit("B"))).otherwise(MISSING)


def grouped(c: Column) -> Column:
    return F.format_number(c, 0)


def instrument_card(quotes: DataFrame) -> DataFrame:
    """The nine statistics and the fundamentals of each instrument."""
    return quotes.select(
        "symbol", F.coalesce("currentPrice", "regularMarketPrice").alias("price"), billions(F.col("marketCap")).alias("market_cap"),
        F.when(F.col("trailingPE") != 0, F.col("trailingPE")).alias("pe"), F.col("trailingEps").alias("eps"), (F.col("dividendYield") * 100).alias("dividend_pct"),
        F.col("fiftyTwoWeekHigh").alias("high_52w"), F.col("fiftyTwoWeekLow").alias("low_52w"), F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("sector", F.lit(MISSING)).alias("sector"), F.substring(F.coalesce("industry", F.lit(MISSING)), 1, 25).alias("industry"),
        F.when(F.col("fullTimeEmployees") > 0, grouped(F.col("fullTimeEmployees"))).otherwise(MISSING).alias("employees"),
    )


def ticker_strip(quotes: DataFrame, symbols: list) -> DataFrame:
    """Price and change of a fixed list of symbols."""
    change = F.coalesce("regularMarketChangePercent", F.lit(0.0))
    return quotes.where(F.col("symbol").isin(symbols)).select(
        "symbol", F.coalesce("currentPrice", "regularMarketPrice", F.lit(0.0)).alias("price"), F.abs(change).alias("change_abs"), F.when(change >= 0, "up").otherwise("down").alias("direction")
    )
