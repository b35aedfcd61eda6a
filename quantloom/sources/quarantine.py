"""Bars that cannot be used, set apart with the rules they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

PRICES = ("open", "high", "low", "close")


def rules() -> dict[str, Column]:
    """Name of each rule, and what holds where it is broken."""
    any_of = lambda f: F.coalesce(F.greatest(*[f(F.col(c)).cast("int") for c in PRICES]) == 1, F.lit(False))
    return {
        "no symbol or day": F.col("symbol").isNull() | F.col("d").isNull(),
        "missing price": any_of(lambda c: c.isNull() | F.isnan(c)),
        "price not positive": any_of(lambda c: (c <= 0) & ~F.isnan(c)),
        "high below low": F.coalesce((F.col("high") < F.col("low")) & ~F.isnan("high") & ~F.isnan("low"), F.lit(False)),
        "bad volume": F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") < 0),
    }


def checked(bars: DataFrame) -> DataFrame:
    """bars with ``broken``, the names of the rules that each row breaks.

    Of the rows of a symbol and day that break none, the first in order of all their values stays, whatever the order of arrival; others are 'repeated day'.
    Rows that are equal in all values are told apart by nothing, so it does not matter which stays.
    """
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules().items()]))
    rows = bars.withColumn("broken", found)
    values = F.struct(F.size("broken") > 0, *[F.col(c) for c in (*PRICES, "volume")])
    first = F.row_number().over(Window.partitionBy("symbol", "d").orderBy(values))
    return rows.withColumn("_k", first).withColumn("broken", F.when((F.col("_k") > 1) & (F.size("broken") == 0), F.array(F.lit("repeated day"))).otherwise(F.col("broken"))).drop("_k")


def observed(rows: DataFrame, name: str = "bars") -> tuple[DataFrame, Observation]:
    """rows of checked(), and an observation of how many there are, are clean, and break each rule; it is filled by the first action on them."""
    seen = Observation(name)
    counts = [F.count_if(F.array_contains("broken", r)).alias(r) for r in (*rules(), "repeated day")]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") == 0).alias("clean"), *counts), seen


def clean(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("broken") == 0).drop("broken")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("broken") > 0)
