"""Price forecasts of all instruments: moving average, line, pooled forest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import forest as grown
from quantloom.operators import indicators as ind
from quantloom.sources.market import materialize

STEPS, HORIZONS = 30, (7, 14, 30)


def _steps(df: DataFrame) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))


def normal(seed: int, symbol: Column, step: Column) -> Column:
    """A standard normal number for each (seed, symbol, step), the same however rows are dealt out.

    Two uniform numbers from the sha256 of the three, transformed as Box and Muller do. A null symbol counts as an empty one.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(symbol.cast("string"), F.lit("")), step.cast("string")), 256)
    uniform = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") + 1) / F.lit(2.0**32 + 1)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(9))


def moving_average(bars: DataFrame, seed: int | None = None) -> DataFrame:
    """yhat is the 20-bar mean at every step, sigma one percent of the price; with a seed, noise of this deviation is added."""
    last = ind.latest(ind.sma(ind.numbered(bars), 20))
    df = _steps(last.select("symbol", F.lit("ma").alias("model"), F.col("ma_20").alias("yhat"), (F.col("close") * 0.01).alias("sigma")))
    return df if seed is None else df.withColumn("yhat", F.col("yhat") + F.col("sigma") * normal(seed, F.col("symbol"), F.col("step")))


def linear(bars: DataFrame) -> DataFrame:
    """Least squares on the bar's index, all symbols in one aggregation; a single bar stays where it is."""
    df = ind.numbered(bars).withColumn("i", (F.col("n") - 1).cast("double"))
    fit = df.groupBy("symbol").agg(F.regr_slope("close", "i").alias("slope"), F.regr_intercept("close", "i").alias("start"), F.count("*").alias("cnt"), F.max_by("close", "d").alias("last"))
    at = F.col("cnt") + F.col("step") - 1
    return _steps(fit).select("symbol", F.lit("linear").alias("model"), "step", F.coalesce(F.col("start") + F.col("slope") * at, F.col("last")).alias("yhat"))


def horizons(forecast: DataFrame, bars: DataFrame) -> DataFrame:
    """The forecast after 7, 14 and 30 steps, and its change against the last close in percent."""
    df = forecast.where(F.col("step").isin(*HORIZONS)).join(ind.last_close(bars).select("symbol", "last_close"), "symbol")
    return df.select("symbol", "model", "step", "yhat", (F.try_divide(F.col("yhat") - F.col("last_close"), F.col("last_close")) * 100).alias("change_pct"))


def chart(bars: DataFrame, forecast: DataFrame, tail: int = 60) -> DataFrame:
    """x, value, kind: the last closes, then the forecast on the same axis."""
    past = ind.lookback_bars(bars, tail).select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("d")) - 1).alias("x"), F.col("close").alias("value"), F.lit("history").alias("kind"))
    held = past.groupBy("symbol").agg(F.count("*").cast("int").alias("h"))
    ahead = forecast.join(held, "symbol").select("symbol", (F.col("h") + F.col("step") - 1).cast("int").alias("x"), F.col("yhat").alias("value"), F.lit("forecast").alias("kind"))
    return past.unionByName(ahead)


RATIOS = ("g_ma5", "g_ma10", "g_ma20", "f_rsi", "f_volume", "f_momentum")


def _scaled(df: DataFrame) -> DataFrame:
    return df.withColumns({f"g_ma{k}": F.try_divide(f"f_ma{k}", "f_prev") for k in (5, 10, 20)})


def _packed(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(RATIOS), outputCol="features", handleInvalid="skip").transform(df)


def _training_rows(bars: DataFrame, train_bars: int) -> DataFrame:
    """Features and the next close over the last, of each symbol's last bars; what a division of two of them gives is not written."""
    ready = lambda df: _scaled(df).withColumn("target", F.try_divide("label", "f_prev"))
    panel = ind.feature_panel(bars, train_bars)
    return ready(materialize(ready(panel).dropna().select(*panel.columns), "panel"))


def grow_forest(bars: DataFrame, train_bars: int = 252, trees: int = 50, depth: int = 10, seed: int = 42) -> tuple[grown.Forest, DataFrame]:
    """The model of the next close over the last, and the feature rows it was grown on."""
    rows = _training_rows(bars, train_bars)
    return grown.grow(rows, RATIOS, "target", [F.col("symbol"), F.col("d")], trees, depth, seed), rows


def fit_forest(bars: DataFrame, train_bars: int = 252, trees: int = 50, depth: int = 10, seed: int = 42):
    """As grow_forest(), by MLlib, whose trees depend on how rows are dealt out.

    MLlib keeps each row's count of draws for each tree and its place in it, about 800 bytes a row, so this is for tables that fit the memory of all executors.
    """
    from pyspark.ml.regression import RandomForestRegressor

    rows = _training_rows(bars, train_bars)
    return RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True).fit(_packed(rows)), rows


def roll_out(model, rows: DataFrame, start: str = "observed", noise: int | None = None, deviation: float = 0.015) -> DataFrame:
    """symbol, model, step, yhat: thirty steps from each symbol's last row.

    With a seed for noise, each step adds normal numbers of so many times the last close, and goes on from there.
    """
    now = ind.latest(rows).select("symbol", "f_prev", "f_ma5", "f_ma10", "f_ma20", "f_rsi", "f_volume", "f_momentum", "label", (F.col("label") * deviation).alias("sigma"))
    if start == "next":
        now = now.withColumns({"f_prev": F.col("label"), **{f"f_ma{k}": (F.col(f"f_ma{k}") * (k - 1) + F.col("label")) / k for k in (5, 10, 20)}})
    now = now.withColumn("path", F.array().cast("array<double>")).drop("label")
    keep = now.columns
    for step in range(1, STEPS + 1):
        out = model.transform(_packed(_scaled(now))).withColumn("yhat", F.col("prediction") * F.col("f_prev"))
        if noise is not None:
            out = out.withColumn("yhat", F.col("yhat") + F.col("sigma") * normal(noise, F.col("symbol"), F.lit(step)))
        now = out.withColumns({"path": F.array_append("path", F.col("yhat")), "f_prev": F.col("yhat"), **{f"f_ma{k}": (F.col(f"f_ma{k}") * (k - 1) + F.col("yhat")) / k for k in (5, 10, 20)}}).select(*keep)
        if step % 5 == 0:
            now = materialize(now, "rollout")
    return now.select("symbol", F.lit("forest").alias("model"), F.posexplode("path").alias("step", "yhat")).withColumn("step", F.col("step") + 1)


def forest(bars: DataFrame, train_bars: int = 252, trees: int = 50, depth: int = 10, seed: int = 42, start: str = "observed", noise: int | None = None) -> DataFrame:
    """One forest for all symbols, on features free of scale, rolled out for 30 steps.

    Prices are divided by the close before, and the predicted ratio is multiplied back. A step replaces the
    close and updates the means as if the prediction had been observed; the other features stay. start
    'observed' begins at the features of the last bar, 'next' at those after it. noise as in roll_out().
    """
    return roll_out(*grow_forest(bars, train_bars, trees, depth, seed), start, noise)
