"""The market scan: scores, reasons and rankings of every instrument; and signals of single holdings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind

LOOKBACK, LEAST_BARS = 63, 20


def _first(*rules: tuple[Column, object]) -> Column:
    """Value of the first rule that holds, else null."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))


def _points(*rules: tuple[Column, int]) -> Column:
    return F.coalesce(_first(*rules), F.lit(0))


def whole(c: Column) -> Column:
    """Rounded to a whole number, halves up, as text."""
    return F.floor(c + 0.5).cast("long").cast("string")


def tenth(c: Column) -> Column:
    return F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)


def scan_indicators(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """One row for each symbol with at least LEAST_BARS bars in the lookback."""
    df = ind.rsi(ind.numbered(ind.lookback_bars(bars, lookback)))
    df = ind.sma(df, 20)
    df = ind.volume_spike(ind.momentum(ind.sma(df, 50, F.col("ma_20"))))
    return df.where((F.col("n") == F.col("cnt")) & (F.col("cnt") >= LEAST_BARS))


# Fixed values in the three functions below: thresholds, points and texts of the rules.


def tech_rules() -> list[list[tuple[Column, int, Column]]]:
    """Groups of rules (condition, points, reason); the first that holds in each group counts."""
    rsi, p, m20, m50 = (F.col(c) for c in ("rsi", "close", "ma_20", "ma_50"))
    text = F.lit
    return [
        [(rsi < 30, 3, text("RSI oversold (<30)")), (rsi < 40, 2, text("RSI below 40")), (rsi > 70, -3, text("RSI overbought (>70)")), (rsi > 60, -2, text("RSI above 60"))],
        [((p > m20) & (m20 > m50), 2, text("Bullish MA trend")), (p > m20, 1, text("Above MA(20)")), (p < m20, -1, text("Below MA(20)"))],
        [(F.col("volume_spike"), 1, text("High volume"))],
    ]


def fund_rules() -> list[list[tuple[Column, int, Column]]]:
    pe, growth, margin = F.col("trailingPE"), F.col("earningsGrowth"), F.col("profitMargins")
    say = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    return [
        [((pe > 0) & (pe < 15), 2, say("Low P/E (", tenth(pe), ")")), ((pe >= 15) & (pe < 25), 1, say("Fair P/E (", tenth(pe), ")")), (pe > 35, -2, say("High P/E (", tenth(pe), ")"))],
        [(growth > 0.15, 2, say("Strong growth (", whole(growth * 100), "%)")), (growth > 0.05, 1, say("Positive growth (", whole(growth * 100), "%)")), (growth < -0.1, -2, say("Declining earnings (", whole(growth * 100), "%)"))],
        [(margin > 0.15, 1, say("High margins (", whole(margin * 100), "%)"))],
    ]


def momentum_rules() -> list[list[tuple[Column, int, Column]]]:
    month, week = F.col("month"), F.col("week")
    say = lambda a, c: F.concat(F.lit(a), whole(c * 100), F.lit("%)"))
    return [
        [(month > 0.15, 3, say("Strong 1M momentum (+", month)), (month > 0.05, 1, say("Positive 1M trend (+", month)), (month < -0.15, -3, say("Weak 1M momentum (", month)), (month < -0.05, -1, say("Negative 1M trend (", month))],
        [(week > 0.05, 1, say("Weekly momentum (+", week)), (week < -0.05, -1, say("Weekly decline (", week))],
    ]


def score(groups: list) -> Column:
    return reduce(lambda a, b: a + b, (_points(*[(c, v) for c, v, _ in g]) for g in groups))


def reasons(groups: list, most: int) -> Column:
    return F.slice(F.array_compact(F.array(*[_first(*[(c, r) for c, _, r in g]) for g in groups])), 1, most)


def market_scan(bars: DataFrame, quotes: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """One row a symbol: scores, total, strong flag, metrics and reasons. Quotes are one row a symbol and join after bars are reduced to one."""
    q = quotes.select("symbol", "longName", "trailingPE", "earningsGrowth", "profitMargins")
    df = scan_indicators(bars, lookback).join(q, "symbol", "left")
    tech, fund, ml = tech_rules(), fund_rules(), momentum_rules()
    df = df.withColumn("tech_score", score(tech)).withColumn("fund_score", score(fund)).withColumn("ml_score", score(ml))
    total = F.col("tech_score") + F.col("fund_score") + F.col("ml_score")
    return df.select(
        "symbol", F.substring(F.coalesce("longName", F.col("symbol").cast("string")), 1, 35).alias("name"), F.col("close").alias("price"), "tech_score", "fund_score", "ml_score", total.alias("total_score"),
        F.when(total >= 5, "BUY").when(total <= -5, "SELL").otherwise("").alias("strong"), "rsi", F.coalesce("trailingPE", F.lit(0.0)).alias("pe"),
        (F.col("week") * 100).alias("change_1w"), (F.col("month") * 100).alias("change_1m"), reasons(tech, 3).alias("tech_reasons"), reasons(fund, 2).alias("fund_reasons"), reasons(ml, 2).alias("ml_reasons"),
    )


def top_buys(scan: DataFrame, k: int = 5) -> DataFrame:
    """Best totals above 0, ranked; ties by symbol."""
    return _ranked(scan.where("total_score > 0").orderBy(F.desc("total_score"), "symbol").limit(k), True)


def top_sells(scan: DataFrame, k: int = 5) -> DataFrame:
    return _ranked(scan.where("total_score < 0").orderBy("total_score", "symbol").limit(k), False)


def _ranked(few: DataFrame, descending: bool) -> DataFrame:
    from pyspark.sql import Window

    order = F.desc("total_score") if descending else F.asc("total_score")
    return few.withColumn("rank", F.row_number().over(Window.orderBy(order, "symbol")))  # k rows


def scan_coverage(bars: DataFrame, period: str, asof: str, least: int = LEAST_BARS) -> DataFrame:
    """How many symbols a calendar lookback leaves analysable, and why others go. One scan and one aggregation."""
    inside = F.count_if(F.col("d") >= ind.first_day(period, asof))
    every = bars.groupBy("symbol").agg(F.when(inside > 0, inside).alias("cnt"))
    why = F.when(F.col("cnt").isNull(), "no_bars").when(F.col("cnt") < least, "short_history").otherwise("analysed")
    return every.groupBy(why.alias("status")).agg(F.count("*").alias("symbols"))


def signals(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Technical signal of each symbol at its quoted price; a null price gives a null signal."""
    df = ind.sma(ind.sma(ind.rsi(ind.numbered(bars)), 20), 50)
    q = quotes.select("symbol", F.coalesce("currentPrice", "regularMarketPrice").alias("price"), "trailingPE", "pegRatio", "earningsGrowth", "profitMargins")
    df = ind.latest(df).join(q, "symbol", "left")
    rsi, p, m20, m50 = (F.col(c) for c in ("rsi", "price", "ma_20", "ma_50"))
    points = _points((rsi < 40, 2), (rsi > 60, -2)) + _points((p > m20, 1)) + _points((p > m50, 1))
    s = F.col("tech_score")
    label = F.when(s >= 3, "STRONG BUY").when(s >= 1, "BUY").when(s <= -3, "STRONG SELL").when(s <= -1, "SELL").otherwise("NEUTRAL")
    return df.withColumn("tech_score", F.when(p.isNotNull(), points)).withColumn("signal", F.when(s.isNotNull(), label))


def valuation(quotes: DataFrame) -> DataFrame:
    """Valuation label; missing or zero fields earn nothing, negative ratios do."""
    good = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    points = (
        _points((good("trailingPE") & (F.col("trailingPE") < 20), 1)) + _points((good("pegRatio") & (F.col("pegRatio") < 1), 2))
        + _points((good("earningsGrowth") & (F.col("earningsGrowth") * 100 > 10), 1)) + _points((good("profitMargins") & (F.col("profitMargins") * 100 > 15), 1))
    )
    v = F.col("val_score")
    return quotes.select("symbol", points.alias("val_score")).withColumn("valuation", F.when(v >= 4, "UNDERVALUED").when(v >= 2, "FAIRLY VALUED").otherwise("OVERVALUED"))


def insights(signal_rows: DataFrame) -> DataFrame:
    """symbol and the insights that hold, from the rows of signals()."""
    rsi, pe, p, m20, m50 = (F.col(c) for c in ("rsi", "trailingPE", "price", "ma_20", "ma_50"))
    found = [
        _first((rsi < 30, F.lit("oversold")), (rsi > 70, F.lit("overbought"))),
        _first(((pe > 0) & (pe < 15), F.lit("attractive valuation")), (pe > 30, F.lit("high valuation"))),
        _first(((p > m20) & (m20 > m50), F.lit("bullish trend")), ((p < m20) & (m20 < m50), F.lit("bearish trend"))),
    ]
    return signal_rows.select("symbol", F.array_compact(F.array(*found)).alias("insights"))
