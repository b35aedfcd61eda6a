"""Technical indicators of all instruments at once.

Each function takes bars (symbol, d, close, volume, ...) and adds columns. All share one partitioning and
order, (symbol, d), so a chain of them needs one exchange. A bar's ``n`` is its number within the symbol, ``cnt`` the
symbol's number of bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def last_rows(k: int, before: int = 0) -> Window:
    """The k bars that end ``before`` bars ago."""
    return by_symbol().rowsBetween(-(k - 1) - before, -before)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("n", F.row_number().over(by_symbol())).withColumn("cnt", F.count("*").over(Window.partitionBy("symbol")))


def lookback_bars(bars: DataFrame, k: int) -> DataFrame:
    """The last k bars of each symbol; filtered before any shuffle of the rest."""
    back = Window.partitionBy("symbol").orderBy(F.desc("d"))
    return bars.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= k).drop("_back")


#: Calendar lookbacks.
MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "5y": 60}


def first_day(period: str, asof: str) -> Column:
    return F.add_months(F.to_date(F.lit(asof)), -MONTHS[period])


def lookbacks(bars: DataFrame, periods: list[str], asof: str) -> DataFrame:
    """period and the bars of each period before asof: 5d (five bars), 1mo, 3mo, 6mo, 1y, 5y. One pass for all periods."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    since = lambda p: back <= 5 if p == "5d" else F.col("d") >= first_day(p, asof)
    held = F.array_compact(F.array(*[F.when(since(p), p) for p in periods]))
    return bars.withColumn("_held", held).withColumn("period", F.explode("_held")).drop("_held")


def rsi(bars: DataFrame, period: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength from plain means; 50 while short of history, 100 without losses (a flat series too)."""
    change = F.col("close") - F.lag("close").over(by_symbol())
    df = bars.withColumn("_change", change)
    mean = lambda c: F.avg(F.greatest(c, F.lit(0.0))).over(last_rows(period))
    df = df.withColumn("_gain", mean(F.col("_change"))).withColumn("_loss", mean(-F.col("_change")))
    value = F.when(F.col("n") < period + 1, 50.0).when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return df.withColumn(out, value).drop("_change", "_gain", "_loss")


def sma(bars: DataFrame, k: int, fallback: Column | None = None, of: str = "close", out: str | None = None) -> DataFrame:
    """Mean of the last k bars; the fallback (by default the last value) while there are fewer."""
    rest = F.col(of) if fallback is None else fallback
    return bars.withColumn(out or f"ma_{k}", F.when(F.col("n") >= k, F.avg(of).over(last_rows(k))).otherwise(rest))


def bollinger(bars: DataFrame, k: int = 20, width: float = 2.0) -> DataFrame:
    """bb_lower, bb_mid, bb_upper with the population deviation; all the last close while short of history."""
    frame = last_rows(k)
    mid, dev = F.avg("close").over(frame), F.stddev_pop("close").over(frame)
    pick = lambda c: F.when(F.col("n") >= k, c).otherwise(F.col("close"))
    return bars.withColumn("bb_lower", pick(mid - width * dev)).withColumn("bb_mid", pick(mid)).withColumn("bb_upper", pick(mid + width * dev))


def momentum(bars: DataFrame) -> DataFrame:
    """week and month: change against the bar 4 and 19 back, 0 while there is none."""
    change = lambda k: F.when(F.col("n") > k, F.try_divide(F.col("close") - F.lag("close", k).over(by_symbol()), F.lag("close", k).over(by_symbol()))).otherwise(0.0)
    return bars.withColumn("week", change(4)).withColumn("month", change(19))


def volume_spike(bars: DataFrame, k: int = 10, times: float = 1.5) -> DataFrame:
    return sma(bars, k, F.col("volume"), "volume", "avg_volume").withColumn("volume_spike", F.col("volume") > F.col("avg_volume") * times)


def _ordered_closes(bars: DataFrame) -> DataFrame:
    """One row a symbol with its closes in order; a symbol's history is bounded by its trading days."""
    return bars.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "close"))), lambda x: x["close"]).alias("closes"))


def ema_latest(bars: DataFrame, span: int = 12) -> DataFrame:
    """Exponential mean at the last bar, from the first close on."""
    a = 2.0 / (span + 1)
    fold = F.aggregate(F.slice("closes", 2, F.greatest(F.size("closes") - 1, F.lit(1))), F.col("closes")[0], lambda e, x: (1 - a) * e + a * x)
    return _ordered_closes(bars).select("symbol", F.when(F.size("closes") > 1, fold).otherwise(F.col("closes")[0]).alias("ema"))


def macd_latest(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal, macd_hist at the last bar; zeros with fewer than ``slow`` bars. One fold over the closes."""
    af, as_, ag = (2.0 / (k + 1) for k in (fast, slow, signal))

    def step(s: Column, x: Column) -> Column:
        f, w = s["f"] * (1 - af) + x * af, s["s"] * (1 - as_) + x * as_
        return F.struct(f.alias("f"), w.alias("s"), (s["g"] * (1 - ag) + (f - w) * ag).alias("g"))

    first = F.col("closes")[0]
    state = F.aggregate("closes", F.struct(first.alias("f"), first.alias("s"), F.lit(0.0).alias("g")), step)
    line, mark = F.col("m.f") - F.col("m.s"), F.col("m.g")
    long = F.size("closes") >= slow
    pick = lambda c: F.when(long, c).otherwise(0.0)
    return _ordered_closes(bars).withColumn("m", state).select("symbol", pick(line).alias("macd"), pick(mark).alias("macd_signal"), pick(line - mark).alias("macd_hist"))


#: Days of a block of the recursive panels.
BLOCK_DAYS = 32


def _maps(x: str, keep: float, out: str) -> dict[str, Column]:
    """<out>_a and <out>_b of each bar: the mean after it is a * (the mean before its block) + b.

    A bar is the map e -> keep * e + (1 - keep) * x. A block has at most BLOCK_DAYS of them, so their composition is a sum over the block with weights
    that stay in range.
    """
    block = Window.partitionBy("symbol", "_block").orderBy("d")
    k = F.row_number().over(block)
    power = F.pow(F.lit(keep), k)
    return {f"{out}_a": power, f"{out}_b": power * F.sum(F.col(x) * (1 - keep) / power).over(block)}


def _composed(blocks: DataFrame, keeps: dict[str, float]) -> DataFrame:
    """blocks: symbol, _block, and the maps <out>_a and <out>_b of whole blocks; adds <out>_in, the mean before each block; the first one starts at <out>_0.

    Each round puts to a block's map the one of twice as many blocks before it, for all means at once. A mean's rounds end when the factor of so many bars is 0 in
    double precision, as further ones would change nothing, however long the history.
    """
    order = Window.partitionBy("symbol").orderBy("_block")
    # The first block of a symbol has no mean before it but its first value.
    first = F.lag("_block").over(order).isNull()
    starts = {f"{out}_b": F.when(first, F.col(f"{out}_a") * F.col(f"{out}_0") + F.col(f"{out}_b")).otherwise(F.col(f"{out}_b")) for out in keeps}
    blocks = blocks.withColumns(starts | {f"{out}_a": F.when(first, 0.0).otherwise(F.col(f"{out}_a")) for out in keeps})
    step, open_ = 1, list(keeps)
    while open_:
        before = lambda c: F.lag(c, step).over(order)
        factor = lambda out, c: F.coalesce(F.col(f"{out}_a") * before(c), F.lit(0.0))
        blocks = blocks.withColumns({f"{out}_a": factor(out, f"{out}_a") for out in open_} | {f"{out}_b": F.col(f"{out}_b") + factor(out, f"{out}_b") for out in open_})
        step *= 2
        open_ = [out for out in open_ if keeps[out] ** step > 0]
    return blocks.withColumns({f"{out}_in": F.coalesce(F.lag(f"{out}_b").over(order), F.col(f"{out}_0")) for out in keeps})


def _with_means(rows: DataFrame, spans: dict[str, tuple[str, int]], counted: bool = False) -> DataFrame:
    """rows (symbol, d, _block, ...) with exponential means: out -> (column, span). With counted also n, the number of each bar.

    Bars are dealt by (symbol, block), so that a long history is split over tasks; only a row a block meets in the order of a symbol's blocks.
    """
    keeps = {out: 1 - 2.0 / (span + 1) for out, (_, span) in spans.items()}
    maps: dict[str, Column] = {}
    for out, (x, _) in spans.items():
        maps |= _maps(x, keeps[out], out)
    rows = rows.withColumns(maps | ({"_k": F.row_number().over(Window.partitionBy("symbol", "_block").orderBy("d"))} if counted else {}))
    ends = [F.max_by(f"{out}_{m}", "d").alias(f"{out}_{m}") for out in spans for m in "ab"] + [F.min_by(x, "d").alias(f"{out}_0") for out, (x, _) in spans.items()]
    blocks = rows.groupBy("symbol", "_block").agg(*ends, F.count("*").alias("_n"))
    blocks = _composed(blocks, keeps)
    if counted:
        before = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = rows.join(blocks.select("symbol", "_block", *[f"{out}_in" for out in spans], *(["_before"] if counted else [])), ["symbol", "_block"])
    found = found.withColumns({out: F.col(f"{out}_a") * F.col(f"{out}_in") + F.col(f"{out}_b") for out in spans})
    found = found.drop(*[f"{out}_{m}" for out in spans for m in ("a", "b", "in")])
    return found.withColumn("n", F.col("_before") + F.col("_k")).drop("_before", "_k") if counted else found


def _blocks(bars: DataFrame) -> DataFrame:
    """A bar without symbol or day is in no block. Left out here, rows and blocks of _with_means() have the same filters, so that they share one exchange."""
    rows = bars.select("symbol", "d", "close", F.floor(F.datediff("d", F.lit("1970-01-01").cast("date")) / BLOCK_DAYS).alias("_block"))
    return rows.where("symbol is not null and _block is not null")


def ema_panel(bars: DataFrame, span: int = 12) -> DataFrame:
    """symbol, d, ema: the exponential mean at every bar, from the first close on."""
    return _with_means(_blocks(bars), {"ema": ("close", span)}).select("symbol", "d", "ema")


def macd_panel(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, d, macd, macd_signal, macd_hist at every bar; zeros before a symbol's bar number ``slow``.

    The mean of a mean is a sum of both spans' means of the closes, if the spans differ: with factors p and q it is (1 - q) * p / (p - q) times the mean
    of p and (p - 1) * q / (p - q) times that of q. So the signal needs no second pass over the bars but a third mean in the first one.
    """
    closes, spans = _blocks(bars), {"_fast": ("close", fast), "_slow": ("close", slow)}
    line = F.col("_fast") - F.col("_slow")
    if signal in (fast, slow):
        rows = _with_means(closes, spans, counted=True).withColumn("_line", line)
        rows = _with_means(rows.select("symbol", "d", "_block", "_line", "n"), {"_mark": ("_line", signal)})
    else:
        q = 1 - 2.0 / (signal + 1)

        def smoothed(out: str, span: int) -> Column:
            p = 1 - 2.0 / (span + 1)
            return F.col(out) * ((1 - q) * p / (p - q)) + F.col("_own") * ((p - 1) * q / (p - q))

        rows = _with_means(closes, spans | {"_own": ("close", signal)}, counted=True).withColumns({"_line": line, "_mark": smoothed("_fast", fast) - smoothed("_slow", slow)})
    pick = lambda c: F.when(F.col("n") >= slow, c).otherwise(0.0)
    return rows.select("symbol", "d", pick(F.col("_line")).alias("macd"), pick(F.col("_mark")).alias("macd_signal"), pick(F.col("_line") - F.col("_mark")).alias("macd_hist"))


#: No feature looks further back than so many bars.
LOOK_BACK = 20
FEATURES = ("f_prev", "f_ma5", "f_ma10", "f_ma20", "f_rsi", "f_volume", "f_momentum", "label")


def _features(last: int | None) -> Callable:
    """Features of numbered bars that come in the order of symbol and n. The bars before one are the rows before it, so means are sums of shifted arrays, oldest first.

    As in SQL, a mean leaves out missing values, and a change to or from one counts as none.
    """

    def column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        c = table.column(name).combine_chunks()
        return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)

    def before(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[: len(x) - k] if k < len(x) else x[:0]])

    def mean(x: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        total, times = (sum(before(y, j) for j in range(k, 0, -1)) for y in (x, known.astype(np.int64)))
        return total / times, times > 0

    def computed(rows: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        (close, known), (volume, counted) = column(rows, "close"), column(rows, "volume")
        change = np.where(known & before(known, 1), close - before(close, 1), 0.0)
        (gain, _), (loss, _) = (mean(np.maximum(c, 0.0), np.ones(len(c), bool), 14) for c in (change, -change))
        usual, any_volume = mean(volume, counted, 10)
        prev, five, traded = before(close, 1), before(close, 5), any_volume & ~(usual <= 0)  # NaN is above 0
        moved = before(known, 5) & (five != 0)
        return {
            "f_prev": (prev, before(known, 1)), **{f"f_ma{k}": mean(close, known, k) for k in (5, 10, 20)},
            "f_rsi": (np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)), np.ones(len(close), bool)),
            "f_volume": (np.where(traded, before(volume, 1) / usual, 1.0), ~traded | before(counted, 1)),
            "f_momentum": (np.where(moved, (prev - five) / five, 0.0), ~moved | before(known, 1)), "label": (close, known),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b] if held is None else [*held, b])
            n, cnt = (rows.column(c).to_numpy() for c in ("n", "cnt"))
            wanted = np.flatnonzero((n > LOOK_BACK) & ((n > cnt - last) if last is not None else True) & (np.arange(len(n)) >= len(n) - b.num_rows))
            if (wanted < LOOK_BACK).any() or (n[wanted - LOOK_BACK] != n[wanted] - LOOK_BACK).any():
                raise ValueError("bars do not come in the order of symbol and n")
            with np.errstate(all="ignore"):
                found = {name: pa.array(x[wanted], mask=~known[wanted]) for name, (x, known) in computed(rows).items()}
            kept = rows.select(["symbol", "d", "n", "cnt"]).take(wanted)
            yield from pa.table({name: kept.column(name) for name in kept.column_names} | found).to_batches()
            held = rows.slice(max(0, len(rows) - LOOK_BACK)).to_batches()

    return run


def feature_panel(bars: DataFrame, last: int | None = None) -> DataFrame:
    """Seven features of each bar from the bars before it, and the close as label, from the 21st bar on. With last, of so many bars at a symbol's end only.

    Bars are numbered by windows, in whose order their features are then taken from Arrow arrays: seven frames of up to 20 bars would be summed anew for each row.
    """
    df = numbered(bars.select("symbol", "d", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")))
    df = df if last is None else df.where(F.col("n") > F.col("cnt") - last - LOOK_BACK)
    rows = df.select("symbol", "d", "n", "cnt", "close", "volume")
    return rows.mapInArrow(_features(last), StructType([*rows.schema.fields[:4], *[StructField(name, DoubleType()) for name in FEATURES]]))


def latest(df: DataFrame) -> DataFrame:
    return df.where("n = cnt")


def last_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "d").alias("last_close"), F.max("d").alias("d"))
