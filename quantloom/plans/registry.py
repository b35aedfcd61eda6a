"""All registered queries of the analytics library: each name with its Spark query and, where SQL can say it, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.functions import text as fn
from quantloom.operators import cards, forecast, news, news_index, portfolio, scan
from quantloom.operators import indicators as ind
from quantloom.plans import oracle as o
from quantloom.sources import bars as stored
from quantloom.sources import feeds, quarantine
from quantloom.sources import market as src
from quantloom.sources.changes import ChangeTable
from quantloom.streaming import streams

ASOF_BARS, ASOF_NEWS = o.ASOF_BARS, o.ASOF_NEWS
TICKERS = [1, 2, 3, 5, 8, 10, 16, 20, 33, 40, 55, 60]
SEARCHES = [" blue", "red", "AL", "", "zzz", "o-m"]
POPULAR = ["PLTR", "COIN", "SNOW"]
FALLBACK = [("dow", "AXP"), ("dow", "BA"), ("sp500", "MMM")]
ROUTES = ["financial markets economy stocks", "technology stocks", "healthcare pharma stocks", "energy oil gas stocks", "banking finance stocks", "mergers acquisitions", "food beverage consumer stocks", "AAPL stock"]
#: query, count: of categories, of all news, of symbols and words that occur in the articles, and of symbols that do not, with and without words that do.
NEWS = [("mergers acquisitions", 8), ("energy oil gas stocks", 20), ("all", 10), ("THING stock", 20), ("attion ertion thing", 10), ("QQQQ thing onre", 10), ("QQQQ eren with that", 4), ("QQQQ stock with reading that", 10)]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r4(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4).alias(name) if name else F.round(c, 4)


def _r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 4) AS {name or expr}"


# ---- sources and bars

@query("bars_daily", o.sql("bars", "SELECT symbol, d, open, high, low, close, volume FROM bars"))
def bars_daily(spark, sf):
    return src.bars_long(spark, sf)


@query("bars_daily_short", o.sql("shorts", "SELECT symbol, d, open, high, low, close, volume FROM shorts"))
def bars_daily_short(spark, sf):
    return src.bars_short(spark, sf)


@query("last_close", o.sql("bars", "SELECT symbol, max_by(close, d) AS last_close, max(d) AS d FROM bars GROUP BY symbol"))
def last_close(spark, sf):
    return ind.last_close(src.bars_long(spark, sf))


@query("bars_lookback", o.sql("bars", "\nUNION ALL ".join(
    [f"SELECT '{p}' AS period, symbol, d, open, high, low, close, volume FROM bars WHERE d >= CAST(DATE '{ASOF_BARS}' - INTERVAL {m} MONTH AS DATE)" for p, m in (("1mo", 1), ("3mo", 3), ("6mo", 6), ("1y", 12), ("5y", 60))]
    + ["SELECT '5d' AS period, symbol, d, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS b FROM bars) WHERE b <= 5"]
)))
def bars_lookback(spark, sf):
    return ind.lookbacks(src.bars_long(spark, sf), ["1mo", "3mo", "6mo", "1y", "5y", "5d"], ASOF_BARS).select("period", "symbol", "d", "open", "high", "low", "close", "volume")


def _stored(spark, sf):
    path = src.shared_path(spark, "bars")
    stored.write(src.bars_long(spark, sf), path)
    return path


@query("bar_store_lookback", o.sql("bars", "\nUNION ALL ".join(
    [f"SELECT '{p}' AS period, symbol, d, open, high, low, close, volume FROM bars WHERE d >= CAST(DATE '{ASOF_BARS}' - INTERVAL {m} MONTH AS DATE)" for p, m in (("1mo", 1), ("1y", 12))]
    + ["SELECT '5d' AS period, symbol, d, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS b FROM bars) WHERE b <= 5"]
)))
def bar_store_lookback(spark, sf):
    path = _stored(spark, sf)
    one, year, few = (stored.lookback(spark, path, p, ASOF_BARS) for p in ("1mo", "1y", "5d"))
    return one.unionByName(year).unionByName(few).select("period", "symbol", "d", "open", "high", "low", "close", "volume")


@query("bar_store_scan", o.sql("scan", f"SELECT symbol, {_r('rsi')}, {_r('ma_20')}, {_r('ma_50')}, CAST(t AS INTEGER) AS tech_score FROM scan"))
def bar_store_scan(spark, sf):
    df = scan.scan_indicators(stored.last(spark, _stored(spark, sf), scan.LOOKBACK))
    return df.select("symbol", r4("rsi", "rsi"), r4("ma_20", "ma_20"), r4("ma_50", "ma_50"), scan.score(scan.tech_rules()).alias("tech_score"))


@query("quotes_snapshot", o.sql("q", f"SELECT symbol, name AS \"longName\", cur AS \"currentPrice\", reg AS \"regularMarketPrice\", {_r('change', 'change_pct')}, volume, pe, peg, hi, lo, sector, industry, CAST(staff AS DOUBLE) AS staff FROM q"))
def quotes_snapshot(spark, sf):
    q = src.quotes(spark, sf)
    return q.select("symbol", "longName", "currentPrice", "regularMarketPrice", r4("regularMarketChangePercent", "change_pct"), "volume", F.col("trailingPE").alias("pe"), F.col("pegRatio").alias("peg"), F.col("fiftyTwoWeekHigh").alias("hi"), F.col("fiftyTwoWeekLow").alias("lo"), "sector", "industry", F.col("fullTimeEmployees").cast("double").alias("staff"))


_BROKEN = "CASE WHEN h = 3 OR h = 5 THEN 'missing price' WHEN h = 7 THEN 'price not positive' WHEN h = 11 THEN 'high below low' WHEN h = 13 THEN 'bad volume' WHEN h = 1000 THEN 'repeated day' END"


@query("bars_rejected", o.sql("raw", f"SELECT symbol, d, broken FROM (SELECT symbol, d, {_BROKEN} AS broken FROM raw) WHERE broken IS NOT NULL"))
def bars_rejected(spark, sf):
    return quarantine.rejected(quarantine.checked(src.raw_bars(spark, sf))).select("symbol", "d", F.array_join("broken", ", ").alias("broken"))


@query("bars_clean", o.sql("raw", f"SELECT symbol, count(*) AS bars, {_r('avg(close)', 'mean_close')}, max(d) AS last_day FROM raw WHERE {_BROKEN} IS NULL GROUP BY symbol"))
def bars_clean(spark, sf):
    rows = quarantine.clean(quarantine.checked(src.raw_bars(spark, sf)))
    return rows.groupBy("symbol").agg(F.count("*").alias("bars"), r4(F.avg("close"), "mean_close"), F.max("d").alias("last_day"))


# ---- indicators

@query("indicator_rsi", o.sql("r", f"SELECT symbol, d, {_r('rsi')} FROM r"))
def indicator_rsi(spark, sf):
    return ind.rsi(ind.numbered(src.bars_long(spark, sf))).select("symbol", "d", r4("rsi", "rsi"))


@query("indicator_rsi_short", o.sql("sr", f"SELECT symbol, d, {_r('rsi')} FROM sr WHERE n = cnt"))
def indicator_rsi_short(spark, sf):
    return ind.latest(ind.rsi(ind.numbered(src.bars_short(spark, sf)))).select("symbol", "d", r4("rsi", "rsi"))


@query("indicator_sma", o.sql("num", "SELECT symbol, d, " + ", ".join(_r(f"CASE WHEN n >= {k} THEN avg(close) OVER {o.frame(k)} ELSE close END", f"ma_{k}") for k in (5, 10, 20, 50)) + " FROM num"))
def indicator_sma(spark, sf):
    df = ind.numbered(src.bars_long(spark, sf))
    for k in (5, 10, 20, 50):
        df = ind.sma(df, k)
    return df.select("symbol", "d", *[r4(f"ma_{k}", f"ma_{k}") for k in (5, 10, 20, 50)])


@query("indicator_bollinger", o.sql("num", f"""SELECT symbol, d, {_r("CASE WHEN n >= 20 THEN m - 2 * s ELSE close END", "bb_lower")}, {_r("CASE WHEN n >= 20 THEN m ELSE close END", "bb_mid")}, {_r("CASE WHEN n >= 20 THEN m + 2 * s ELSE close END", "bb_upper")}
FROM (SELECT *, avg(close) OVER {o.frame(20)} AS m, stddev_pop(close) OVER {o.frame(20)} AS s FROM num)"""))
def indicator_bollinger(spark, sf):
    return ind.bollinger(ind.numbered(src.bars_long(spark, sf))).select("symbol", "d", *[r4(c, c) for c in ("bb_lower", "bb_mid", "bb_upper")])


@query("indicator_momentum", o.sql("num", "SELECT symbol, d, " + ", ".join(_r(f"CASE WHEN n > {k} THEN (close - lag(close, {k}) OVER ({o.W})) / lag(close, {k}) OVER ({o.W}) ELSE 0e0 END", c) for k, c in ((4, "week"), (19, "month"))) + " FROM num"))
def indicator_momentum(spark, sf):
    return ind.momentum(ind.numbered(src.bars_long(spark, sf))).select("symbol", "d", r4("week", "week"), r4("month", "month"))


@query("indicator_volume", o.sql("num", f"SELECT symbol, d, {_r('a', 'avg_volume')}, volume > a * 1.5e0 AS volume_spike FROM (SELECT *, CASE WHEN n >= 10 THEN avg(volume) OVER {o.frame(10)} ELSE volume END AS a FROM num)"))
def indicator_volume(spark, sf):
    return ind.volume_spike(ind.numbered(src.bars_long(spark, sf))).select("symbol", "d", r4("avg_volume", "avg_volume"), "volume_spike")


_EMA = "e AS (SELECT symbol, d, n, cnt, close AS ema FROM num WHERE n = 1 UNION ALL SELECT x.symbol, x.d, x.n, x.cnt, (1 - 2e0 / 13) * e.ema + (2e0 / 13) * x.close FROM e JOIN num x ON x.symbol = e.symbol AND x.n = e.n + 1)"


@query("indicator_ema", o.sql("num", f"SELECT symbol, {_r('ema')} FROM e WHERE n = cnt", _EMA, True))
def indicator_ema(spark, sf):
    return ind.ema_latest(src.bars_long(spark, sf)).select("symbol", r4("ema", "ema"))


@query("indicator_ema_panel", o.sql("num", f"SELECT symbol, d, {_r('ema')} FROM e", _EMA, True))
def indicator_ema_panel(spark, sf):
    return ind.ema_panel(src.bars_long(spark, sf)).select("symbol", "d", r4("ema", "ema"))


def _macd(source: str) -> str:
    return f"""e AS (SELECT symbol, n, cnt, close AS f, close AS s, 0e0 AS g FROM {source} WHERE n = 1 UNION ALL
SELECT symbol, n, cnt, f, s, g * (1 - 2e0 / 10) + (f - s) * (2e0 / 10) FROM (SELECT x.symbol, x.n, x.cnt, e.f * (1 - 2e0 / 13) + x.close * (2e0 / 13) AS f, e.s * (1 - 2e0 / 27) + x.close * (2e0 / 27) AS s, e.g FROM e JOIN {source} x ON x.symbol = e.symbol AND x.n = e.n + 1))"""


_MACD_ROWS = f"SELECT symbol, {_r('CASE WHEN cnt >= 26 THEN f - s ELSE 0e0 END', 'macd')}, {_r('CASE WHEN cnt >= 26 THEN g ELSE 0e0 END', 'macd_signal')}, {_r('CASE WHEN cnt >= 26 THEN f - s - g ELSE 0e0 END', 'macd_hist')} FROM e WHERE n = cnt"


@query("indicator_macd", o.sql("num", _MACD_ROWS, _macd("num"), True))
def indicator_macd(spark, sf):
    return ind.macd_latest(src.bars_long(spark, sf)).select("symbol", *[r4(c, c) for c in ("macd", "macd_signal", "macd_hist")])


@query("indicator_macd_short", o.sql("snum", _MACD_ROWS, _macd("snum"), True))
def indicator_macd_short(spark, sf):
    return ind.macd_latest(src.bars_short(spark, sf)).select("symbol", *[r4(c, c) for c in ("macd", "macd_signal", "macd_hist")])


_PANEL = f"SELECT symbol, d, {_r('CASE WHEN n >= 26 THEN f - s ELSE 0e0 END', 'macd')}, {_r('CASE WHEN n >= 26 THEN g ELSE 0e0 END', 'macd_signal')}, {_r('CASE WHEN n >= 26 THEN f - s - g ELSE 0e0 END', 'macd_hist')} FROM (SELECT e.*, d FROM e JOIN num USING (symbol, n))"


@query("indicator_macd_panel", o.sql("num", _PANEL, _macd("num"), True))
def indicator_macd_panel(spark, sf):
    return ind.macd_panel(src.bars_long(spark, sf)).select("symbol", "d", *[r4(c, c) for c in ("macd", "macd_signal", "macd_hist")])


_FEATURES = ["f_prev", "f_ma5", "f_ma10", "f_ma20", "f_rsi", "f_volume", "f_momentum", "label"]


@query("ml_features", o.sql("r", f"SELECT symbol, d, {', '.join(_r(c) for c in _FEATURES)} FROM (SELECT symbol, d, n, lag(close) OVER ({o.W}) AS f_prev, avg(close) OVER {o.frame(5, 1)} AS f_ma5, avg(close) OVER {o.frame(10, 1)} AS f_ma10, avg(close) OVER {o.frame(20, 1)} AS f_ma20, lag(rsi) OVER ({o.W}) AS f_rsi, CASE WHEN avg(volume) OVER {o.frame(10, 1)} > 0 THEN lag(volume) OVER ({o.W}) / avg(volume) OVER {o.frame(10, 1)} ELSE 1e0 END AS f_volume, CASE WHEN lag(close, 5) OVER ({o.W}) <> 0 THEN (lag(close) OVER ({o.W}) - lag(close, 5) OVER ({o.W})) / lag(close, 5) OVER ({o.W}) ELSE 0e0 END AS f_momentum, close AS label FROM r) WHERE n >= 21"))
def ml_features(spark, sf):
    return ind.feature_panel(src.bars_long(spark, sf)).select("symbol", "d", *[r4(c, c) for c in _FEATURES])


# ---- scan

def _scan(spark, sf):
    bars = src.bars_long(spark, sf)
    return scan.market_scan(bars, src.quotes(spark, sf, bars))


@query("scan_tech", o.sql("scan", f"SELECT symbol, {_r('rsi')}, {_r('ma_20')}, {_r('ma_50')}, CAST(t AS INTEGER) AS tech_score FROM scan"))
def scan_tech(spark, sf):
    df = scan.scan_indicators(src.bars_long(spark, sf))
    return df.select("symbol", r4("rsi", "rsi"), r4("ma_20", "ma_20"), r4("ma_50", "ma_50"), scan.score(scan.tech_rules()).alias("tech_score"))


@query("scan_fund", o.sql("scan", "SELECT symbol, CAST(f AS INTEGER) AS fund_score FROM scan"))
def scan_fund(spark, sf):
    return _scan(spark, sf).select("symbol", "fund_score")


@query("scan_momentum", o.sql("scan", f"SELECT symbol, {_r('week * 100', 'change_1w')}, {_r('month * 100', 'change_1m')}, CAST(m AS INTEGER) AS ml_score FROM scan"))
def scan_momentum(spark, sf):
    return _scan(spark, sf).select("symbol", r4("change_1w", "change_1w"), r4("change_1m", "change_1m"), "ml_score")


_STRONG = "CASE WHEN total >= 5 THEN 'BUY' WHEN total <= -5 THEN 'SELL' ELSE '' END AS strong"


@query("scan_market", o.sql("scan", f"SELECT symbol, substr(coalesce(name, CAST(symbol AS VARCHAR)), 1, 35) AS name, close AS price, CAST(t AS INTEGER) AS tech_score, CAST(f AS INTEGER) AS fund_score, CAST(m AS INTEGER) AS ml_score, CAST(total AS INTEGER) AS total_score, {_STRONG}, coalesce(pe, 0e0) AS pe FROM scan"))
def scan_market(spark, sf):
    return _scan(spark, sf).select("symbol", "name", "price", "tech_score", "fund_score", "ml_score", "total_score", "strong", "pe")


@query("scan_reasons", o.sql("scan", f"SELECT symbol, {o._reasons(o.TECH, 3)} AS tech_reasons, {o._reasons(o.FUND, 2)} AS fund_reasons, {o._reasons(o.MOMENTUM, 2)} AS ml_reasons FROM scan"))
def scan_reasons(spark, sf):
    return _scan(spark, sf).select("symbol", *[F.array_join(c, "; ").alias(c) for c in ("tech_reasons", "fund_reasons", "ml_reasons")])


@query("scan_top_buys", o.sql("scan", "SELECT CAST(row_number() OVER (ORDER BY total DESC, symbol) AS INTEGER) AS rank, symbol, CAST(total AS INTEGER) AS total_score FROM scan WHERE total > 0 ORDER BY total DESC, symbol LIMIT 5"))
def scan_top_buys(spark, sf):
    return scan.top_buys(_scan(spark, sf).select("symbol", "total_score")).select("rank", "symbol", "total_score")


@query("scan_top_sells", o.sql("scan", "SELECT CAST(row_number() OVER (ORDER BY total, symbol) AS INTEGER) AS rank, symbol, CAST(total AS INTEGER) AS total_score FROM scan WHERE total < 0 ORDER BY total, symbol LIMIT 5"))
def scan_top_sells(spark, sf):
    return scan.top_sells(_scan(spark, sf).select("symbol", "total_score")).select("rank", "symbol", "total_score")


@query("scan_summary", o.sql("scan", f"SELECT strong, count(*) AS symbols, CAST(sum(total) AS BIGINT) AS total FROM (SELECT total, {_STRONG} FROM scan) GROUP BY strong"))
def scan_summary(spark, sf):
    return _scan(spark, sf).groupBy("strong").agg(F.count("*").alias("symbols"), F.sum("total_score").alias("total"))


@query("scan_coverage", o.sql("bars", f"SELECT CASE WHEN cnt IS NULL THEN 'no_bars' WHEN cnt < 20 THEN 'short_history' ELSE 'analysed' END AS status, count(*) AS symbols FROM (SELECT DISTINCT symbol FROM bars) a LEFT JOIN (SELECT symbol, count(*) AS cnt FROM bars WHERE d >= CAST(DATE '{ASOF_BARS}' - INTERVAL 3 MONTH AS DATE) GROUP BY symbol) b USING (symbol) GROUP BY 1"))
def scan_coverage(spark, sf):
    return scan.scan_coverage(src.bars_long(spark, sf), "3mo", ASOF_BARS)


def _signals(spark, sf):
    bars = src.bars_long(spark, sf)
    return scan.signals(bars, src.quotes(spark, sf, bars))


_LABEL = "CASE WHEN score >= 3 THEN 'STRONG BUY' WHEN score >= 1 THEN 'BUY' WHEN score <= -3 THEN 'STRONG SELL' WHEN score <= -1 THEN 'SELL' WHEN score = 0 THEN 'NEUTRAL' END AS signal"


@query("tech_signal", o.sql("sig", f"SELECT symbol, price, CAST(score AS DOUBLE) AS tech_score, {_LABEL} FROM sig"))
def tech_signal(spark, sf):
    return _signals(spark, sf).select("symbol", "price", F.col("tech_score").cast("double").alias("tech_score"), "signal")


@query("insights", o.sql("sig", "SELECT symbol, array_to_string(list_filter([CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' END, CASE WHEN pe > 0 AND pe < 15 THEN 'attractive valuation' WHEN pe > 30 THEN 'high valuation' END, CASE WHEN price > ma_20 AND ma_20 > ma_50 THEN 'bullish trend' WHEN price < ma_20 AND ma_20 < ma_50 THEN 'bearish trend' END], lambda x: x IS NOT NULL), '; ') AS insights FROM sig"))
def insights(spark, sf):
    return scan.insights(_signals(spark, sf)).select("symbol", F.array_join("insights", "; ").alias("insights"))


@query("valuation", o.sql("q", "SELECT symbol, CAST(v AS INTEGER) AS val_score, CASE WHEN v >= 4 THEN 'UNDERVALUED' WHEN v >= 2 THEN 'FAIRLY VALUED' ELSE 'OVERVALUED' END AS valuation FROM (SELECT symbol, CASE WHEN pe <> 0 AND pe < 20 THEN 1 ELSE 0 END + CASE WHEN peg <> 0 AND peg < 1 THEN 2 ELSE 0 END + CASE WHEN growth <> 0 AND growth * 100 > 10 THEN 1 ELSE 0 END + CASE WHEN margin <> 0 AND margin * 100 > 15 THEN 1 ELSE 0 END AS v FROM q)"))
def valuation(spark, sf):
    return scan.valuation(src.quotes(spark, sf))


# ---- portfolio

def _valued(spark, sf):
    return portfolio.valued(src.positions(spark, sf), src.quotes(spark, sf))


@query("portfolio_positions", o.sql("val", f"SELECT portfolio_id, symbol, shares, buy_price, price, counted, {_r('value')}, {_r('cost')}, {_r('value - cost', 'gain')}, {_r('CASE WHEN cost > 0 THEN (value - cost) / cost * 100 ELSE 0e0 END', 'gain_pct')} FROM val"))
def portfolio_positions(spark, sf):
    return _valued(spark, sf).select("portfolio_id", "symbol", "shares", "buy_price", "price", "counted", *[r4(c, c) for c in ("value", "cost", "gain", "gain_pct")])


@query("portfolio_summary", o.sql("val", f"SELECT portfolio_id, {_r('v', 'value')}, {_r('c', 'cost')}, {_r('v - c', 'gain')}, {_r('CASE WHEN c > 0 THEN (v - c) / c * 100 ELSE 0e0 END', 'gain_pct')} FROM (SELECT portfolio_id, sum(value) AS v, sum(cost) AS c FROM val WHERE counted GROUP BY portfolio_id)"))
def portfolio_summary(spark, sf):
    return portfolio.totals(_valued(spark, sf)).select("portfolio_id", *[r4(c, c) for c in ("value", "cost", "gain", "gain_pct")])


@query("portfolio_counts", o.sql("pos watch", "SELECT portfolio_id, coalesce(a.n, 0) AS positions, coalesce(b.n, 0) AS watched FROM (SELECT portfolio_id, count(*) AS n FROM pos GROUP BY 1) a FULL JOIN (SELECT portfolio_id, count(*) AS n FROM watch GROUP BY 1) b USING (portfolio_id)"))
def portfolio_counts(spark, sf):
    return portfolio.counts(src.positions(spark, sf), src.watchlist(spark, sf))


@query("holdings_filter", o.sql("pos", "SELECT * FROM pos WHERE contains(upper(CAST(symbol AS VARCHAR)), '7')"))
def holdings_filter(spark, sf):
    return portfolio.holdings_filter(src.positions(spark, sf), "7")


@query("holdings_signals", o.sql("pos sig", f"SELECT portfolio_id, pos.symbol, shares, {_LABEL} FROM pos JOIN sig ON sig.symbol = pos.symbol"))
def holdings_signals(spark, sf):
    signals = _signals(spark, sf).select("symbol", "signal")
    return src.positions(spark, sf).join(signals, "symbol").select("portfolio_id", "symbol", "shares", "signal")


@query("watchlist_semi", o.sql("pos watch", "SELECT pos.* FROM pos WHERE EXISTS (SELECT 1 FROM watch w WHERE w.portfolio_id = pos.portfolio_id AND w.symbol = pos.symbol)"))
def watchlist_semi(spark, sf):
    return portfolio.watched(src.positions(spark, sf), src.watchlist(spark, sf))


@query("watchlist_anti", o.sql("pos watch", "SELECT pos.* FROM pos WHERE NOT EXISTS (SELECT 1 FROM watch w WHERE w.portfolio_id = pos.portfolio_id AND w.symbol = pos.symbol)"))
def watchlist_anti(spark, sf):
    return portfolio.watched(src.positions(spark, sf), src.watchlist(spark, sf), False)


@query("watchlist_state", o.sql("lots", "SELECT portfolio_id, symbol FROM (SELECT o_custkey AS portfolio_id, l_suppkey AS symbol, max_by(l_returnflag, ROW(d, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS f FROM lots JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) WHERE f = 'R'"))
def watchlist_state(spark, sf):
    return portfolio.watchlist_state(src.watchlist_log(spark, sf))


_YEARS = (1996, 1998, 2001)


@query("positions_as_of", o.sql("lots", f"""SELECT version, portfolio_id, count(*) AS positions, {_r('sum(shares)', 'shares')}, {_r('sum(shares * buy_price)', 'cost')}
FROM (SELECT DISTINCT o_custkey AS portfolio_id, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity AS shares, px AS buy_price, l_returnflag AS f, year(d) AS y FROM lots JOIN orders ON l_orderkey = o_orderkey), (VALUES {', '.join(f'({y})' for y in _YEARS)}) v(version)
WHERE y <= version AND NOT (f = 'R' AND y + 1 <= version) GROUP BY version, portfolio_id"""))
def positions_as_of(spark, sf):
    table = ChangeTable(spark, src.shared_path(spark, "lots"), schemas.LOTS, schemas.LOT_KEYS)
    log = src.materialize(src.lot_log(spark, sf), "lot-log")
    for y in [r.version for r in log.select("version").distinct().orderBy("version").collect()]:  # a row a year
        table.write(log.where(F.col("version") == y), y, F.col("op"))
    held = lambda y: table.as_of(y).groupBy("portfolio_id").agg(F.count("*").alias("positions"), r4(F.sum("shares"), "shares"), r4(F.sum(F.col("shares") * F.col("buy_price")), "cost")).select(F.lit(y).alias("version"), "*")
    first = src.materialize(held(_YEARS[0]), "held")
    table.compact(keep=table.version() - _YEARS[1])
    return first.unionByName(held(_YEARS[1])).unionByName(held(_YEARS[2]))


@query("portfolio_json_roundtrip", o.sql("pos", "SELECT CAST(symbol AS VARCHAR) AS symbol, shares, buy_price FROM pos"))
def portfolio_json_roundtrip(spark, sf):
    path = src.shared_path(spark, "portfolio-json")
    src.write_json(src.positions(spark, sf).withColumn("symbol", F.col("symbol").cast("string")), path, "portfolio_id")
    return src.json_list(spark, path, whole=False)


# ---- universe

_UNI = """con(index_name, symbol) AS (SELECT DISTINCT 'sp500', upper(replace(p_name, ' ', '.')) FROM part WHERE NOT starts_with(p_name, 'red') UNION SELECT DISTINCT 'nasdaq', upper(replace(p_name, ' ', '-')) FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue')),
uni AS (SELECT DISTINCT CASE WHEN index_name = 'sp500' THEN replace(symbol, '.', '-') ELSE symbol END AS symbol FROM (SELECT * FROM con UNION ALL SELECT * FROM (VALUES ('dow', 'AXP'), ('dow', 'BA'), ('sp500', 'MMM')) f(index_name, symbol) WHERE index_name NOT IN (SELECT index_name FROM con)) UNION SELECT * FROM (VALUES ('PLTR'), ('COIN'), ('SNOW')) p(symbol))"""
_SEARCH = "sq(query) AS (VALUES " + ", ".join(f"('{s}')" for s in SEARCHES) + "),\nhit AS (SELECT query, symbol, row_number() OVER (PARTITION BY query ORDER BY symbol) AS rank FROM uni JOIN sq ON trim(query) <> '' AND contains(symbol, upper(trim(query))))"


def _universe(spark, sf):
    return portfolio.universe(src.constituents(spark, sf), FALLBACK, POPULAR)


def _searches(spark):
    return spark.createDataFrame([(s,) for s in SEARCHES], "query string")


@query("universe", "WITH " + _UNI + " SELECT symbol FROM uni ORDER BY symbol")
def universe(spark, sf):
    return _universe(spark, sf).orderBy("symbol")


@query("symbol_search", "WITH " + _UNI + ",\n" + _SEARCH + " SELECT query, CAST(rank AS INTEGER) AS rank, symbol FROM hit WHERE rank <= 20")
def symbol_search(spark, sf):
    return portfolio.symbol_search(_universe(spark, sf), _searches(spark))


@query("symbol_resolve", "WITH " + _UNI + ",\n" + _SEARCH + " SELECT sq.query, coalesce(symbol, upper(sq.query)) AS symbol FROM sq LEFT JOIN hit ON hit.query = sq.query AND rank = 1")
def symbol_resolve(spark, sf):
    return portfolio.symbol_resolve(_universe(spark, sf), _searches(spark))


# ---- cards

_PRICE2 = "'$' || printf('%.2f', floor(mcap / 1e7 + 0.5e0) / 100) || 'B'"


@query("instrument_card", o.sql("q", f"SELECT symbol, coalesce(cur, reg) AS price, CASE WHEN mcap > 1e9 THEN {_PRICE2} ELSE 'N/A' END AS market_cap, CASE WHEN pe <> 0 THEN pe END AS pe, eps, {_r('yield * 100', 'dividend_pct')}, hi AS high_52w, lo AS low_52w, coalesce(volume, 0e0) AS volume, coalesce(sector, 'N/A') AS sector, substr(coalesce(industry, 'N/A'), 1, 25) AS industry, CASE WHEN staff > 0 THEN format('{{:,}}', staff) ELSE 'N/A' END AS employees FROM q"))
def instrument_card(spark, sf):
    return cards.instrument_card(src.quotes(spark, sf)).withColumn("dividend_pct", r4("dividend_pct"))


@query("ticker_strip", o.sql("q", f"SELECT symbol, coalesce(cur, reg, 0e0) AS price, {_r('abs(coalesce(change, 0e0))', 'change_abs')}, CASE WHEN coalesce(change, 0e0) >= 0 THEN 'up' ELSE 'down' END AS direction FROM q WHERE symbol IN ({', '.join(map(str, TICKERS))})"))
def ticker_strip(spark, sf):
    return cards.ticker_strip(src.quotes(spark, sf), TICKERS).withColumn("change_abs", r4("change_abs"))


@query("market_open", "SELECT event_id, CASE WHEN isodow(ny) <= 5 AND hour(ny) * 60 + minute(ny) BETWEEN 570 AND 959 THEN true ELSE false END AS market_open FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM events)")
def market_open(spark, sf):
    return src.ticks(spark, sf).select("event_id", fn.market_open(F.col("ts")).alias("market_open"))


# ---- news

_QS = o.query_rows(NEWS)


@query("news_feed_files", o.sql("art", "SELECT article_id, title, description, source_name, published_at FROM art"))
def news_feed_files(spark, sf):
    path = src.shared_path(spark, "feed")
    feeds.write(src.articles(spark, sf), path)
    return feeds.read(spark, path, "primary").select("article_id", "title", "description", F.col("source.name").alias("source_name"), "published_at")


@query("news_recent", o.sql("art", f"SELECT article_id, feed FROM art WHERE {o.RECENT}"))
def news_recent(spark, sf):
    return news.recent(src.articles(spark, sf), ASOF_NEWS).select("article_id", "feed")


@query("news_route", o.sql("art", f"SELECT query, any_value({o.route_sql('query')}) AS category, array_to_string(any_value(keywords), ',') AS keywords, count(article_id) AS articles, coalesce(min(pos), -1) AS first_pos FROM qs LEFT JOIN art ON {o.MATCH} GROUP BY query", o.query_rows([(r, 10) for r in ROUTES])))
def news_route(spark, sf):
    routes = [(r, 10) for r in ROUTES]
    found = news.asked(src.articles(spark, sf), routes, lambda q: news.matches(F.col("title"), F.col("description"), q["keywords"])).groupBy("query").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rows = news.asked(spark.range(1), routes).select("query", news.route(F.col("query")).alias("category"), F.array_join("keywords", ",").alias("keywords"))  # one a route
    return rows.join(found, "query", "left").select("query", "category", "keywords", F.coalesce("n", F.lit(0).cast("long")).alias("articles"), F.coalesce("pos", F.lit(-1).cast("long")).alias("first_pos"))


_FETCHED = f"fet AS (SELECT * FROM (SELECT query, count, article_id, title, pos, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM art JOIN qs ON {o.MATCH} WHERE feed = 'primary' AND {o.RECENT}) WHERE k <= count)"


@query("news_category", o.sql("art", "SELECT query, article_id, CAST(pos AS BIGINT) AS pos FROM fet", _QS + ",\n" + _FETCHED))
def news_category(spark, sf):
    return news.fetched(src.articles(spark, sf), NEWS, ASOF_NEWS).select("query", "article_id", "pos")


@query("news_category_match", o.sql("art", f"SELECT article_id, query FROM art JOIN qs ON keywords IS NOT NULL AND {o.MATCH}", _QS))
def news_category_match(spark, sf):
    wanted = lambda q: q["keywords"].isNotNull() & news.matches(F.col("title"), F.col("description"), q["keywords"])
    return news.asked(src.articles(spark, sf), NEWS, wanted).select("article_id", "query")


_CLEAN = "replace(replace(replace(replace(replace(replace(description, '<![CDATA[', ''), ']]>', ''), '<p>', ''), '</p>', ''), '<br>', ' '), '<br/>', ' ')"


@query("news_summary", o.sql("art", f"SELECT article_id, CASE WHEN length(description) > 20 THEN CASE WHEN length({_CLEAN}) > 150 THEN substr({_CLEAN}, 1, 147) || '...' ELSE {_CLEAN} END ELSE CASE WHEN len(regexp_split_to_array(trim(title), '\\s+')) > 8 THEN array_to_string(regexp_split_to_array(trim(title), '\\s+')[1:8], ' ') || '...' ELSE title END END AS summary FROM art"))
def news_summary(spark, sf):
    return src.articles(spark, sf).select("article_id", fn.summary(F.col("title"), F.col("description")).alias("summary"))


_SECS = "(hours * 3600)"


@query("news_time_ago", o.sql("art", f"SELECT article_id, CASE WHEN pub IS NULL THEN substr(published_at, 1, 10) WHEN {_SECS} < 3600 THEN CAST({_SECS} // 60 AS VARCHAR) || 'm ago' WHEN {_SECS} // 86400 = 0 THEN CAST({_SECS} // 3600 AS VARCHAR) || 'h ago' WHEN {_SECS} // 86400 = 1 THEN 'Yesterday' WHEN {_SECS} // 86400 < 7 THEN CAST({_SECS} // 86400 AS VARCHAR) || 'd ago' ELSE strftime(pub, '%b %d, %Y') END AS ago FROM art"))
def news_time_ago(spark, sf):
    at = fn.published(F.col("published_at"))
    return src.articles(spark, sf).select("article_id", fn.time_ago(F.col("published_at"), at, F.to_timestamp(F.lit(ASOF_NEWS))).alias("ago"))


@query("news_card", o.sql("art", f"SELECT article_id, coalesce(title, 'No title') AS title, coalesce(description, '') AS description, coalesce(source_name, 'Unknown') AS source_name, CASE WHEN feed = 'primary' THEN 'Primary Feed' ELSE 'Backup Feed' END AS feed_name, coalesce(published_at, '{ASOF_NEWS}') AS published_at FROM art"))
def news_card(spark, sf):
    return news.card(src.articles(spark, sf), ASOF_NEWS)


_SIM = _QS + "," + o.similarity_parts("art")


@query("news_similarity", o.sql("art", f"SELECT query, article_id, {_r('similarity')} FROM sim", _SIM))
def news_similarity(spark, sf):
    return news.similarity(src.articles(spark, sf), NEWS).select("query", "article_id", r4("similarity", "similarity"))


@query("news_relevance", o.sql("art", f"SELECT query, article_id, {_r('relevance')} FROM rel", _SIM))
def news_relevance(spark, sf):
    return news.relevance(src.articles(spark, sf), NEWS, ASOF_NEWS).select("query", "article_id", r4("relevance", "relevance"))


_FOUND = "fnd AS (SELECT DISTINCT query, article_id FROM at_ JOIN qt USING (term))"
_TOP = "SELECT query, CAST(rank AS INTEGER) AS rank, article_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(relevance, 9) DESC, article_id) AS rank FROM (SELECT rel.*, count, row_number() OVER (PARTITION BY rel.query ORDER BY pos) AS k FROM rel JOIN fnd USING (query, article_id) JOIN qs ON qs.query = rel.query) WHERE k <= 3 * count) WHERE rank <= count"


@query("news_relevance_topk", o.sql("art", _TOP, _SIM + ",\n" + _FOUND))
def news_relevance_topk(spark, sf):
    return news.top_relevant(src.articles(spark, sf), NEWS, ASOF_NEWS).select("query", "rank", "article_id")


@query("news_index_search", o.sql("art", _TOP, _SIM + ",\n" + _FOUND))
def news_index_search(spark, sf):
    path = src.shared_path(spark, "news-index")
    news_index.write(src.articles(spark, sf), path)
    return news_index.top_relevant(spark, path, NEWS, ASOF_NEWS).select("query", "rank", "article_id")


@query("news_most_similar", o.sql("art", f"SELECT query, CAST(rank AS INTEGER) AS rank, article_id, {_r('similarity')} FROM (SELECT sim.*, count, row_number() OVER (PARTITION BY sim.query ORDER BY round(similarity, 9) DESC, article_id) AS rank FROM sim JOIN qs ON qs.query = sim.query WHERE similarity > 0) WHERE rank <= count", _SIM))
def news_most_similar(spark, sf):
    path = src.shared_path(spark, "news-index")
    news_index.write(src.articles(spark, sf), path)
    return news_index.most_similar(spark, path, NEWS).withColumn("similarity", r4("similarity"))


_MERGED = f""",
few AS (SELECT query, count FROM qs LEFT JOIN (SELECT query, count(*) AS n FROM fet GROUP BY query) USING (query) WHERE coalesce(n, 0) < 5 AND lower(query) NOT IN ({o.GENERAL_SQL})),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(relevance, 9) DESC, article_id) AS p FROM (SELECT rel.*, few.count, row_number() OVER (PARTITION BY rel.query ORDER BY pos) AS k FROM rel JOIN fnd USING (query, article_id) JOIN few ON few.query = rel.query) WHERE k <= 3 * count) WHERE p <= count),
un AS (SELECT query, count, article_id, title, 'primary' AS feed, pos, 0 AS r FROM fet UNION ALL SELECT query, count, article_id, title, 'backup', p, 1 FROM bk),
on_ AS (SELECT * FROM (SELECT un.*, row_number() OVER (PARTITION BY un.query, CASE WHEN few.query IS NOT NULL THEN lower(title) ELSE CAST(article_id AS VARCHAR) END ORDER BY r, pos) AS k FROM un LEFT JOIN few ON few.query = un.query) WHERE k = 1)"""


@query("news_merge", o.sql("art", "SELECT query, CAST(rank AS INTEGER) AS rank, article_id, feed FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r, pos) AS rank FROM on_) WHERE rank <= count", _QS + ",\nbak AS (SELECT * FROM art WHERE feed = 'backup')," + o.similarity_parts("bak") + ",\n" + _FOUND + ",\n" + _FETCHED + _MERGED))
def news_merge(spark, sf):
    return news.merged(src.articles(spark, sf), NEWS, ASOF_NEWS)


# ---- forecasts

_STEP = "(SELECT unnest(range(1, 31)) AS step)"


@query("forecast_ma", o.sql("ind", f"SELECT symbol, 'ma' AS model, CAST(step AS INTEGER) AS step, {_r('ma_20', 'yhat')}, {_r('close * 0.01e0', 'sigma')} FROM ind CROSS JOIN {_STEP} WHERE n = cnt"))
def forecast_ma(spark, sf):
    return forecast.moving_average(src.bars_long(spark, sf)).select("symbol", "model", "step", r4("yhat", "yhat"), r4("sigma", "sigma"))


_UNIFORM = "(CAST('0x' || substr(h, {}, 8) AS BIGINT) + 1) / 4294967297e0"
_NOISE = f"SELECT symbol, CAST(step AS INTEGER) AS step, {_r('ma_20 + close * 0.01e0 * sqrt(-2 * ln(' + _UNIFORM.format(1) + ')) * cos(2 * pi() * ' + _UNIFORM.format(9) + ')', 'yhat')} FROM (SELECT symbol, step, ma_20, close, sha256('7:' || symbol || ':' || step) AS h FROM ind CROSS JOIN {_STEP} WHERE n = cnt)"


@query("forecast_ma_noise", o.sql("ind", _NOISE))
def forecast_ma_noise(spark, sf):
    return forecast.moving_average(src.bars_long(spark, sf), seed=7).select("symbol", "step", r4("yhat", "yhat"))


_LIN = f"lin AS (SELECT symbol, CAST(step AS INTEGER) AS step, coalesce(a + b * (cnt + step - 1), last) AS yhat, last FROM (SELECT symbol, regr_slope(close, n - 1e0) AS b, regr_intercept(close, n - 1e0) AS a, count(*) AS cnt, max_by(close, d) AS last FROM num GROUP BY symbol) CROSS JOIN {_STEP})"


@query("forecast_linear", o.sql("num", f"SELECT symbol, 'linear' AS model, step, {_r('yhat')} FROM lin", _LIN))
def forecast_linear(spark, sf):
    return forecast.linear(src.bars_long(spark, sf)).withColumn("yhat", r4("yhat"))


@query("forecast_horizons", o.sql("num", f"SELECT symbol, 'linear' AS model, step, {_r('yhat')}, {_r('(yhat - last) / last * 100', 'change_pct')} FROM lin WHERE step IN (7, 14, 30)", _LIN))
def forecast_horizons(spark, sf):
    bars = src.bars_long(spark, sf)
    return forecast.horizons(forecast.linear(bars), bars).withColumns({"yhat": r4("yhat"), "change_pct": r4("change_pct")})


@query("forecast_chart", o.sql("num back", f"SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS INTEGER) AS x, {_r('close', 'value')}, 'history' AS kind FROM back WHERE b <= 60 UNION ALL SELECT symbol, CAST(h + step - 1 AS INTEGER), round(yhat, 4), 'forecast' FROM lin JOIN (SELECT symbol, least(count(*), 60) AS h FROM bars GROUP BY symbol) USING (symbol)", _LIN))
def forecast_chart(spark, sf):
    bars = src.bars_long(spark, sf)
    return forecast.chart(bars, forecast.linear(bars)).withColumn("value", r4("value"))


@query("forecast_rf")
def forecast_rf(spark, sf):
    return forecast.forest(src.bars_long(spark, sf))


# ---- streams

_DAYS = "b AS (SELECT symbol, date_trunc('day', ts) AS start, min_by(price, ROW(ts, event_id)) AS open, max(price) AS high, min(price) AS low, max_by(price, ROW(ts, event_id)) AS close, count(*) AS ticks FROM ticks GROUP BY ALL)"


@query("stream_bars", o.sql("ticks", "SELECT symbol, CAST(start AS TIMESTAMP) AS start, open, high, low, close, ticks FROM b WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM ticks) - INTERVAL 1 DAY", _DAYS))
def stream_bars(spark, sf):
    df = streams.run_to_files(streams.bars(streams.tick_stream(spark, sf)), "bars")
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_bars_rolled_up", o.sql("ticks", "SELECT symbol, CAST(start AS TIMESTAMP) AS start, open, high, low, close, ticks FROM b WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM ticks) - INTERVAL 1 DAY", _DAYS))
def stream_bars_rolled_up(spark, sf):
    df = streams.run_to_files(streams.rolled_up(streams.tick_stream(spark, sf))[1], "rolled-up")
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_latest_quote", o.sql("ticks", "SELECT symbol, max_by(price, ROW(ts, event_id)) AS price, max(ts) AS ts FROM ticks GROUP BY symbol"))
def stream_latest_quote(spark, sf):
    df = streams.run_latest(streams.latest_quote(streams.tick_stream(spark, sf)), "latest")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_LIVE = "lq AS (SELECT symbol, max_by(price, ROW(ts, event_id)) AS price FROM ticks GROUP BY symbol), lv AS (SELECT portfolio_id, sum(price * shares) AS v, sum(buy_price * shares) AS c FROM pos JOIN lq USING (symbol) WHERE shares >= 0.001e0 GROUP BY portfolio_id)"


@query("stream_portfolio", o.sql("pos ticks", f"SELECT portfolio_id, {_r('v', 'value')}, {_r('c', 'cost')}, {_r('v - c', 'gain')}, {_r('CASE WHEN c > 0 THEN (v - c) / c * 100 ELSE 0e0 END', 'gain_pct')} FROM lv", _LIVE))
def stream_portfolio(spark, sf):
    df = streams.run_to_table(streams.live_portfolio(streams.tick_stream(spark, sf), src.positions(spark, sf)), "totals", ["portfolio_id"], mode="append").as_of()
    return df.select("portfolio_id", *[r4(c, c) for c in ("value", "cost", "gain", "gain_pct")])


_CACHED = """req AS (SELECT event_type AS query, event_id AS request_id, ts FROM events),
an(query, ts) AS (SELECT query, min(ts) FROM req GROUP BY query UNION ALL SELECT an.query, min(req.ts) FROM an JOIN req ON req.query = an.query AND req.ts >= an.ts + INTERVAL 30 MINUTE GROUP BY an.query)"""


@query("stream_query_cache", f"WITH RECURSIVE {_CACHED} SELECT req.query, request_id, req.ts, an.ts = req.ts AND row_number() OVER (PARTITION BY req.query, req.ts ORDER BY request_id) = 1 AS answered, an.ts AS answered_at FROM req ASOF JOIN an ON an.query = req.query AND an.ts <= req.ts WHERE req.ts < (SELECT date_trunc('milliseconds', max(ts)) FROM req) - INTERVAL 30 MINUTE")
def stream_query_cache(spark, sf):
    requests = streams.tick_stream(spark, sf, "event_type as query", "event_id as request_id", "ts")
    df = streams.run_to_files(streams.cached_queries(requests), "answers")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "answered_at")})


@query("stream_market_hours", "SELECT event_id FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS ny FROM events) WHERE isodow(ny) <= 5 AND hour(ny) * 60 + minute(ny) BETWEEN 570 AND 959")
def stream_market_hours(spark, sf):
    return streams.run_to_files(streams.market_hours(streams.tick_stream(spark, sf)), "hours").select("event_id")


@query("stream_news_dedup", o.sql("art", "SELECT DISTINCT 'all' AS query, lower(title) AS title_lc FROM art WHERE pub IS NOT NULL"))
def stream_news_dedup(spark, sf):
    path = src.shared_path(spark, "news")
    rows = src.articles(spark, sf).withColumn("ts", fn.published(F.col("published_at"))).where("ts is not null")
    rows.select(F.lit("all").alias("query"), "article_id", "title", "ts").write.parquet(path)
    schema = "query string, article_id long, title string, ts timestamp"
    df = streams.run_to_files(streams.title_dedup(spark.readStream.schema(schema).parquet(path)), "news-once")
    return df.select("query", "title_lc")  # which of a title's articles comes first is up to the order of arrival
