"""Golden cases, rule branches and properties of the analytics operators."""

import datetime as dt
import math
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.functions import text as fn
from quantloom.operators import cards, forecast, news, portfolio, scan
from quantloom.operators import indicators as ind
from quantloom.sources import market as src
from quantloom.streaming import streams

START = dt.date(2001, 1, 1)


def bars_of(spark, **series):
    rows = [(s, START + dt.timedelta(days=i), float(p), float(p), float(p), float(p), 10.0) for s, prices in series.items() for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double")


def by_symbol(df, column):
    return {r["symbol"]: r[column] for r in df.collect()}


def test_rsi_golden(spark):
    bars = bars_of(spark, short=range(1, 15), rising=range(1, 16), flat=[5] * 15, falling=range(30, 15, -1), alternating=[10 + i % 2 for i in range(15)])
    got = by_symbol(ind.latest(ind.rsi(ind.numbered(bars))), "rsi")
    assert got == {"short": 50.0, "rising": 100.0, "flat": 100.0, "falling": 0.0, "alternating": 50.0}


def test_macd_golden(spark):
    bars = bars_of(spark, short=range(1, 26), constant=[7] * 30, rising=range(1, 31))
    got = by_symbol(ind.macd_latest(bars), "macd")
    assert got["short"] == 0 and got["constant"] == 0 and got["rising"] > 0


def test_bollinger_golden(spark):
    bars = bars_of(spark, constant=[7] * 20, short=range(1, 20))
    rows = {r.symbol: (r.bb_lower, r.bb_mid, r.bb_upper) for r in ind.latest(ind.bollinger(ind.numbered(bars))).collect()}
    assert rows == {"constant": (7.0, 7.0, 7.0), "short": (19.0, 19.0, 19.0)}


def test_ema_latest_equals_panel(spark):
    bars = bars_of(spark, a=[3, 5, 4, 8, 2], b=[1])
    last = by_symbol(ind.ema_latest(bars, 3), "ema")
    panel = {r.symbol: r.ema for r in ind.ema_panel(bars, 3).orderBy("d").collect()}
    assert last == pytest.approx(panel)


def test_momentum_needs_history(spark):
    got = {r.symbol: (r.week, r.month) for r in ind.latest(ind.momentum(ind.numbered(bars_of(spark, four=[1, 2, 3, 4], five=[1, 2, 3, 4, 5])))).collect()}
    assert got == {"four": (0.0, 0.0), "five": (4.0, 0.0)}


def test_scan_drops_short_histories_and_keeps_boundaries(spark):
    bars = bars_of(spark, a19=range(1, 20), a20=range(1, 21))
    quotes = spark.createDataFrame([], "symbol string, longName string, trailingPE double, earningsGrowth double, profitMargins double")
    got = scan.market_scan(bars, quotes).collect()
    assert [r.symbol for r in got] == ["a20"] and got[0].name == "a20" and got[0].pe == 0.0
    assert got[0].total_score == got[0].tech_score + got[0].fund_score + got[0].ml_score


@pytest.mark.parametrize("pe, growth, margin, expected", [
    (0.0, 0.0, 0.0, 0), (14.9, None, None, 2), (15.0, None, None, 1), (24.9, None, None, 1), (25.0, None, None, 0), (35.0, None, None, 0), (35.1, None, None, -2), (-3.0, None, None, 0),
    (None, 0.151, None, 2), (None, 0.15, None, 1), (None, 0.05, None, 0), (None, -0.1, None, 0), (None, -0.11, None, -2), (None, None, 0.15, 0), (None, None, 0.151, 1), (10.0, 0.2, 0.2, 5),
])
def test_fundamental_rules(spark, pe, growth, margin, expected):
    df = spark.createDataFrame([(pe, growth, margin)], "trailingPE double, earningsGrowth double, profitMargins double")
    assert df.select(scan.score(scan.fund_rules())).first()[0] == expected


@pytest.mark.parametrize("rsi, close, m20, m50, spike, expected", [
    (29.9, 10.0, 9.0, 8.0, True, 6), (30.0, 10.0, 9.0, 9.5, False, 3), (40.0, 9.0, 9.0, 9.0, False, 0), (60.0, 8.0, 9.0, 9.0, False, -1), (60.1, 8.0, 9.0, 9.0, False, -3), (70.1, 8.0, 9.0, 9.0, False, -4),
])
def test_technical_rules(spark, rsi, close, m20, m50, spike, expected):
    df = spark.createDataFrame([(rsi, close, m20, m50, spike)], "rsi double, close double, ma_20 double, ma_50 double, volume_spike boolean")
    assert df.select(scan.score(scan.tech_rules())).first()[0] == expected


@pytest.mark.parametrize("week, month, expected", [(0.0, 0.151, 3), (0.0, 0.15, 1), (0.051, 0.05, 1), (-0.051, -0.051, -2), (0.0, -0.151, -3)])
def test_momentum_rules(spark, week, month, expected):
    df = spark.createDataFrame([(week, month)], "week double, month double")
    assert df.select(scan.score(scan.momentum_rules())).first()[0] == expected


def test_strong_sell_never_fires(spark, sf_dir):
    bars = src.bars_long(spark, sf_dir)
    assert scan.signals(bars, src.quotes(spark, sf_dir, bars)).where("signal = 'STRONG SELL'").count() == 0


def test_valuation_edges(spark):
    rows = [("neg", -5.0, -1.0, 0.0, 0.0), ("none", None, None, None, None), ("all", 19.0, 0.9, 0.2, 0.2), ("zero", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, trailingPE double, pegRatio double, earningsGrowth double, profitMargins double")
    got = {r.symbol: (r.val_score, r.valuation) for r in scan.valuation(df).collect()}
    assert got == {"neg": (3, "FAIRLY VALUED"), "none": (0, "OVERVALUED"), "all": (5, "UNDERVALUED"), "zero": (0, "OVERVALUED")}


def test_indicators_share_one_exchange(spark, sf_dir):
    bars = src.materialize(src.bars_long(spark, sf_dir), "test-bars")
    df = ind.volume_spike(ind.momentum(ind.bollinger(ind.sma(ind.rsi(ind.numbered(bars)), 20))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_scan_does_not_depend_on_partitions(spark, sf_dir):
    bars = src.bars_long(spark, sf_dir)
    first = scan.market_scan(bars, src.quotes(spark, sf_dir, bars)).toPandas().sort_values("symbol").reset_index(drop=True)
    moved = bars.repartition(7)
    again = scan.market_scan(moved, src.quotes(spark, sf_dir, moved)).toPandas().sort_values("symbol").reset_index(drop=True)
    assert first.astype(str).equals(again.astype(str))


def test_position_without_quote_is_shown_but_not_counted(spark):
    positions = spark.createDataFrame([(1, "a", 2.0, 5.0), (1, "b", 1.0, 5.0), (1, "c", 1.0, 0.0), (1, "a", 0.0001, 5.0)], "portfolio_id long, symbol string, shares double, buy_price double")
    quotes = spark.createDataFrame([("a", None, None), ("c", 3.0, 4.0)], "symbol string, currentPrice double, regularMarketPrice double")
    rows = portfolio.valued(positions, quotes)
    assert {r.symbol: (r.value, r.counted, r.gain_pct) for r in rows.collect()} == {"a": (10.0, True, 0.0), "b": (5.0, False, 0.0), "c": (3.0, True, 0.0)}
    assert portfolio.totals(rows).first().value == 13.0


@pytest.mark.parametrize("content, expected", [('[{"symbol":"A","shares":1.5,"buy_price":2}]', 1), ('{"symbol":"A"}', 0), ('[{"symbol":"A"', 0), ("[]", 0), ("nonsense", 0)])
def test_tolerant_json(spark, tmp_path, content, expected):
    path = tmp_path / "p.json"
    path.write_text(content)
    assert src.json_list(spark, f"file://{path}").where("symbol is not null").count() == expected


def test_missing_json_is_empty(spark, tmp_path):
    assert src.json_list(spark, f"file://{tmp_path}/none.json").count() == 0


def test_json_list_of_strings(spark, tmp_path):
    (tmp_path / "w.json").write_text('["A", "B"]')
    assert {r.symbol for r in src.json_list(spark, f"file://{tmp_path}/w.json", "array<string>").collect()} == {"A", "B"}


def test_linear_forecast_of_a_line_is_exact(spark):
    bars = bars_of(spark, line=[3 + 2 * i for i in range(10)], one=[4])
    got = {(r.symbol, r.step): r.yhat for r in forecast.linear(bars).collect()}
    assert got["line", 1] == pytest.approx(23.0) and got["line", 30] == pytest.approx(81.0) and got["one", 5] == 4.0


def test_published_times(spark):
    rows = [("2024-01-30T12:00:00Z",), ("2024-01-30T12:00:00+02:00",), ("Tue, 30 Jan 2024 12:00:00 GMT",), ("Tue, 30 Jan 2024 12:00:00 +0200",), ("unknown",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "published_at string").select(fn.published(F.col("published_at")).cast("string")).collect()]
    assert got == ["2024-01-30 12:00:00", "2024-01-30 10:00:00", "2024-01-30 12:00:00", "2024-01-30 10:00:00", None, None]


def test_time_ago_future_is_now(spark):
    df = spark.createDataFrame([("2024-02-01T00:00:00Z",), ("",), (None,)], "published_at string")
    asof = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    assert [r[0] for r in df.select(fn.time_ago(F.col("published_at"), fn.published(F.col("published_at")), asof)).collect()] == ["0m ago", "Recent", "Recent"]


def test_relevance_without_terms_is_zero(spark):
    articles = spark.createDataFrame([(1, "the and", "of"), (2, "market news", None)], "article_id long, title string, description string")
    got = {r.article_id: r.similarity for r in news.similarity(articles, [("market", 5)]).collect()}
    assert got[1] == 0.0 and 0 < got[2] < 1


ART = "article_id long, title string, description string, source struct<name:string>, published_at string, feed string, pos long"


def test_news_for_queries_end_to_end(spark):
    at = "2024-01-30T12:00:00Z"
    rows = [(i, f"Oil and gas {i}", "x", None, at, "primary", i) for i in range(7)] + [(20, "AAPL rises", None, None, at, "primary", 20), (21, None, "Nothing of AAPL here", None, at, "backup", 21)]
    rows += [(30 + i, t, "d", None, at, "backup", 30 + i) for i, t in enumerate(["Merger talk", "merger talk", "AAPL RISES", "Old", None])] + [(40, "AAPL old", "d", None, "2023-01-01T00:00:00Z", "primary", 40)]
    df = spark.createDataFrame(rows, ART)
    got = {}
    for r in news.merged(df, [("energy oil gas stocks", 6), ("AAPL stock", 4), ("all", 3)], "2024-01-31 00:00:00").collect():
        got.setdefault(r.query, []).append((r["rank"], r.article_id, r.feed))
    assert sorted(got["energy oil gas stocks"]) == [(i + 1, i, "primary") for i in range(6)]  # enough, so no backup
    assert sorted(got["all"]) == [(i + 1, i, "primary") for i in range(3)]
    ours = sorted(got["AAPL stock"])
    # A search of the backup feed finds 21 and 32, and 32 repeats a title.
    assert ours == [(1, 20, "primary"), (2, 21, "backup")]
    assert news.fetched(df, [("AAPL stock", 4)], "2024-01-31 00:00:00").count() == 1
    scored = {r.article_id: r.relevance for r in news.relevance(df, [("AAPL stock", 4)], "2024-01-31 00:00:00").collect()}
    assert scored[21] == 0.5 and scored[20] > scored[30]
    with pytest.raises(ValueError):
        news.asked(df, [("a", 1)] * 1001)


def test_merged_news_has_few_exchanges(spark, sf_dir):
    plan = news.merged(src.articles(spark, sf_dir), [("all", 5), ("REA stock", 5)], "2024-01-31 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.split("Initial Plan")[0].count("Exchange") <= 8


def test_json_lists_come_back(spark, tmp_path):
    rows = [(1, "A", 1.5, 2.0), (1, "B", 0.1, 3.25), (2, "A", 7.0, None)]
    df = spark.createDataFrame(rows, "portfolio_id long, symbol string, shares double, buy_price double")
    path = f"file://{tmp_path}/lists"
    for _ in range(2):
        src.write_json(df, path, "portfolio_id")
    assert sorted(map(str, src.json_list(spark, path, whole=False).collect())) == sorted(str(r) for r in df.drop("portfolio_id").collect())


@pytest.mark.parametrize("start", ["observed", "next"])
def test_forest_rolls_out_like_plain_python(spark, start):
    from pyspark.ml.linalg import Vectors

    r = random.Random(4)
    lines = {s: [100.0 + 5 * math.sin(i / 7 + k) + r.random() for i in range(70)] for k, s in enumerate("abc")}
    model, rows = forecast.fit_forest(bars_of(spark, **lines), trees=4, depth=4)
    last = {}
    for row in rows.collect():
        if row.symbol not in last or row.n > last[row.symbol].n:
            last[row.symbol] = row
    expected = {}
    for s, row in last.items():
        prev, means = row.f_prev, {k: row[f"f_ma{k}"] for k in (5, 10, 20)}
        if start == "next":
            prev, means = row.label, {k: (m * (k - 1) + row.label) / k for k, m in means.items()}
        for step in range(1, 31):
            y = model.predict(Vectors.dense([*(means[k] / prev for k in (5, 10, 20)), row.f_rsi, row.f_volume, row.f_momentum])) * prev
            expected[s, step] = y
            prev, means = y, {k: (m * (k - 1) + y) / k for k, m in means.items()}
    got = {(x.symbol, x.step): x.yhat for x in forecast.roll_out(model, rows, start).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in expected.items())
    again = {(x.symbol, x.step): x.yhat for x in forecast.forest(bars_of(spark, **lines), trees=4, depth=4, start=start).collect()}
    assert again.keys() == expected.keys()


def test_forest_keeps_places_in_trees_without_changing_them(spark):
    from pyspark.ml.regression import RandomForestRegressor

    r = random.Random(8)
    model, rows = forecast.fit_forest(bars_of(spark, **{f"s{k}": [100.0 + 5 * math.sin(i / 7 + k) + r.random() for i in range(60)] for k in range(3)}), trees=4, depth=5)
    plain = RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=4, maxDepth=5, seed=42, cacheNodeIds=False).fit(forecast._packed(rows))
    assert model.getCacheNodeIds() and plain.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]


def arriving(spark, folder, files, schema):
    """A stream that reads one file a batch, in order."""
    for k, rows in enumerate(files):
        path = f"{folder}/in/{k}"
        spark.createDataFrame(rows, schema).selectExpr("*").coalesce(1).write.mode("overwrite").json(path)
        for f in Path(path).glob("part-*"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def test_late_ticks_are_dropped(spark, tmp_path):
    schema = "symbol long, ts timestamp, price double, event_id long"
    files = [[(1, at(1, 1), 5.0, 1), (1, at(1, 5), 7.0, 2)], [(1, at(1, 3), 9.0, 3), (1, at(6), 1.0, 4)], [(1, at(6, 1), 1.5, 9)], [(1, at(1, 4), 99.0, 5), (1, at(6, 2), 2.0, 6)], [(1, at(12), 3.0, 7)], [(1, at(20), 3.0, 8)]]
    got = {r.start.day: (r.open, r.high, r.close, r.ticks) for r in streams.run_to_files(streams.bars(arriving(spark, tmp_path, files, schema)), "late-bars").collect()}
    assert got[1] == (5.0, 9.0, 7.0, 3)  # the tick in the second file is in time, that in the fourth is not
    assert got[6] == (1.0, 2.0, 2.0, 3)


def test_titles_come_back_after_the_horizon(spark, tmp_path):
    schema = "query string, article_id long, title string, ts timestamp"
    files = [[("q", 1, "News", at(1))], [("q", 2, "NEWS", at(3)), ("p", 3, "News", at(3))], [("q", 4, "Other", at(15))], [("q", 5, "Last", at(16))], [("q", 6, "news", at(17)), ("q", 7, "last", at(18))]]
    got = {r.article_id for r in streams.run_to_files(streams.title_dedup(arriving(spark, tmp_path, files, schema)), "late-titles").collect()}
    assert got == {1, 3, 4, 5, 6}


def test_market_value_text(spark):
    df = spark.createDataFrame([(1.0e9,), (1.5e9,), (None,)], "m double")
    assert [r[0] for r in df.select(cards.billions(F.col("m"))).collect()] == ["N/A", "$1.50B", "N/A"]
