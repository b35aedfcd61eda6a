"""Stored bars, recursive panels over long histories, seeded noise, rejected bars, feed files."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from test_operators import bars_of

from quantloom.operators import forecast
from quantloom.operators import indicators as ind
from quantloom.sources import bars as stored
from quantloom.sources import feeds, quarantine
from quantloom.sources import market as src

BAR = "symbol long, d date, open double, high double, low double, close double, volume double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(n.metrics().get("numFiles").get().value() for n in found if n.metrics().contains("numFiles"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Four years of bars: symbol 1 trades daily, 2 once a month, 3 ended two years ago, 4 has three bars only."""
    r, days = random.Random(1), [dt.date(1998, 1, 1) + dt.timedelta(days=i) for i in range(1460)]
    dates = {1: days, 2: [d for d in days if d.day == 5], 3: days[:700], 4: days[-3:]}
    rows = [(s, d, p, p + 1, p - 1, p, 10.0) for s, ds in dates.items() for d in ds for p in [r.uniform(10, 20)]]
    path = f"file://{tmp_path_factory.mktemp('store')}/bars"
    df = spark.createDataFrame(rows, BAR).repartition(4)
    stored.write(df.where("d < '2001-07-01'"), path)
    stored.write(df.where("d >= '2001-07-01'"), path, mode="append")
    return path, df


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "d", "open", "high", "low", "close", "volume").collect())


@pytest.mark.parametrize("k", [1, 5, 63, 700, 5000])
def test_last_bars_of_every_symbol(spark, store, k):
    path, df = store
    assert rows_of(stored.last(spark, path, k)) == rows_of(ind.lookback_bars(df, k))


@pytest.mark.parametrize("period", ["5d", "1mo", "1y", "5y"])
def test_calendar_lookbacks(spark, store, period):
    path, df = store
    assert rows_of(stored.lookback(spark, path, period, "2001-12-20")) == rows_of(ind.lookbacks(df, [period], "2001-12-20"))


def test_scans_are_pruned(spark, store):
    path, _ = store
    every = files_read(stored.read(spark, path))
    month = stored.lookback(spark, path, "1mo", "2001-12-20").select("d", "close")
    plan = plan_of(month)
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(d" in plan and "volume" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert files_read(month) <= every / 20
    last = stored.last(spark, path, 63)
    assert "PartitionFilters: [isnotnull(month" in plan_of(last)
    # Six months for all; for symbols 2 and 3 the older ones that they need.
    assert files_read(last) < every


def test_panels_over_a_long_history(spark):
    r = random.Random(5)
    prices = [100.0]
    while len(prices) < 10_000:
        prices.append(prices[-1] * math.exp(r.gauss(0, 0.02)))
    # One symbol with gaps of up to two years, and short ones.
    days, d = [], dt.date(1950, 1, 1)
    for i in range(10_000):
        days.append(d)
        d += dt.timedelta(days=700 if i % 4000 == 3999 else r.choice((1, 1, 1, 3)))
    rows = [("long", d, p) for d, p in zip(days, prices, strict=True)] + [("one", days[7], 5.0)] + [("short", days[i], 10.0 + i) for i in range(25)] + [("enough", days[i], 10.0 + i % 3) for i in range(26)]
    bars = spark.createDataFrame(rows, "symbol string, d date, close double").repartition(7)
    ema, macd = {}, {}
    for s in ("long", "one", "short", "enough"):
        fast = slow = None
        mark = 0.0
        for n, (_, day, x) in enumerate([x for x in rows if x[0] == s], 1):
            fast = x if fast is None else fast * (1 - 2 / 13) + x * 2 / 13
            slow = x if slow is None else slow * (1 - 2 / 27) + x * 2 / 27
            mark += (fast - slow - mark) * 0.2
            ema[s, day] = fast
            macd[s, day] = (fast - slow, mark, fast - slow - mark) if n >= 26 else (0.0, 0.0, 0.0)
    got = {(x.symbol, x.d): x.ema for x in ind.ema_panel(bars).collect()}
    assert got.keys() == ema.keys() and all(got[k] == pytest.approx(v, rel=1e-10) for k, v in ema.items())
    got = {(x.symbol, x.d): (x.macd, x.macd_signal, x.macd_hist) for x in ind.macd_panel(bars).collect()}
    assert got.keys() == macd.keys() and all(got[k] == pytest.approx(v, rel=1e-8, abs=1e-8) for k, v in macd.items())
    latest = {x.symbol: (x.macd, x.macd_signal, x.macd_hist) for x in ind.macd_latest(bars).collect()}
    assert latest["long"] == pytest.approx(macd["long", days[-1]], abs=1e-8)


def test_panels_deal_bars_by_block_and_without_python(spark):
    plan = plan_of(ind.macd_panel(bars_of(spark, a=range(1, 40))))
    assert "Python" not in plan and "Pandas" not in plan and "collect_list" not in plan
    assert "hashpartitioning(symbol" in plan and "_block" in plan


def test_panels_pass_over_the_bars_once(spark, sf_dir):
    """One scan and one exchange of the bars for rows and blocks, and no second pass for the signal."""
    df = ind.macd_panel(src.bars_long(spark, sf_dir))
    found = df.collect()
    plan = plan_of(df)
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("Scan parquet") == 1
    two = ind.macd_panel(src.bars_long(spark, sf_dir), 9, 26, 9)  # equal spans: the mean of the line itself
    assert two.count() == len(found) == src.bars_long(spark, sf_dir).count()


def test_a_signal_of_the_span_of_a_mean(spark):
    closes = [10.0 + (i * 7) % 11 for i in range(60)]
    for fast, slow, signal in ((9, 26, 9), (12, 26, 26), (12, 26, 11)):
        f = s = closes[0]
        g, expected = 0.0, []
        for n, x in enumerate(closes, 1):
            f, s = f + (x - f) * 2 / (fast + 1), s + (x - s) * 2 / (slow + 1)
            g += (f - s - g) * 2 / (signal + 1)
            expected.append((f - s, g) if n >= slow else (0.0, 0.0))
        got = [(x.macd, x.macd_signal) for x in ind.macd_panel(bars_of(spark, a=closes), fast, slow, signal).orderBy("d").collect()]
        assert [y for x in got for y in x] == pytest.approx([y for x in expected for y in x], abs=1e-10)


def test_noise_is_the_same_however_rows_are_dealt_out(spark):
    bars = bars_of(spark, **{f"s{i}": [10 + i] * 25 for i in range(8)})
    rows = [{(r.symbol, r.step): r.yhat for r in forecast.moving_average(bars.repartition(n), seed=3).collect()} for n in (4, 7)]
    assert rows[0] == rows[1] and len(set(rows[0].values())) == 240
    assert {(r.symbol, r.step): r.yhat for r in forecast.moving_average(bars, seed=4).collect()} != rows[0]
    drawn = spark.range(40_000).select(forecast.normal(1, F.col("id"), F.lit(3)).alias("x")).agg(F.avg("x"), F.stddev("x"), F.skewness("x"), F.kurtosis("x"), F.max(F.abs("x"))).first()
    assert abs(drawn[0]) < 0.02 and abs(drawn[1] - 1) < 0.02 and abs(drawn[2]) < 0.05 and abs(drawn[3]) < 0.1 and 3.5 < drawn[4] < 6


def test_rollout_noise(spark):
    r = random.Random(4)
    bars = bars_of(spark, **{s: [100.0 + 5 * math.sin(i / 7 + k) + r.random() for i in range(70)] for k, s in enumerate("abc")})
    model, rows = forecast.fit_forest(bars, trees=4, depth=4)
    plain, noisy, again = ({(x.symbol, x.step): x.yhat for x in forecast.roll_out(model, rows.repartition(p), noise=n).collect()} for p, n in ((2, None), (3, 11), (5, 11)))
    assert noisy == pytest.approx(again) and noisy != pytest.approx(plain)
    close = {x.symbol: x.label for x in ind.latest(rows).collect()}
    shift = {(x.symbol): x.z for x in spark.createDataFrame([(s,) for s in "abc"], "symbol string").select("symbol", forecast.normal(11, F.col("symbol"), F.lit(1)).alias("z")).collect()}
    for s in "abc":
        assert noisy[s, 1] == pytest.approx(plain[s, 1] + 0.015 * close[s] * shift[s])


def test_rejected_bars(spark):
    d = [dt.date(2001, 1, i) for i in range(1, 9)]
    nan = float("nan")
    rows = [
        (1, d[0], 5.0, 6.0, 4.0, 5.0, 1.0), (1, d[1], None, 6.0, 4.0, 5.0, 1.0), (1, d[2], 5.0, nan, 4.0, 5.0, 1.0), (1, d[3], -5.0, 6.0, 0.0, 5.0, nan), (1, d[4], 5.0, 3.0, 4.0, 5.0, None),
        (1, d[5], 5.0, 6.0, 4.0, 5.0, 1.0), (1, d[5], 5.0, 6.0, 4.0, 4.5, 1.0), (1, d[5], 5.0, 6.0, 4.0, nan, 1.0), (2, d[5], 5.0, 6.0, 4.0, 5.0, 0.0), (None, d[5], 5.0, 6.0, 4.0, 5.0, 1.0), (2, d[6], 1.0, 1.0, 1.0, 1.0, 2.0), (2, d[6], 1.0, 1.0, 1.0, 1.0, 2.0),
    ]
    seen = None
    for n in (1, 5):
        r = random.Random(n)
        df = spark.createDataFrame(r.sample(rows, len(rows)), BAR).repartition(n)
        checked, counts = quarantine.observed(quarantine.checked(df), f"bars{n}")
        found = sorted(map(str, checked.collect()))
        assert seen is None or found == seen
        seen = found
        good, bad = quarantine.clean(quarantine.checked(df)), quarantine.rejected(quarantine.checked(df))
        assert good.count() + bad.count() == len(rows)
        assert counts.get == {"rows": 12, "clean": 4, "no symbol or day": 1, "missing price": 3, "price not positive": 1, "high below low": 1, "bad volume": 2, "repeated day": 2}
        assert {(x.symbol, x.d, x.close) for x in good.collect()} == {(1, d[0], 5.0), (1, d[5], 4.5), (2, d[5], 5.0), (2, d[6], 1.0)}
        assert good.columns == df.columns
    assert quarantine.checked(spark.createDataFrame([], BAR)).count() == 0


def test_indicators_of_careless_bars_do_not_depend_on_order(spark, sf_dir):
    raw = src.raw_bars(spark, sf_dir).where("symbol <= 3")
    rows = [{(r.symbol, r.d): r.rsi for r in ind.rsi(ind.numbered(quarantine.clean(quarantine.checked(raw.repartition(n))))).collect()} for n in (1, 6)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000


def test_feed_files(spark, tmp_path):
    schema = "article_id long, title string, description string, source struct<name:string>, published_at string"
    rows = [(1, "A & B <c>", "text\nof two lines", ("src",), "Mon, 01 Jan 2024 10:00:00 GMT"), (2, "no description", None, None, None), (3, None, "日本 \"x\"", ("s",), "unknown")]
    path = f"file://{tmp_path}/feed"
    feeds.write(spark.createDataFrame(rows, schema), path)
    found = {r.article_id: (r.title, r.description, r.source.name, r.published_at) for r in feeds.read(spark, path, "primary").collect()}
    assert found == {i: (t, d, s and s[0], p) for i, t, d, s, p in rows}
    assert feeds.read(spark, f"file://{tmp_path}/nowhere", "primary").count() == 0
    (tmp_path / "feed" / "a.xml").write_text("<rss><channel><item><guid>7</guid><title>good</title></item><item><guid>8</guid><title>cut o")
    (tmp_path / "feed" / "b.xml").write_text("no xml at all < & >")
    (tmp_path / "feed" / "c.xml").write_text("")
    (tmp_path / "feed" / "d.xml").write_text("<rss><item><guid>x9</guid><title>text id</title><link>unread</link><source url='u'>named</source></item><item><guid>10</guid></item></rss>")
    got = {(r.article_id, r.title) for r in feeds.read(spark, path, "primary").collect()}
    assert {(1, "A & B <c>"), (7, "good"), (None, "text id")} <= got and not any(i in (8, 10) for i, _ in got)
    stream = feeds.read_stream(spark, path, "backup")
    stream.writeStream.format("memory").queryName("feed_rows").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert {(r.article_id, r.title) for r in spark.table("feed_rows").collect()} == got


def test_landed_tables_have_declared_schemas_and_dates_reach_the_scan(spark, sf_dir):
    from quantloom import schemas

    for name in schemas.LANDED:
        declared, found = src.read(spark, sf_dir, name).schema, spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        assert {(f.name, f.dataType) for f in declared} == {(f.name, f.dataType) for f in found}
    recent = src.bars_long(spark, sf_dir, "2001-10-01")
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(recent)
    assert rows_of(recent) == rows_of(src.bars_long(spark, sf_dir).where("d >= '2001-10-01'"))
