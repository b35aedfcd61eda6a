"""The forest grown by counting, and the features it is grown on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import bars_of

from quantloom.operators import forecast, forest
from quantloom.operators import indicators as ind
from quantloom.sources import market as src

COLUMNS = ("a", "b", "c")


def waves(n=4, bars=80):
    r = random.Random(5)
    return {f"s{k}": [100.0 + 5 * math.sin(i / 7 + k) + r.random() for i in range(bars)] for k in range(n)}


def table(spark, n=600, seed=3):
    r = random.Random(seed)
    rows = [(i, r.random(), float(r.randrange(5)), r.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame([(*x, (x[1] > 0.4) + 0.3 * x[2] + 0.1 * x[3] + 0.05 * r.random()) for x in rows], "k long, a double, b double, c double, y double")


def grown(rows, **more):
    return forest.grow(rows, COLUMNS, "y", [F.col("k")], **({"trees": 6, "depth": 4} | more))


def same(a, b):
    return all((x == y).all() for x, y in zip(a.cuts, b.cuts)) and all((x == y).all() for s, t in zip(a.splits, b.splits) for x, y in zip(s, t)) and np.array_equal(a.values, b.values)


def test_forecasts_do_not_depend_on_how_rows_are_dealt(spark):
    bars, found = bars_of(spark, **waves()), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 1):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append({(x.symbol, x.step): x.yhat for x in forecast.forest(bars, trees=4, depth=4).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[0]) == 120 and found[0] == found[1]


def test_blocks_of_any_size_give_the_same_forest(spark, monkeypatch):
    rows = table(spark)
    whole = grown(rows.repartition(1))
    assert same(whole, grown(rows.repartition(5, "k")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        monkeypatch.setattr(forest, "NODES", 2)
        assert same(whole, grown(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not same(whole, grown(rows, seed=43))


def test_nodes_are_split_where_the_variance_falls_most(spark):
    rows = table(spark).withColumn("h", F.xxhash64(F.lit(42), "k")).orderBy("k").toPandas()
    model = grown(table(spark))
    hashes, y, x = rows.h.to_numpy().view(np.uint64), rows.y.to_numpy(), np.stack([rows[c] for c in COLUMNS])
    leaves = 0
    for tree in range(6):
        weight = forest._poisson()[forest._mixed(hashes, tree // 4)[tree % 4]].astype(float)
        assert 0.85 < weight.mean() < 1.15 and set(weight) >= {0.0, 1.0, 2.0}
        nodes = {0: np.ones(len(y), bool)}
        for column, cut in model.splits:
            below = {}
            for node, here in nodes.items():
                c = column[tree, node]
                if c < 0:
                    below[2 * node] = here
                    continue
                falls = []
                for at in model.cuts[c]:
                    sides = [here & (weight > 0) & (x[c] <= at), here & (weight > 0) & (x[c] > at)]
                    sums = [(weight[s].sum(), (weight * y)[s].sum()) for s in sides]
                    falls.append(sum(t * t / n for n, t in sums) if all(n for n, _ in sums) else -1)
                assert falls[cut[tree, node]] == pytest.approx(max(falls), rel=1e-9)
                below[2 * node], below[2 * node + 1] = here & (x[c] <= model.cuts[c][cut[tree, node]]), here & (x[c] > model.cuts[c][cut[tree, node]])
            nodes = below
        for node, here in nodes.items():
            leaves += 1
            assert model.values[tree, node] == pytest.approx((weight * y)[here].sum() / weight[here].sum(), abs=1e-8)
    assert leaves > 60


def test_the_forest_is_as_close_as_that_of_mllib(spark):
    bars = bars_of(spark, **waves(6, 200))
    model, rows = forecast.grow_forest(bars, trees=20, depth=6)
    other, _ = forecast.fit_forest(bars, trees=20, depth=6)
    off = [m.transform(forecast._packed(rows)).agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2)), F.var_pop("target")).first() for m in (model, other)]
    assert off[0][0] < off[0][1] / 2 and off[0][0] == pytest.approx(off[1][0], rel=0.1)


def test_predictions_are_those_of_plain_python(spark):
    model = grown(table(spark), trees=5, depth=6)
    got = {r.k: r.prediction for r in model.transform(table(spark, 50, 9)).collect()}
    for r in table(spark, 50, 9).collect():
        total = 0.0
        for tree in range(5):
            node = 0
            for column, cut in model.splits:
                c = column[tree, node]
                node = 2 * node + (c >= 0 and r[COLUMNS[c]] > model.cuts[c][cut[tree, node]])
            total += model.values[tree, node]
        assert got[r.k] == pytest.approx(total / 5)


def test_tables_without_much_to_learn(spark):
    schema = "k long, a double, b double, c double, y double"
    assert grown(spark.createDataFrame([], schema)).splits == []
    one = grown(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 7.0)], schema))
    assert (one.values == 7.0).all()
    flat = grown(spark.createDataFrame([(i, float(i), 0.0, 1.0, 3.5) for i in range(40)], schema))
    assert (flat.values == 3.5).all() and all((c < 0).all() for c, _ in flat.splits)
    bad = [(900, None, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0), (902, 1.0, float("inf"), 1.0, 1.0), (903, 1.0, 1.0, 1.0, float("-inf")), (904, 1.0, 1.0, 1.0, None)]
    assert same(grown(table(spark)), grown(table(spark).union(spark.createDataFrame(bad, schema))))
    with pytest.raises(ValueError):
        grown(table(spark), depth=0)
    assert forecast.forest(bars_of(spark, short=range(1, 10))).collect() == []


def test_features_do_not_depend_on_batches(spark):
    nan = float("nan")
    closes = [5.0, None, nan, 0.0] + [100.0 + i % 9 for i in range(30)] + [None, 4.0, nan, 3.0] * 3 + [50.0 + i % 7 for i in range(60)]
    rows = [(s, i, c if s else 2 * (c or 1.0), None if i % 11 == s else float(i % 5)) for s in range(3) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "symbol int, i int, close double, volume double").withColumn("d", F.expr("date_add(date'2001-01-01', i)"))
    whole = sorted(map(str, ind.feature_panel(bars).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, ind.feature_panel(bars).collect())) == whole and len(whole) == 3 * (len(closes) - 20)
        cut = sorted(map(str, ind.feature_panel(bars, 30).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == sorted(map(str, ind.feature_panel(bars).where("n > cnt - 30").collect())) and len(cut) == 90


def test_features_of_missing_values(spark):
    closes = [None if i == 15 else 10.0 + i for i in range(22)]
    bars = spark.createDataFrame([("a", i, c, 0.0 if i < 20 else 5.0) for i, c in enumerate(closes)], "symbol string, i int, close double, volume double").withColumn("d", F.expr("date_add(date'2001-01-01', i)"))
    first, last = ind.feature_panel(bars).orderBy("n").collect()
    assert (first.n, first.f_prev, first.f_ma5, first.f_volume, first.f_momentum) == (21, 29.0, pytest.approx((26 + 27 + 28 + 29) / 4), 1.0, 0.0)
    assert last.f_rsi == 100.0 and last.f_volume == pytest.approx(10.0) and last.f_momentum == pytest.approx(4 / 26) and last.label == 31.0


def test_features_are_those_of_windows(spark, sf_dir):
    bars = src.bars_long(spark, sf_dir)
    frame = lambda k: F.avg("close").over(ind.last_rows(k, 1))
    expected = ind.rsi(ind.numbered(bars)).withColumns({"f_ma20": frame(20), "f_rsi": F.lag("rsi").over(ind.by_symbol())}).where("n >= 21").select("symbol", "d", "n", "f_ma20", "f_rsi")
    got = ind.feature_panel(bars).select(*expected.columns)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0
