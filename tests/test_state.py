"""Keyed state: answers that serve repeated queries, running totals, tables of changes, rolled-up bars."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import arriving, at

from quantloom.operators.portfolio import totals, valued
from quantloom.sources.changes import ChangeTable
from quantloom.streaming import streams

REQUEST = "query string, request_id long, ts timestamp"


def answers_of(rows, age):
    """By the definition, in order of time."""
    last, out = {}, set()
    for q, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        fresh = q not in last or ts - last[q] >= age
        if fresh:
            last[q] = ts
        out.add((q, i, fresh, last[q]))
    return out


def test_answers_serve_half_an_hour(spark, tmp_path):
    m = lambda minutes, day=1: at(day) + dt.timedelta(minutes=minutes)
    files = [
        [("a", 1, m(0)), ("a", 2, m(20)), ("b", 3, m(25)), (None, 11, m(3)), (None, 12, m(4))],
        [("a", 4, m(40)), ("a", 5, m(29.999))],  # 40 minutes after the answer; a served request in between doesn't make it last longer
        [("a", 6, m(5, 2)), ("a", 7, m(69, 1))],  # a day and five minutes after the first: answered anew; 7 is late but in time
        [("a", 8, m(34.9, 2)), ("a", 9, m(35, 2))],
        [("a", 90, m(0, 9))], [("a", 91, m(0, 1)), ("a", 92, m(0, 20))], [("c", 93, m(0, 21))],  # 91 is behind the watermark
    ]
    found = streams.run_to_files(streams.cached_queries(arriving(spark, tmp_path, files, REQUEST)), "answers").collect()
    rows = [r for f in files[:4] for r in f] + [files[4][0], files[5][1]]
    aware = lambda t: t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t
    assert {(r.query, r.request_id, r.answered, aware(r.answered_at)) for r in found} == answers_of(rows, dt.timedelta(minutes=30))
    assert {r.request_id: r.answered for r in found}[6] is True


def test_answers_do_not_depend_on_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("abc"), i, at(1) + dt.timedelta(seconds=r.randint(0, 40_000))) for i in range(300)]
    end = [("z", 999, at(8))]
    expected = answers_of(rows, dt.timedelta(minutes=30))
    for k, size in enumerate((300, 60)):
        ordered = sorted(rows, key=lambda x: x[2]) if size < 300 else rows
        files = [ordered[i : i + size] for i in range(0, 300, size)]
        if size < 300:
            for f in files:
                r.shuffle(f)
        found = streams.run_to_files(streams.cached_queries(arriving(spark, f"{tmp_path}/{k}", [*files, end], REQUEST)), "answers").collect()
        aware = lambda t: t.replace(tzinfo=dt.timezone.utc)
        assert {(x.query, x.request_id, x.answered, aware(x.answered_at)) for x in found} == expected


def test_a_popular_query_is_spread_over_its_slots(spark, tmp_path):
    """Most requests of a query in one slot, more than travel as one row, and equal times."""
    r = random.Random(4)
    rows = [("a", i, at(1) + dt.timedelta(seconds=r.choice((r.randint(0, 20_000), r.randint(3600, 3700))))) for i in range(700)]
    stream = streams.cached_queries(arriving(spark, tmp_path, [rows, [("z", 999, at(8))]], REQUEST))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 2 and "slot" in plan and streams.PIECE < 300
    found = streams.run_to_files(stream, "answers").collect()
    aware = lambda t: t.replace(tzinfo=dt.timezone.utc)
    assert len(found) == 700 and {(x.query, x.request_id, x.answered, aware(x.answered_at)) for x in found} == answers_of(rows, dt.timedelta(minutes=30))


TICK = "symbol string, ts timestamp, price double, event_id long"


def test_live_totals_follow_each_batch(spark, tmp_path):
    r = random.Random(6)
    held = [(p, r.choice("ABCDE"), round(r.uniform(0, 9), 3), round(r.uniform(1, 50), 2)) for p in range(12) for _ in range(r.randint(1, 5))] + [(50, "NONE", 1.0, 1.0), (51, "A", 0.0001, 9.0)]
    positions = spark.createDataFrame(held, "portfolio_id long, symbol string, shares double, buy_price double")
    ticks = [(r.choice("ABCDE"), at(1) + dt.timedelta(seconds=r.randint(0, 90_000)), round(r.uniform(1, 60), 2), i) for i in range(80)] + [("A", at(3), None, 900), (None, at(3), 5.0, 901), ("A", at(2, 3), 7.0, 902), ("A", at(2, 3), 8.0, 903)]
    files = [ticks[i : i + 17] for i in range(0, len(ticks), 17)]
    live = streams.live_portfolio(arriving(spark, tmp_path, files, TICK), positions)
    assert live.isStreaming
    seen, state = [], {}

    def each(batch, number, path):
        state.update({x.portfolio_id: (x.value, x.cost, x.gain, x.gain_pct) for x in batch.collect()})
        seen.append(dict(state))

    streams.run_batches(live, "live", each, "append")
    assert len(seen) == len(files)
    for k, now in enumerate(seen):
        so_far = spark.createDataFrame([t for f in files[: k + 1] for t in f], TICK).where("price is not null and symbol is not null")
        quotes = so_far.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("currentPrice")).withColumn("regularMarketPrice", F.lit(None).cast("double"))
        batch = {x.portfolio_id: (x.value, x.cost, x.gain, x.gain_pct) for x in totals(valued(positions, quotes)).collect()}
        assert now.keys() == batch.keys()
        assert all(now[p] == pytest.approx(v, abs=1e-8) for p, v in batch.items())


def test_states_of_live_totals_meet_combined_rows(spark, tmp_path):
    """Ticks of a symbol and changes of a portfolio are added up over Arrow before the states, which take a row at a time."""
    positions = spark.createDataFrame([(p, s, 1.0, 2.0) for p in range(3) for s in "ABC"], "portfolio_id long, symbol string, shares double, buy_price double")
    live = streams.live_portfolio(arriving(spark, tmp_path, [[("A", at(1), 1.0, 1)]], TICK), positions)
    plan = live._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2
    r = random.Random(3)
    ticks = [(r.choice("ABCD"), r.random(), r.randint(0, 20), i) for i in range(500)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("symbol", "price", "at", "event_id"), t, strict=True)) for t in ticks[i : i + 90]]) for i in range(0, 500, 90)]
    rows = [tuple(x.values()) for b in streams._combining(streams._latest_ticks)(iter(batches)) for x in b.to_pylist()]
    assert sorted(rows) == sorted(max((t for t in ticks if t[0] == s), key=lambda t: t[2:]) for s in "ABCD")
    changes = pa.RecordBatch.from_pylist([{"portfolio_id": p, "value": v, "cost": c} for p, v, c in [(1, 1.0, 2.0), (None, 4.0, None), (1, 0.5, None), (2, None, None)]])
    rows = [tuple(x.values()) for b in streams._combining(streams._sums)(iter([changes, changes])) for x in b.to_pylist()]
    assert sorted(rows, key=str) == [(1, 3.0, 4.0), (2, None, None), (None, 8.0, None)]
    assert list(streams._combining(streams._sums)(iter([]))) == []


ROW = "k long, part string, a double, b string"


def test_change_table_reads_any_version(spark, tmp_path):
    r = random.Random(9)
    table = ChangeTable(spark, f"file://{tmp_path}/t", ROW, ["k", "part"])
    assert table.version() == -1 and table.as_of().count() == 0
    state, after = {}, []
    for v in range(12):
        changes = []
        for seq in range(25):
            key = (r.randint(0, 20), r.choice(["x", "y", None]))
            op = "remove" if r.random() < 0.3 else "put"
            row = (*key, r.random() if r.random() < 0.9 else None, f"v{v}")
            changes.append((*row, op, seq))
            state.pop(key, None) if op == "remove" else state.update({key: row[2:]})
        after.append(dict(state))
        df = spark.createDataFrame(changes, f"{ROW}, what string, no long").repartition(3)
        assert table.write(df, op=F.col("what"), seq=F.col("no")) == v
        table.write(df, v, F.col("what"), F.col("no"))  # a batch that runs again
        if v == 6:
            table.compact(keep=2)
    rows = lambda df: {(x.k, x.part): (x.a, x.b) for x in df.collect()}
    for v in (4, 7, 11):
        assert rows(table.as_of(v)) == after[v]
    assert rows(table.as_of()) == after[11] and table.as_of().columns == ["k", "part", "a", "b"]
    with pytest.raises(ValueError, match="compacted"):
        table.as_of(3)
    table.write(spark.createDataFrame([(0, "x", 9.0, "again")], ROW), 2)  # a version that is compacted already
    assert rows(table.as_of(4)) == after[4]
    table.write(spark.createDataFrame([(99, "x")], "k long, part string"))
    assert rows(table.as_of())[99, "x"] == (None, None)


def test_folders_stay_few_over_many_batches(spark, tmp_path):
    table = ChangeTable(spark, f"file://{tmp_path}/many", "k long, a long", ["k"])
    most = 0
    for v in range(50):
        table.write(spark.range(3).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("a")).coalesce(1), v)
        if v % 8 == 7:
            table.compact(keep=1)
        most = max(most, table.folders())
    assert most <= 11
    assert {(r.k, r.a) for r in table.as_of().collect()} == {(i, 49) for i in range(3)}


def test_streams_write_their_state_to_a_table(spark, tmp_path):
    files = [[("A", at(1), float(i), i), (f"S{i}", at(1), 1.0, i)] for i in range(12)]
    table = streams.run_to_table(streams.latest_quote(arriving(spark, tmp_path, files, TICK)), "latest", ["symbol"], keep=4)
    assert table.folders() <= 6
    assert {r.symbol: r.price for r in table.as_of().collect()} == {"A": 11.0, **{f"S{i}": 1.0 for i in range(12)}}


def test_rolled_up_bars_with_late_files(spark, tmp_path):
    r = random.Random(8)
    ticks = [("A" if r.random() < 0.7 else "B", at(1) + dt.timedelta(seconds=r.randint(0, 86_400 * 4)), round(r.uniform(1, 9), 2), i) for i in range(400)]
    ordered = sorted(ticks, key=lambda t: t[1])
    files = [ordered[i : i + 40] for i in range(0, 400, 40)]
    files[2], files[3] = files[3], files[2]  # late, within the delay of two days
    end = [[("C", at(15), 1.0, 999)], [("C", at(16), 1.0, 1000)]]
    hour, day = streams.rolled_up(arriving(spark, tmp_path, [*files, *end], TICK), delay="2 days")
    rows = spark.createDataFrame(ticks, TICK)

    def twin(width):
        order = F.struct("ts", "event_id")
        return {tuple(x) for x in rows.groupBy("symbol", F.window("ts", width).start.alias("start")).agg(F.min_by("price", order), F.max("price"), F.min("price"), F.max_by("price", order), F.count("*")).collect()}

    assert {tuple(x) for x in streams.run_to_files(hour, "hourly").where("symbol <> 'C'").collect()} == twin("1 hour")
    assert {tuple(x) for x in streams.run_to_files(day, "daily").where("symbol <> 'C'").collect()} == twin("1 day")
