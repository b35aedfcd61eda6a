"""The polled operators as Structured Streaming queries. Each takes a streaming DataFrame and gives one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from quantloom import schemas
from quantloom.functions.text import market_open
from quantloom.sources.changes import ChangeTable
from quantloom.sources.market import shared_path


def tick_stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """symbol, ts, price, event_id of the landed events, or other expressions of their columns."""
    rows = spark.readStream.schema(schemas.LANDED["events"]).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may match a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*(columns or ("user_id as symbol", "ts", "value as price", "event_id")))


def bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Tumbling OHLC bars; ticks later than the delay are dropped, and a bar comes out once its window is closed."""
    order = F.struct("ts", "event_id")
    df = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks")
    )
    return df.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "ticks")


def rolled_up(ticks: DataFrame, fine: str = "1 hour", coarse: str = "1 day", delay: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """Fine and coarse bars under one watermark; coarse ones are made of the fine ones, so that their state is a row a symbol and window and not ticks anew.

    Two windowed aggregations in a row, both in append mode: a coarse bar comes out when the fine bars of its window have.
    """
    order = F.struct("ts", "event_id")
    each = ticks.withWatermark("ts", delay).groupBy(F.window("ts", fine), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks")
    )
    each = each.select("symbol", F.window_time("window").alias("at"), F.col("window.start").alias("start"), "open", "high", "low", "close", "ticks")
    rolled = each.groupBy(F.window("at", coarse), "symbol").agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("ticks").alias("ticks")
    )
    return each.drop("at"), rolled.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "ticks")


def latest_quote(ticks: DataFrame) -> DataFrame:
    """One row of state a symbol; for update mode."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


def market_hours(ticks: DataFrame) -> DataFrame:
    return ticks.where(market_open(F.col("ts")))


def title_dedup(articles: DataFrame, delay: str = "7 days") -> DataFrame:
    """One article for each query and title within the horizon, which also bounds the state."""
    return articles.withColumn("title_lc", F.lower("title")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["query", "title_lc"])


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Work off what is there, append the result to files, and read it."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int, str], None], mode: str = "update") -> str:
    """Work off what is there; each(batch, number, path) writes below path."""
    out = shared_path(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(stream.sparkSession, f"{name}-state")).trigger(availableNow=True)
    writer.foreachBatch(lambda df, k: each(df, k, out)).start().awaitTermination()
    return out


def run_latest(stream: DataFrame, name: str, keep: int = 8) -> DataFrame:
    """The last version of each symbol's quote over all batches of latest_quote(): a change table, compacted every ``keep`` batches."""
    return run_to_table(stream, name, ["symbol"], keep).as_of()


def run_to_table(stream: DataFrame, name: str, keys: list[str], keep: int = 8, mode: str = "update") -> ChangeTable:
    """Work off what is there; the rows of each batch replace those of their keys in a change table."""
    changes = ChangeTable(stream.sparkSession, shared_path(stream.sparkSession, name), stream.schema, keys)

    def each(batch: DataFrame, number: int, _: str) -> None:
        changes.write(batch, number)
        if number % keep == keep - 1:
            changes.compact(keep=1)

    run_batches(stream, name, each, mode)
    return changes


#: Rows of a task that are combined at a time.
COMBINED = 1 << 18


def _combining(combine: Callable[[pa.Table], pa.Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= COMBINED:
                yield from combine(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if n:
            yield from combine(pa.Table.from_batches(held)).to_batches()

    return run


def _latest_ticks(ticks: pa.Table) -> pa.Table:
    """Of each symbol the tick of greatest (at, event_id)."""
    ticks = ticks.sort_by([("symbol", "ascending"), ("at", "descending"), ("event_id", "descending")]).combine_chunks()
    symbol = ticks["symbol"]
    first = pa.chunked_array([pa.array([True]), *pc.not_equal(symbol.slice(1), symbol.slice(0, len(symbol) - 1)).chunks])
    return ticks.filter(first)


def _sums(changes: pa.Table) -> pa.Table:
    """Changes of each portfolio added up."""
    found = changes.group_by("portfolio_id", use_threads=False).aggregate([("value", "sum"), ("cost", "sum")])
    return found.select(["portfolio_id", "value_sum", "cost_sum"]).rename_columns(["portfolio_id", "value", "cost"])


class _Moves(StatefulProcessor):
    """Of one symbol the last price: a batch of ticks becomes one move, from the price before to the latest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, at long, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        latest = max(rows, key=lambda r: (r.at, r.event_id))
        before = self.last.get()
        if before is None or tuple(before[1:]) < (latest.at, latest.event_id):
            self.last.update((latest.price, latest.at, latest.event_id))
            yield Row(symbol=key[0], price=latest.price, before=before[0] if before is not None else None)

    def close(self) -> None:
        pass


class _Totals(StatefulProcessor):
    """Running totals of one portfolio, to which a batch's changes are added."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "value double, cost double")

    def handleInputRows(self, key, rows, timerValues):
        value, cost = self.totals.get() or (0.0, 0.0)
        for r in rows:
            value += r.value or 0.0
            cost += r.cost or 0.0
        self.totals.update((value, cost))
        gain = value - cost
        yield Row(portfolio_id=key[0], value=value, cost=cost, gain=gain, gain_pct=gain / cost * 100 if cost > 0 else 0.0)

    def close(self) -> None:
        pass


def live_portfolio(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """A stream of the new totals of each portfolio whose prices have changed; run in append mode, as two states follow each other.

    A position counts from its first tick on, as one without quote does not. The ticks of a batch become one move a symbol first, and positions of a portfolio in
    one symbol are added up; a move then goes to the portfolios that hold its symbol, where it changes the totals by shares * (price - price
    before), whatever else they hold. Both states take a row at a time in Python, so ticks of a symbol and changes of a portfolio are combined over Arrow
    arrays before. Ticks may be late: the price of greatest (ts, event_id) stays. A tick without symbol or price changes nothing.
    """
    held = positions.where("shares >= 0.001").groupBy("portfolio_id", F.col("symbol").cast("string").alias("symbol")).agg(F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("buy_price")).alias("cost"))
    slim = ticks.where("price is not null and symbol is not null").select(F.col("symbol").cast("string").alias("symbol"), "price", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    slim = slim.repartition("symbol").mapInArrow(_combining(_latest_ticks), slim.schema)
    move = StructType([StructField("symbol", StringType()), StructField("price", DoubleType()), StructField("before", DoubleType())])
    moves = _stateful(slim.groupBy("symbol")).transformWithState(_Moves(), move, "Append", "None")
    schema = StructType([positions.schema["portfolio_id"], *(StructField(c, DoubleType()) for c in ("value", "cost", "gain", "gain_pct"))])
    before = F.col("before")
    changes = moves.join(held, "symbol").select("portfolio_id", (F.col("shares") * (F.col("price") - F.coalesce(before, F.lit(0.0)))).alias("value"), F.when(before.isNull(), F.col("cost")).otherwise(0.0).alias("cost"))
    changes = changes.repartition("portfolio_id").mapInArrow(_combining(_sums), changes.schema)
    return _stateful(changes.groupBy("portfolio_id")).transformWithState(_Totals(), schema, "Append", "None")


def _stateful(grouped):
    """State with timers, lists and maps needs the store that can hold them."""
    grouped._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return grouped


#: Requests of a query that travel as one row.
PIECE = 128


class _Waiting(StatefulProcessor):
    """Requests of one query and slot of ``age``, kept until the watermark has passed them; then they go on in their order, PIECE a row."""

    def __init__(self, age_us: int):
        self.age_us = age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, request_id long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.at, r.request_id) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake_at(min(at for at, _ in new))
        return iter(())

    def _wake_at(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < until], [r for r in rows if r[0] >= until]
        for no, first in enumerate(range(0, len(due), PIECE)):
            ats, ids = zip(*due[first : first + PIECE], strict=True)
            yield Row(query=key[0], no=no, ats=list(ats), ids=list(ids), until=until)
        too_old = key[1] + 2 * self.age_us
        if later:
            self.waiting.put(later)
            self._wake_at(later[0][0])
        elif rows:
            self.waiting.clear()
        if due:
            self._wake_at(too_old)  # an answer of this slot is then forgotten
        elif not rows and too_old < until:
            yield Row(query=key[0], no=0, ats=[], ids=[], until=until)

    def close(self) -> None:
        pass


class _Answers(StatefulProcessor):
    """Pieces of one query's requests in the order of their times: those within ``age`` of the last one answered take its answer.

    A batch brings all that the watermark has newly passed. Its pieces are laid by in the state store, so that only one of them is held at a time.
    """

    def __init__(self, age_us: int):
        self.age_us = age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", "at long, request_id long, no long", "ats array<long>, ids array<long>")
        self.answered = handle.getValueState("answered", "at long")

    def handleInputRows(self, key, rows, timerValues):
        until = 0
        for r in rows:
            until = max(until, r.until)
            if r.ats:
                self.pieces.updateValue((r.ats[0], r.ids[0], r.no), (r.ats, r.ids))
        last = self.answered.get()[0] if self.answered.exists() else None
        for place in sorted(tuple(k) for k in self.pieces.keys()):
            ats, ids = map(list, self.pieces.getValue(place))
            first = 0
            while first < len(ats):
                fresh = last is None or ats[first] - last >= self.age_us
                last = ats[first] if fresh else last
                end = max(bisect_left(ats, last + self.age_us, first), first + 1)
                yield Row(query=key[0], ats=ats[first:end], ids=ids[first:end], fresh=fresh, answered_at=last)
                first = end
        self.pieces.clear()
        if last is not None and last + self.age_us < until:
            self.answered.clear()
        elif last is not None:
            self.answered.update((last,))

    def close(self) -> None:
        pass


def cached_queries(requests: DataFrame, age: str = "30 minutes", delay: str = "30 minutes") -> DataFrame:
    """requests (query, request_id, ts), a stream: of each whether it is answered anew, and when its answer was made.

    An answer serves the requests of its query less than ``age`` after the request that it was made for, whole days counted too; a served request doesn't make
    it last longer. Requests are taken in the order of (ts, request_id) once the watermark has passed them, so that rows don't depend on batches. They wait
    by query and slot of ``age``, each with a timer, so that a popular query is spread over tasks; only pieces of them in order meet in the query's
    own state. Later ones than ``delay`` are dropped. An answer that is too old is forgotten. A null query is one of its own.
    """
    age_us = round(requests.sparkSession.range(1).select(F.expr(f"interval {age}").cast("interval day to second").alias("i")).first().i.total_seconds() * 1e6)
    at = F.unix_micros("ts")
    slim = requests.withWatermark("ts", delay).select("query", F.col("request_id").cast("long").alias("request_id"), at.alias("at"), "ts", (at - F.pmod(at, F.lit(max(age_us, 1)))).alias("slot"))
    longs = ArrayType(LongType())
    piece = StructType([StructField("query", StringType()), StructField("no", LongType()), StructField("ats", longs), StructField("ids", longs), StructField("until", LongType())])
    served = StructType([StructField("query", StringType()), StructField("ats", longs), StructField("ids", longs), StructField("fresh", BooleanType()), StructField("answered_at", LongType())])
    pieces = _stateful(slim.groupBy("query", "slot")).transformWithState(_Waiting(age_us), piece, "Append", "EventTime")
    found = _stateful(pieces.groupBy("query")).transformWithState(_Answers(age_us), served, "Append", "None")
    each = found.select("query", F.posexplode(F.arrays_zip("ats", "ids")).alias("i", "r"), "fresh", F.timestamp_micros("answered_at").alias("answered_at"))
    return each.select("query", F.col("r.ids").alias("request_id"), F.timestamp_micros("r.ats").alias("ts"), (F.col("fresh") & (F.col("i") == 0)).alias("answered"), "answered_at")
