"""Best-fit packing by minimum bin slack.

Documents longer than a sequence are cut; every other piece is whole. Which pieces go together depends on
lengths only, of which there are at most ``capacity``: their counts are exact and small whatever the corpus.
For each bin, dynamic programming over a bitset of reachable sums finds the fullest combination of available
lengths beside the longest one left; it is removed as many times as the counts allow. The plan then says,
for the r-th piece of each length, which bin and offset it gets. Pieces are numbered within their length by
numbers that tasks give and prefix sums over tasks; no length meets in one task.

Null and empty texts have the end id only and are packed too. Repeated document rows are packed one by one.
Sequence ids run from 0. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quantloom.llm.common import materialize, table
from quantloom.llm.token_files import portions
from quantloom.llm.tokens import default_tokenizer, encoder

PIECES = "piece int, start long, length long, ids_crc32 long, task int, rank long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counted, with the largest sum that is not above room."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            new = (reach | reach << length) & mask
            if new == reach:
                break
            layers.append((length, reach))
            reach = new
        if reach >> room:
            break
    at, found = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        if not before >> at & 1:
            found.append(length)
            at -= length
    return found


def bin_plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first bin, first offset), ranks ascending."""
    left = {k: n for k, n in counts.items() if n > 0}
    given = dict.fromkeys(left, 0)
    plan: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in left}
    bins = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest({k: n for k, n in left.items() if n}, capacity - longest)]
        left[longest] += 1
        times = {k: chosen.count(k) for k in dict.fromkeys(chosen)}
        repeats = min(left[k] // n for k, n in times.items())
        offset = 0
        for k, n in times.items():
            plan[k].append((given[k], n, bins, offset))
            given[k] += n * repeats
            offset += n * k
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
        bins += repeats
    return {k: np.array(v, np.int64) for k, v in plan.items()}


def _cut(path: str, end_id: int, capacity: int, id_type: pa.DataType):
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        try:
            for keys, texts in chain.from_iterable(map(portions, batches)):
                ids, lengths = tool.encode_all(texts, end_id)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                rows: list[tuple] = []
                for key, n in zip(keys, lengths.tolist(), strict=True):
                    for k, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        rows.append((key, k, start, size, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + size)]), task, seen[size]))
                        seen[size] += 1
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        finally:
            tool.forget()  # else idle workers hold their caches

    return run


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                rows, own = plan.value[int(k)], length == k
                first, copies, bins, offsets = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                sequence[own] = bins + (rank[own] - first) // copies
                offset[own] = offsets + (rank[own] - first) % copies * k
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = slim.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PIECES.split(", "))]).schema
    pieces = materialize(slim.mapInArrow(_cut(tokenizer or default_tokenizer(), end_id, capacity, to_arrow_type(schema[0].dataType)), schema), "pieces")
    # At most one row for each task and length.
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = by_task.groupBy("length").agg(F.sum("n").alias("n"))  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(bin_plan({int(r.length): int(r.n) for r in counts.collect()}, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    first = by_task.select("length", "task", before.alias("before"))
    ranked = pieces.join(first, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan), out)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)
