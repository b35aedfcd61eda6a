"""Character n-gram tables over a whole corpus, for the language models.

A symbol is a UTF-16 unit, so there is no list of known characters: all but the rarest characters are one symbol, those two.
0 stands before the first symbol of a text. An n-gram of up to ``MAX_ORDER`` symbols is a long of sixteen bits a symbol,
the last symbol lowest, so that masks give its suffixes and shifts its context. Counts are made in portions
of bounded size and summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, small_side

CHAR_BITS, MAX_ORDER = 16, 4
#: Characters counted before a task sends its sums on; these take 40 bytes each.
PORTION = 2_000_000
#: Scores of up to this many n-grams go to every executor; beyond it documents' n-grams are joined with them.
MAX_SHARED = 2_000_000


def units(text: str) -> np.ndarray:
    """The symbols of a text: UTF-16 units, and 0xFFFF, which no character has, for 0."""
    c = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    c[c == 0] = 0xFFFF
    return c


def grams(text: str | None, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol."""
    if order > MAX_ORDER:
        raise ValueError(f"n-grams of more than {MAX_ORDER} symbols don't fit")
    c = units(text or "")
    padded = np.concatenate([np.zeros(order - 1, np.int64), c])
    key = np.zeros(len(c), np.int64)
    for i in range(order):
        key = key << CHAR_BITS | padded[i : i + len(c)]
    return key


def count_grams(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """docs: text, part (int below parts). gram, and n0, n1, ...: how often it is in the documents of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(parts)]

        def summed() -> pa.RecordBatch:
            each = [np.unique(np.concatenate([*p, np.zeros(0, np.int64)]), return_counts=True) for p in held]
            keys = np.unique(np.concatenate([k for k, _ in each]))
            n = np.zeros((parts, len(keys)), np.int64)
            for i, (k, times) in enumerate(each):
                n[i, np.searchsorted(keys, k)] = times
                held[i].clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, n)], ["gram", *(f"n{i}" for i in range(parts))])

        size = 0
        for batch in batches:
            for text, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                key = grams(text.as_py(), order)
                held[part].append(key)
                size += len(key)
                if size >= PORTION:
                    yield summed()
                    size = 0
        if size:
            yield summed()

    names = [f"n{i}" for i in range(parts)]
    found = docs.select("text", "part").mapInArrow(run, "gram long, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (CHAR_BITS * n)) - 1)) if n < MAX_ORDER else gram


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, CHAR_BITS)


def n_symbols(counts: DataFrame) -> int:
    """How many symbols counts has; 1 at least."""
    return max(1, counts.select(suffix(F.col("gram"), 1).alias("s")).distinct().count())


def score_docs(docs: DataFrame, order: int, table: DataFrame, values: list[str]) -> DataFrame:
    """docs: row (any value, repeated or null too), text. For each row of docs: row, n_tokens, and the sum of each value of table (gram, values) over all characters."""
    spark = docs.sparkSession
    schema = docs.select("row").schema.add("n_tokens", "long")
    for v in values:
        schema = schema.add(v, "double")
    if table.limit(MAX_SHARED + 1).count() <= MAX_SHARED:
        rows = table.select("gram", *[F.col(v).cast("double").alias(v) for v in values]).toArrow()
        by_gram = np.argsort(rows["gram"].to_numpy())
        held = spark.sparkContext.broadcast((rows["gram"].to_numpy()[by_gram], np.stack([rows[v].to_numpy()[by_gram] for v in values], axis=1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, found = held.value
            for batch in batches:
                n, sums = [], []
                for text in batch.column(1):  # one at a time: a batch's texts are many
                    key = grams(text.as_py(), order)
                    key.sort()
                    n.append(len(key))
                    sums.append(found[np.searchsorted(known, key)].sum(0, dtype=np.float64) if len(key) else np.zeros(len(values)))
                total = np.array(sums).reshape(len(n), len(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(total[:, i].copy()) for i in range(len(values)))], ["row", "n_tokens", *values])

        return docs.select("row", "text").mapInArrow(run, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gram, n = np.unique(grams(text.as_py(), order), return_counts=True)
                held.append((np.full(len(gram), k), gram, n))
                size += len(gram)
                if size >= PORTION:
                    yield together(held)
                    held, size = [], 0
            if size:
                yield together(held)

    def together(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "gram", "times"])

    # Rows may be equal, so each gets a key; it is written with its text, as it may differ when it is computed again.
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("key"), "row", "text"), "keyed")
    pairs = keyed.select("key", "text").mapInArrow(spread, "key long, gram long, times long")
    sums = pairs.join(table, "gram").groupBy("key").agg(F.sum("times").alias("n_tokens"), *[F.sum(F.col("times") * F.col(v)).alias(v) for v in values])
    found = keyed.select("key", "row").join(sums, "key", "left")  # null and empty texts have no n-grams
    return found.select("row", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def flagged(docs: DataFrame, doc_id: str, text: str, ids: DataFrame) -> DataFrame:
    """doc_id, text and chosen: whether the document's id is in ids (one column)."""
    known = ids.select(F.col(ids.columns[0]).alias("_id"), F.lit(True).alias("_in")).distinct()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.join(small_side(known, 2_000_000), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("_in", F.lit(False)).alias("chosen"))
