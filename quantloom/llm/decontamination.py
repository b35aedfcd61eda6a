"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. For each pattern length m a window slides over a document's
words, and the block of words that ends it is looked up in the shift table of that length: it says how far
the window can move before that block could fit a pattern, to just behind it if the block is in none. The tables are
hashed into cells, each with the least shift of its blocks. Blocks have two words while patterns are few and up to four when they are many, as
the common pairs of words of a language then end some pattern; cells are sixteen a pattern, within bounds. Where the shift is zero, the bucket of patterns
with this suffix block is compared word by word.

Patterns of up to ``MAX_SHARED`` bytes go to every executor with their buckets. More of them stay a table: the
windows that the shift tables let through are then joined with it, again by all their words. Both ways give the same rows.

Words are ASCII lower-cased runs of letters, digits and non-ASCII characters. An item of fewer than
``window`` words, but not none, is one pattern. Null or empty texts have no words, no hits and are clean.
Items without id take no part; items of the same id count once. Repeated document rows each get a row. An empty
benchmark leaves all documents clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import free_name, materialize, raw_texts, small_side, table

#: ASCII bytes that end words become blanks, A-Z become a-z.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Least and most cells of a shift table, of two bytes each.
CELLS, MOST_CELLS = 1 << 18, 1 << 23
#: Up to so many patterns blocks have two words, three, and beyond four.
TWO_WORDS, THREE_WORDS = 1 << 15, 1 << 17
#: Shifts are numbers of two bytes.
MAX_WINDOW = 65_535
#: Bytes of patterns that tasks may hold; as Python objects they take about four times as much.
MAX_SHARED = 16 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def cell(block: list[bytes], cells: int = CELLS) -> int:
    """cells is a power of two."""
    return xxhash.xxh3_64_intdigest(b" ".join(block)) & (cells - 1)


def sizes(patterns: int) -> tuple[int, int]:
    """Words of a block and cells of a table."""
    width = 2 if patterns <= TWO_WORDS else 3 if patterns <= THREE_WORDS else 4
    return width, min(MOST_CELLS, max(CELLS, 1 << max(patterns * 16 - 1, 1).bit_length()))


def windows(items: list[tuple[str, bytes | None]], window: int) -> Iterator[tuple[str, list[bytes]]]:
    """All windows of each item; the whole item if it is shorter."""
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            yield item, own[i : i + size]


def shifts(pattern: list[bytes], width: int = 2, cells: int = CELLS) -> Iterator[tuple[int, int]]:
    """Cell and shift of each block of a pattern; a pattern shorter than a block is its own block."""
    m = len(pattern)
    for end in range(min(width, m), m + 1):
        yield cell(pattern[max(0, end - width) : end], cells), m - end


class WuManber:
    """Finds where patterns of given lengths may be, and with buckets of patterns where they are."""

    def __init__(self, tables: dict[int, np.ndarray], patterns: list[tuple[bytes, list[str]]] | None, width: int = 2):
        self.width, self.tables = width, {m: memoryview(t) for m, t in tables.items()}
        self.cells = len(next(iter(tables.values()), b"x" * CELLS))
        self.buckets: dict[tuple[int, int], list[tuple[list[bytes], list[str]]]] | None = None if patterns is None else {}
        for text, ids in patterns or ():
            p = text.split(b" ")
            self.buckets.setdefault((len(p), cell(p[-width:], self.cells)), []).append((p, ids))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """Start, length and items of each occurrence; without buckets, of each place that the shifts let through, with no items."""
        n, width, cells = len(text), self.width, self.cells
        for m, shift in self.tables.items():
            at = m - 1
            while at < n:
                block = cell(text[max(at - width, at - m) + 1 : at + 1], cells)
                step = shift[block]
                if step == 0:
                    step, start = 1, at - m + 1
                    if self.buckets is None:
                        yield start, m, []
                    elif bucket := self.buckets.get((m, block)):
                        own = text[start : at + 1]
                        for pattern, ids in bucket:
                            if pattern == own:
                                yield start, m, ids
                at += step


def _items(batch: pa.RecordBatch) -> list[tuple[str, bytes | None]]:
    return list(zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True))


def _patterns(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _items(batch):
                found = [(i, len(p), b" ".join(p)) for i, p in windows([item], window)]
                if found:
                    ids, lengths, texts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lengths, pa.int32()), pa.array(texts, pa.binary())], ["item", "m", "pattern"])

    return run


def _shifts(width: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[tuple[int, int], int] = {}
            for p in (p.split(b" ") for p in batch.column(0).to_pylist()):
                for c, step in shifts(p, width, cells):
                    least[len(p), c] = min(step, least.get((len(p), c), step))
            if least:
                m, c = zip(*least, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(c, pa.int32()), pa.array(least.values(), pa.int32())], ["m", "cell", "shift"])

    return run


def _shift_tables(patterns: DataFrame, width: int, cells: int) -> dict[int, np.ndarray]:
    """For each length the shift of each cell; at most ``window`` lengths of MOST_CELLS rows come to the driver, as Arrow columns."""
    rows = patterns.select("pattern").mapInArrow(_shifts(width, cells), "m int, cell int, shift int").groupBy("m", "cell").agg(F.min("shift").alias("shift")).toArrow()
    m, at, shift = (rows[c].to_numpy() for c in ("m", "cell", "shift"))
    tables = {}
    for k in np.unique(m).tolist():
        tables[k] = np.full(cells, max(1, k - width + 1), np.uint16)
        tables[k][at[m == k]] = np.minimum(shift[m == k], tables[k][at[m == k]])
    return tables


_last: list[tuple] = []


def _tool(shared) -> WuManber:
    """The last one is kept for the worker's next tasks, which get the same broadcast object."""
    if not _last or _last[0][0] is not shared:
        _last[:] = [(shared, WuManber(*shared.value))]
    return _last[0][1]


def _runs(found: list[tuple[int, int]]) -> list[list[int]]:
    """Start and end of each run of words that (start, length) cover."""
    runs: list[list[int]] = []
    for a, m in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], a + m)
        else:
            runs.append([a, a + m])
    return runs


RESULT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<array<int>>"}


def _rows(id_: pa.Array, n_words: list[int], runs: list[list[list[int]]], items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [sum(b - a for a, b in r) for r in runs]
    return pa.RecordBatch.from_arrays(
        [id_, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.list_(pa.int32())))],
        ["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def _search(shared):
    """Rows (doc_id, text), the patterns are in the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(shared)
        for batch in batches:
            n_words, runs, items = [], [], []
            for text in raw_texts(batch.column(1)):
                own = words(text)
                found = list(tool.find(own))
                n_words.append(len(own))
                runs.append(_runs([(a, m) for a, m, _ in found]))
                items.append(sorted({i for _, _, ids in found for i in ids}))
            yield _rows(batch.column(0), n_words, runs, items)

    return run


def _places(shared):
    """Rows (key, text): the windows that the shift tables let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(shared)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                own = words(text)
                found = [(a, m, b" ".join(own[a : a + m])) for a, m, _ in tool.find(own)]
                if found:
                    starts, lengths, texts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(texts, pa.binary())], ["key", "start", "m", "pattern"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, hits, items)."""
    for batch in batches:
        runs = [_runs([(h["start"], h["m"]) for h in hits or ()]) for hits in batch.column(2).to_pylist()]
        items = [sorted(set(i or ())) for i in batch.column(3).to_pylist()]
        yield _rows(batch.column(0), [len(words(t)) for t in raw_texts(batch.column(1))], runs, items)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, least_share: float = 0.05,
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (sorted ids), spans (start and end word of hit runs), contaminated. window is at most MAX_WINDOW words."""
    if not 0 < window <= MAX_WINDOW:
        raise ValueError(f"windows have 1 to {MAX_WINDOW} words")
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    found = rows.mapInArrow(_patterns(window), "item string, m int, pattern binary")
    patterns = materialize(found.groupBy("m", "pattern").agg(F.array_sort(F.collect_set("item")).alias("items")), "patterns")
    size, number = patterns.agg(F.coalesce(F.sum(F.length("pattern") + 40 + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i) + 8)), F.lit(0)), F.count("*")).first()
    width, cells = sizes(number)
    tables = _shift_tables(patterns, width, cells)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = slim.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in RESULT.items()]).schema
    if size <= MAX_SHARED:
        shared = spark.sparkContext.broadcast((tables, [(bytes(r.pattern), list(r["items"])) for r in patterns.select("pattern", "items").collect()], width))
        judged = slim.mapInArrow(_search(shared), schema)
    else:
        keyed = materialize(slim.withColumn("key", F.monotonically_increasing_id()), "keyed")  # ids may be repeated or missing
        places = keyed.select("key", "text").mapInArrow(_places(spark.sparkContext.broadcast((tables, None, width))), "key long, start int, m int, pattern binary")
        hits = places.join(patterns, ["m", "pattern"]).groupBy("key").agg(F.collect_set(F.struct("start", "m")).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
        judged = keyed.join(hits, "key", "left").select("doc_id", "text", "hits", "items").mapInArrow(_gather, schema)
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= least_share * F.col("n_words") - 1e-9)
    return judged.withColumn("contaminated", bad)


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones (documents of one id share the decision)."""
    name = free_name(docs, "bad")
    bad = materialize(contamination(docs, benchmark, doc_id, text).where("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(small_side(bad, 2_000_000), F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), hits AS (
  SELECT x.doc_id, x.i, bw.m, bw.item FROM (
    SELECT doc_id, i, s.m, array_to_string(w[i:i + s.m - 1], ' ') AS p
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT m FROM bw) s WHERE i + s.m - 1 <= len(w)) x
  JOIN bw ON bw.m = x.m AND bw.p = x.p
), pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
