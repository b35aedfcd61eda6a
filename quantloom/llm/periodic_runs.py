"""Periodic runs of words: seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(min_length, times * q) words that no neighbouring word
extends with this period. Words q apart are equal in it, so it is a stretch of lag q (a diagonal) on which at least that many words
less q are equal.

Seeds: for the lags from 2^j to 2^(j+1) - 1 the k-grams of the least overlap that these and longer lags guarantee are indexed, and each
k-gram is paired with its next occurrence in the same document. This pair is enough: k is at least q, so the grams of a run
with smallest period q cannot occur again sooner than q words on. There is at most one pair a word and class of lags, never all pairs of a
frequent gram. Extension: all words are indexed, so a seed's extension by a word is the next seed on its diagonal. In order along each lag, a
seed that the furthest word covered on this lag reaches is part of the extension before it, and any other begins a new one. k-grams are
compared exactly, by ranks of 1, 2, 4, ... words; only words whose gram occurs twice go on to the next length.

Null and empty texts have no words. Repeated rows give equal rows; an empty table gives none. Words of many short documents are
worked on at once in portions of bounded size; a long document takes about 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quantloom.llm.common import table

#: Bytes of text worked on at once, but for single longer documents.
PORTION = 4 << 20
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _ranked(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the grams with these keys at these places: ranks of all n places, -1 where a gram occurs once, and the places where not."""
    ranks = np.full(n, -1, np.int32)
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    often = times[which] > 1
    ranks[at[often]] = (np.cumsum(times > 1) - 1)[which[often]]
    return ranks, at[often]


def _pair(ranks: np.ndarray, at: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two grams ``apart`` words apart, and their places, where both occur twice."""
    at = at[at < len(ranks) - apart]
    second = ranks[at + apart]
    at, second = at[second >= 0], second[second >= 0]
    return ranks[at].astype(np.int64) * len(ranks) + second, at


def find_runs(doc: np.ndarray, word: np.ndarray, min_length: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of words, by start and then period; doc tells the document of each word, ascending."""
    n = len(word)
    found = [np.zeros((3, 0), np.int64)]
    if not n:
        return tuple(found[0])
    # A gram across two documents has no equal, so grams need no borders.
    at, size = np.arange(n), 1
    ranks, at = _ranked(doc.astype(np.int64) * (int(word.max()) + 1) + word, at, n)
    low, turn = 1, min_length // times
    while at.size:
        k = min(max(min_length, times * q) - q for q in (low, turn, turn + 1) if q >= low)
        while size * 2 <= k and at.size:
            ranks, at = _ranked(*_pair(ranks, at, size), n)
            size *= 2
        # The k-gram is two overlapping ones of ``size`` words.
        key, place = _pair(ranks, at, k - size) if k > size else (ranks[at].astype(np.int64), at)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        lag = np.diff(place)
        seeds = np.flatnonzero((key[1:] == key[:-1]) & (lag >= low) & (lag < 2 * low))
        place, lag = place[seeds], lag[seeds]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # Seeds of one lag come in order of place, so the one before has covered the furthest.
        covered = place[:-1] + k
        first = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (place[1:] > covered)])[: len(place)])
        last = np.append(first[1:], len(place))[: len(first)] - 1
        start, period = place[first], lag[first]
        length = place[last] - start + k + period
        long = length >= np.maximum(min_length, times * period)
        found.append(np.stack([start, length, period])[:, long])
        low *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _find(min_length: int, times: int, rewrite: Callable[[str, int], np.ndarray | None] | None):
    def portion(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(rows.column(2).cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        words, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
        there = pc.greater(pc.binary_length(words), 0)
        words, parent = words.filter(there), parent[there.to_numpy(zero_copy_only=False)]
        bounds = np.searchsorted(parent, np.arange(rows.num_rows + 1))
        if rewrite is not None:
            source = np.arange(len(words))
            for k, doc_id in enumerate(rows.column(1).to_pylist()):
                a, b = bounds[k], bounds[k + 1]
                if doc_id is not None and (changed := rewrite(doc_id, int(b - a))) is not None:
                    source[a:b] = a + changed
            words = words.take(pa.array(source))
        code = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int32)
        start, length, period = find_runs(parent, code, min_length, times)
        kept = kept_words(len(words), start, length, period)
        left = np.concatenate([[0], np.cumsum(kept)])[bounds]
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
        held = np.searchsorted(start, bounds)
        items = pa.StructArray.from_arrays([pa.array(start - bounds[parent[start]] if len(start) else start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(held, pa.int32()), items), collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + PORTION)))
                yield portion(batch.slice(at, end - at))
                at = end

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, times: int = 4, rewrite: Callable[[str, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without words that a run holds after its first period.

    One row a document, without a shuffle. rewrite(doc_id as text, n) may give the places from which a document's n words are taken
    first, for planted tests; rows without id are not rewritten.
    """
    if times < 3 or min_length < 2:
        raise ValueError("a run needs its period three times at least, and two words")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id_text"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_find(min_length, times, rewrite), slim.select("doc_id").schema.add("n_words", "long").add("runs", ArrayType(RUN)).add("collapsed", "string"))


def planted(doc_id: str, n: int) -> np.ndarray | None:
    """The contract's periods: in a tenth of the documents the words from some place on repeat."""
    h = crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= first, first + (i - first) % period, i)


def most_repeated(runs: Column) -> Column:
    """The run of the largest length / period; of equal ones the first."""
    none = F.lit(None).cast(RUN)
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted).withColumn("best", most_repeated(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, CAST(doc_id AS VARCHAR) AS s FROM documents),
b AS (SELECT doc_id, w, len(w) AS n, list_concat([4294967295], flatten(list_transform(range(length(s)), lambda i: list_transform(range(8), lambda k: (ascii(s[i + 1]) >> k) & 1)))) AS bits FROM t),
h AS (SELECT doc_id, w, n, xor(list_reduce(list_transform(bits, lambda v: CAST(v AS BIGINT)), lambda c, v: xor(c >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) AS h FROM b),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
o AS (SELECT doc_id, unnest(range(n)) AS j, unnest(w) AS word FROM p),
s AS (SELECT doc_id, i, CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS j FROM (SELECT doc_id, a, p, unnest(range(n)) AS i FROM p)),
d AS (SELECT doc_id, i, word FROM s JOIN o USING (doc_id, j)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, word || ' ' || lead(word, 1) OVER v || ' ' || lead(word, 2) OVER v || ' ' || lead(word, 3) OVER v || ' ' || lead(word, 4) OVER v AS g FROM d WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON y.doc_id = x.doc_id AND y.g = x.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
r AS (SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q AS period FROM k GROUP BY doc_id, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.period < r.period AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
u AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, arg_min(struct_pack(start := start, length := length, period := period), ROW(-length / period, start, period)) AS best FROM f GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM f),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM d ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN u ON u.doc_id = t.doc_id LEFT JOIN y ON y.doc_id = t.doc_id"""
