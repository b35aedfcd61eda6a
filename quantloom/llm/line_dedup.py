"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index in the shared folder has two parts. The reference-count table holds, for the 128-bit hash of
every line key, in how many documents it occurs; inserting documents adds to it, deleting them subtracts,
and keys that reach zero go. For each shard of the hash space a cuckoo filter holds 16-bit fingerprints of
the keys that are in at least ``min_docs`` documents; keys that cross this bound enter the filter or, as
cuckoo filters allow, are deleted from it. The number of shards doubles as such keys become more, so that a shard
holds at most ``PER_SHARD`` or so. Dedup probes the filters for all lines, and the exact table confirms those that pass.
Up to ``MAX_SHARED`` frequent keys, filters and keys go to the texts, which are not shuffled. Beyond that lines go to
the shards of their hashes and then to the table, and only those that it confirms come back.

A key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Each row is a document.
Null or empty text is one empty line. Keys shorter than ``min_chars`` code points are never dropped. Rows
with a null id are kept and treated alike. An empty table gives an empty result of the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quantloom.llm.common import bigints, free_name, materialize, raw_texts, shared_path, table

STRIPPED = b"\t\n\x0b\x0c\r "
SLOTS = 4
MAX_KICKS = 500
#: Frequent keys that go to every executor, of about 20 bytes each with their filter.
MAX_SHARED = 2_000_000
#: Frequent keys of a shard, and parts into which the lines of one shard are dealt.
PER_SHARD, SALTS = 100_000, 16


def line_keys(text: bytes | None) -> list[bytes]:
    return [k.strip(STRIPPED) for k in (text or b"").lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashed(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves of each key's hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may be in either of two buckets."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells.reshape(buckets, SLOTS).copy()

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        return CuckooFilter(1 << max(2, int(keys / (SLOTS * 0.84))).bit_length())

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, buckets: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets; buckets is a power of two."""
        print_ = np.maximum(h2 & np.uint64(0xFFFF), np.uint64(1))
        mask = np.asarray(buckets, np.uint64) - np.uint64(1)
        first = (h1 >> np.uint64(20)) & mask
        return print_.astype(np.uint16), first.astype(np.int64), (first ^ CuckooFilter.step(print_, mask)).astype(np.int64)

    @staticmethod
    def step(print_: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return ((print_ * np.uint64(0x5BD1E995)) >> np.uint64(3)) & mask

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if a key finds no place; the caller then builds a larger filter from the exact table."""
        mask = np.uint64(self.buckets - 1)
        for p, a, b in zip(*CuckooFilter.places(h1, h2, self.buckets), strict=True):
            at = next((i for i in (a, b) if not self.cells[i].all()), None)
            kicks = 0
            while at is None:
                if (kicks := kicks + 1) > MAX_KICKS:
                    return False
                slot = kicks % SLOTS
                p, self.cells[b, slot] = self.cells[b, slot], p
                b = int(np.uint64(b) ^ CuckooFilter.step(np.uint64(p), mask))
                at = None if self.cells[b].all() else b
            self.cells[at, int(np.argmin(self.cells[at] != 0))] = p
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p, a, b in zip(*CuckooFilter.places(h1, h2, self.buckets), strict=True):
            for i in (a, b):
                if (found := np.flatnonzero(self.cells[i] == p)).size:
                    self.cells[i, found[0]] = 0
                    break


class FilterSet:
    """All shards' filters side by side, probed for whole arrays."""

    def __init__(self, shards: int, filters: dict[int, tuple[int, bytes]]):
        self.shards = shards
        self.buckets = np.ones(shards, np.int64)
        self.start = np.zeros(shards, np.int64)
        parts, at = [np.zeros((1, SLOTS), np.uint16)], 1
        for s, (n, raw) in sorted(filters.items()):
            self.buckets[s], self.start[s] = n, at
            parts.append(np.frombuffer(raw, np.uint16).reshape(n, SLOTS))
            at += n
        self.cells = np.concatenate(parts)

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shard = (h1 % np.uint64(self.shards)).astype(np.int64)
        p, a, b = CuckooFilter.places(h1, h2, self.buckets[shard])
        base = self.start[shard]
        return ((self.cells[base + a] == p[:, None]) | (self.cells[base + b] == p[:, None])).any(1)


def _count_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            for text in raw_texts(batch.column(0)):
                keys += {k for k in line_keys(text) if _long_enough(k, min_chars)}
            if keys:
                both = _hashed(keys).copy().view([("a", "<u8"), ("b", "<u8")]).ravel()
                found, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([bigints(found["a"]), bigints(found["b"]), pa.array(n, pa.int64())], ["h1", "h2", "n"])

    return run


def _update_shard(min_docs: int):
    def run(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["cells"].notna()]
        rows = pdf[pdf["cells"].isna()]
        halves = lambda x: (x["h1"].to_numpy(np.int64).view(np.uint64), x["h2"].to_numpy(np.int64).view(np.uint64))
        frequent = rows[rows["n"] >= min_docs]
        made = None
        if len(known):
            made = CuckooFilter(int(known["buckets"].iloc[0]), np.frombuffer(known["cells"].iloc[0], np.uint16))
            made.delete(*halves(rows[rows["crossed"] < 0]))
            if len(frequent) > 0.9 * SLOTS * made.buckets or not made.insert(*halves(frequent[frequent["crossed"] > 0])):
                made = None
        if made is None:
            made, room = CuckooFilter.sized(len(frequent)), len(frequent)
            while not made.insert(*halves(frequent)):
                made, room = CuckooFilter.sized(2 * room), 2 * room
        return pd.DataFrame({"shard": [shard[0]], "buckets": [made.buckets], "cells": [made.cells.tobytes()]})

    return run


class LineIndex:
    """The persistent index of one corpus. Each change writes a new version beside the last, which stays readable."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64, min_docs: int = 10, min_chars: int = 1):
        self.spark, self.path = spark, path or shared_path(spark, "line-index")
        self.shards, self.min_docs, self.min_chars, self.version, self.n_frequent = shards, min_docs, min_chars, 0, 0

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._change(docs.select(F.col(text).cast("string").alias("text")), 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """docs: documents inserted before, whose lines no longer count."""
        return self._change(docs.select(F.col(text).cast("string").alias("text")), -1)

    def counts(self) -> DataFrame:
        """h1, h2 (halves of the key's hash), n (documents that have it), crossed (of the last change)."""
        return self.spark.read.schema("h1 long, h2 long, n long, crossed int").parquet(f"{self.path}/counts-{self.version}")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, buckets long, cells binary").parquet(f"{self.path}/filters-{self.version}")

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        found = docs.mapInArrow(_count_keys(self.min_chars), "h1 long, h2 long, n long")
        delta = found.select("h1", "h2", (F.col("n") * sign).alias("change"), F.lit(0).cast("long").alias("before"))
        if self.version:
            delta = delta.unionByName(self.counts().select("h1", "h2", F.lit(0).cast("long").alias("change"), F.col("n").alias("before")))
        new = delta.groupBy("h1", "h2").agg((F.sum("before") + F.sum("change")).alias("n"), F.sum("before").alias("before"))
        crossed = (F.col("n") >= self.min_docs).cast("int") - (F.col("before") >= self.min_docs).cast("int")
        # Keys at zero stay in this version's table only if they have just left the filter; the next change drops them.
        new = new.withColumn("crossed", crossed).where("n > 0 or crossed < 0")
        new.select("h1", "h2", "n", "crossed").write.parquet(f"{self.path}/counts-{self.version + 1}")
        old = self.filters() if self.version else None
        self.version += 1
        self.n_frequent = self.frequent().count()
        if self.n_frequent > self.shards * PER_SHARD:  # all filters are made anew
            self.shards, old = 1 << int(self.n_frequent / PER_SHARD).bit_length(), None
        rows = self.counts().where(f"n >= {self.min_docs} or crossed < 0").select(self._shard(), "h1", "h2", "n", "crossed", F.lit(0).cast("long").alias("buckets"), F.lit(None).cast("binary").alias("cells"))
        if old is not None:
            rows = rows.unionByName(old.select("shard", *[F.lit(0).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("n", "long"), ("crossed", "int"))], "buckets", "cells"))  # not null: pandas would make floats of hashes
        rows.groupBy("shard").applyInPandas(_update_shard(self.min_docs), "shard int, buckets long, cells binary").write.parquet(f"{self.path}/filters-{self.version}")
        return self

    def frequent(self) -> DataFrame:
        return self.counts().where(f"n >= {self.min_docs}").select("h1", "h2")

    def _shard(self) -> Column:
        """h1 as unsigned, modulo the shards, as FilterSet.may_hold computes it."""
        n = self.shards
        return F.expr(f"cast(pmod(pmod(h1, {n}) + if(h1 < 0, {pow(2, 64, n)}, 0), {n}) as int)").alias("shard")

    def dedup(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with text less its frequent lines, and n_lines, n_dropped (replacing columns of these names)."""
        rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        slim = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in rest])
        schema = StructType([*slim.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
        place = rest.index(text)
        if self.n_frequent <= MAX_SHARED:
            filters = FilterSet(self.shards, {r.shard: (r.buckets, bytes(r.cells)) for r in self.filters().collect()})
            return slim.mapInArrow(_drop_known(self.spark.sparkContext.broadcast((filters, _sorted(self.frequent().toArrow()))), place), schema)
        key, hits = free_name(docs, "key"), free_name(docs, "hits")
        keyed = materialize(slim.withColumn(key, F.monotonically_increasing_id()), "keyed")  # ids may be repeated or missing
        found = self._confirmed(keyed.select(key, text)).groupBy("key").agg(F.collect_list(F.struct("h1", "h2")).alias(hits)).withColumnRenamed("key", key)
        return keyed.join(found, key, "left").select(*rest, hits).mapInArrow(_drop_found(place), schema)

    def _confirmed(self, keyed: DataFrame) -> DataFrame:
        """keyed: key, text. key, h1, h2 of the frequent keys of each row; no task holds more than one filter."""
        lines = keyed.mapInArrow(_spread(self.min_chars), "key long, h1 long, h2 long")
        none = F.lit(None).cast("binary").alias("cells")
        lines = lines.select(self._shard(), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "h1", "h2", F.lit(0).cast("long").alias("buckets"), none)
        zero = [F.lit(0).cast("long").alias(c) for c in ("key", "h1", "h2")]
        filters = self.filters().select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), *zero, "buckets", "cells")
        both = filters.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        # A row has a key once here, so a key's share of these rows is at most its share of documents; AQE splits it.
        return both.mapInArrow(_probe_shards, "key long, h1 long, h2 long").join(self.frequent(), ["h1", "h2"]).select("key", "h1", "h2")


def _sorted(frequent: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h1, h2 = (frequent[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    return h1[order], h2[order]


def _known(frequent: tuple[np.ndarray, np.ndarray], both: np.ndarray) -> np.ndarray:
    """Which rows of both (two halves) are in the sorted halves."""
    h1, h2 = frequent
    out = np.zeros(len(both), bool)
    at, end = np.searchsorted(h1, both[:, 0]), np.searchsorted(h1, both[:, 0], "right")
    while (left := np.flatnonzero((at < end) & ~out)).size:  # more than one step only if first halves are equal
        out[left] = h2[at[left]] == both[left, 1]
        at[left] += 1
    return out


def _without(text: bytes | None, drop: list[bool] | None) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    kept = lines if drop is None else [x for x, gone in zip(lines, drop, strict=True) if not gone]
    return (text or b"") if len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)


def _with_texts(batch: pa.RecordBatch, place: int, width: int, done: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    texts, n_lines, n_dropped = zip(*done, strict=True)
    columns = [batch.column(i) for i in range(width)]
    columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*batch.schema.names[:width], "n_lines", "n_dropped"])


def _drop_known(shared, place: int):
    """Filters and frequent keys are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, frequent = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = raw_texts(batch.column(place))
            keys = [line_keys(t) for t in texts]
            both = _hashed([k for own in keys for k in own])
            drop = filters.may_hold(both[:, 0], both[:, 1])
            maybe = np.flatnonzero(drop)
            drop[maybe] = _known(frequent, both[maybe])
            ends = np.cumsum([len(own) for own in keys])
            some = np.add.reduceat(drop, ends - [len(own) for own in keys]) > 0  # each text has a line
            done = [_without(t, drop[e - len(own) : e].tolist() if any_ else None) for t, own, e, any_ in zip(texts, keys, ends.tolist(), some.tolist(), strict=True)]
            yield _with_texts(batch, place, batch.num_columns, done)

    return run


def _drop_found(place: int):
    """The last column has the frequent keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            for text, hits in zip(raw_texts(batch.column(place)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                bad = {(h["h1"], h["h2"]) for h in hits or ()}
                done.append(_without(text, [tuple(h) in bad for h in _hashed(line_keys(text)).view(np.int64).tolist()] if bad else None))
            yield _with_texts(batch, place, batch.num_columns - 1, done)

    return run


def _spread(min_chars: int):
    """Rows (key, text): each key of each row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(raw_texts(batch.column(1))):
                own = {k for k in line_keys(text) if _long_enough(k, min_chars)}
                keys += own
                rows += [i] * len(own)
            if keys:
                both = _hashed(keys)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), bigints(both[:, 0]), bigints(both[:, 1])], ["key", "h1", "h2"])

    return run


def _probe_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt, kind): a shard's filter, then lines of its hashes. The lines that may be frequent."""
    now, tool = None, None
    for batch in batches:
        shard, kind, buckets = (batch.column(c).to_numpy() for c in ("shard", "kind", "buckets"))
        key, h1, h2 = (batch.column(c).to_numpy() for c in ("key", "h1", "h2"))
        cells = batch.column("cells")
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if b > a and kind[a] == 0:
                now, tool = shard[a], FilterSet(1, {0: (int(buckets[a]), cells[a].as_py())})
            elif b > a and shard[a] == now:
                ok = tool.may_hold(h1[a:b].view(np.uint64), h2[a:b].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x[a:b][ok]) for x in (key, h1, h2)], ["key", "h1", "h2"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, min_docs=10, min_chars=1).insert(docs)
    return index.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE k IN (SELECT k FROM bad)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM bad)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""
