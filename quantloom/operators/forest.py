"""A forest of regression trees over tables of any size: a level of all trees is one pass that counts rows by node and bin.

Rows are binned once and kept as blocks of arrays: a byte a column, the target in whole units, a hash of the row's key. A task takes a tree at a time over a
block, so that the tree's counts stay in the processor's cache; only these counts are shuffled, and only the splits come to the driver. Where a row stands in a
tree is found anew from its bins at each level, so nothing is kept a row and tree.

How often a row is drawn for a tree depends on the hash of its key alone, and targets are summed in whole units, so a forest does not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.sources.market import materialize

BINS, BIN_BITS = 32, 5
#: Rows of a block, rows from which cuts between bins are taken (about; all if there are fewer), nodes of a group of counts.
BLOCK, CUT_ROWS, NODES = 1 << 16, 200_000, 64
#: Trees are dealt to so many passes over the blocks that run side by side, as blocks are small and counting is not.
PASSES = 5
#: Levels in which nodes are so few that comparing whole arrays with each node's cut is faster than looking up the cut of each row's node.
WIDE = 3
#: Below 2^61 in all, so that whole units add up in 64 bits, however often a row is drawn (twice on average at most).
SUM_BITS = 61

Splits = list[tuple[np.ndarray, np.ndarray]]


def _binned(cuts: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """columns x rows: a bin is the number of cuts below the value."""
    return np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, values)])


def _keys(bins: np.ndarray) -> np.ndarray:
    """The bins of a row as one number."""
    return reduce(np.bitwise_or, [b.astype(np.int64) << (BIN_BITS * i) for i, b in enumerate(bins)]).astype(np.int32 if len(bins) * BIN_BITS < 32 else np.int64)


def _tables(splits: Splits, kind: type) -> Splits:
    """By level and tree: the bits of a key that a node compares, and with what. A node without a split sends its rows to the left."""
    found = []
    for column, cut in splits:
        shift = BIN_BITS * np.maximum(column, 0).astype(np.int64)
        found.append(tuple(np.where(column < 0, 0, bits << shift).astype(kind) for bits in (np.int64(BINS - 1), cut.astype(np.int64))))
    return found


def _top(bins: np.ndarray, splits: Splits, tree: int) -> np.ndarray:
    """The node of each row after the first levels."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level, (column, cut) in enumerate(splits[:WIDE]):
        right = np.zeros(len(at), bool)
        for node in range(1 << level):
            if column[tree, node] >= 0:
                here = bins[column[tree, node]] > cut[tree, node]
                if level:
                    here &= at == node
                right |= here
        at = (at << 1) | right.view(np.uint8)
    return at


def _down(at: np.ndarray, keys: np.ndarray, tables: Splits, tree: int) -> np.ndarray:
    """From the nodes after the first levels to those after all."""
    at = at.astype(np.intp)
    for mask, cut in tables[WIDE:]:
        right = (keys & mask[tree].take(at)) > cut[tree].take(at)
        at <<= 1
        at += right
    return at


def _poisson() -> np.ndarray:
    """How often a row is drawn, by sixteen random bits."""
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(chance, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Four rows of sixteen random bits (splitmix64 of the hash)."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.ascontiguousarray((z ^ (z >> np.uint64(31))).view(np.uint16).reshape(-1, 4).T)


@dataclass(frozen=True)
class Forest:
    """cuts: of each column. splits: by level the column (-1: none) and cut of trees x nodes. values: of trees x nodes after the last level."""

    columns: tuple[str, ...]
    cuts: list[np.ndarray]
    splits: Splits
    values: np.ndarray

    def predict(self, values: list[np.ndarray]) -> np.ndarray:
        """The mean of the trees for each row of the columns' values."""
        bins = _binned(self.cuts, values)
        keys = _keys(bins)
        tables, out = _tables(self.splits, keys.dtype.type), np.zeros(bins.shape[1])
        for tree, held in enumerate(self.values):
            out += held[_down(_top(bins, self.splits, tree), keys, tables, tree)]
        return out / len(self.values)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the column prediction, without MLlib's vector of features."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = self.predict([b.column(c).to_numpy(zero_copy_only=False) for c in self.columns])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "prediction"])

        df = df.drop("features")
        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("prediction", DoubleType())]))


def _cuts(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 values between those that occur: between all, or at equal shares of the rows."""
    found, times = np.unique(values, return_counts=True)
    i = np.arange(len(found) - 1)
    if len(found) > BINS:
        i = np.unique(np.searchsorted(np.cumsum(times), len(values) * np.arange(1, BINS) / BINS))
        i = i[i < len(found) - 1]
    return found[i] + (found[i + 1] - found[i]) / 2


def _pack(cuts: list[np.ndarray], middle: float, unit: float) -> Callable:
    """Blocks of rows: bins, target in units from the middle, hash."""

    def block(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        *values, target, hashes = (np.concatenate(p) for p in zip(*parts))
        for lo in range(0, len(target), BLOCK):
            at = slice(lo, lo + BLOCK)
            arrays = [_binned(cuts, [v[at] for v in values]), np.rint((target[at] - middle) / unit).astype(np.int32), hashes[at]]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["bins", "units", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= BLOCK:
                yield from block(parts)
                parts, n = [], 0
        if n:
            yield from block(parts)

    return run


def _count(trees: range, splits: Splits, drawn: np.ndarray) -> Callable:
    """For each tree and group of its nodes, rows and sum of targets by node, drawn column of the node and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, width = drawn.shape[1], drawn.shape[2] * BINS
        sums, poisson = np.zeros((len(trees), 2, nodes * width), np.int64), _poisson()
        empty, tables, shifts = True, None, None
        for b in batches:
            for packed in zip(b.column("bins"), b.column("units"), b.column("hashes")):
                bins, units, hashes = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.uint8, np.int32, np.uint64)))
                bins, empty, turn = bins.reshape(-1, len(units)), False, None
                keys, units = _keys(bins), units.astype(np.float64)
                if tables is None:
                    tables, shifts = _tables(splits, keys.dtype.type), np.ascontiguousarray(drawn.astype(keys.dtype).transpose(0, 2, 1)) * BIN_BITS
                for i, tree in enumerate(trees):
                    if turn != tree // 4:
                        turn = tree // 4
                        bits = _mixed(hashes, turn)
                    weight = poisson.take(bits[tree % 4])
                    rows = np.flatnonzero(weight != 0)
                    weight, key = weight.take(rows).astype(np.float64), keys.take(rows)
                    at = _down(_top(bins, splits, tree).take(rows), key, tables, tree)
                    total, first = units.take(rows) * weight, at * width
                    for j in range(drawn.shape[2]):
                        cell = first + ((key >> shifts[tree, j].take(at)) & (BINS - 1) | j * BINS)
                        # Whole numbers below 2^53 in a block, so exact.
                        sums[i, 0] += np.bincount(cell, weight, nodes * width).astype(np.int64)
                        sums[i, 1] += np.bincount(cell, total, nodes * width).astype(np.int64)
        if empty:
            return
        for i, tree in enumerate(trees):
            cells = sums[i].reshape(2, nodes, width)
            groups = [np.ascontiguousarray(cells[:, lo : lo + NODES]).tobytes() for lo in range(0, nodes, NODES)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(groups), pa.int32()), pa.array(range(len(groups)), pa.int32()), pa.array(groups, pa.binary())], names=["tree", "part", "sums"])

    return run


FOUND = "tree int, part int, slot array<int>, cut array<int>, own array<double>, left array<double>, right array<double>"


def _choose(columns: int) -> Callable:
    """The split of each node that lowers the variance most: which of its drawn columns (-1: none lowers it), the bin, and the means of the node and of both sides."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sums = reduce(np.add, (np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums")))
        n, total = sums.reshape(2, -1, columns, BINS).cumsum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            n_left, n_right = n[..., :-1], n[..., -1:] - n[..., :-1]
            left, right, own = total[..., :-1] / n_left, (total[..., -1:] - total[..., :-1]) / n_right, total[:, 0, -1] / n[:, 0, -1]
            gain = np.where((n_left > 0) & (n_right > 0), n_left * (n_right / n[..., -1:]) * (left - right) ** 2, 0.0)
        gain, left, right = (x.reshape(len(gain), -1) for x in (gain, left, right))
        best, node = gain.argmax(1), np.arange(len(gain))
        slot = np.where(gain[node, best] > 0, best // (BINS - 1), -1)
        arrays = [slot, best % (BINS - 1), own, left[node, best], right[node, best]]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32())} | {name: pa.array([a], pa.list_(t)) for name, a, t in zip(("slot", "cut", "own", "left", "right"), arrays, kinds)})

    return run


def _both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Children in the order of their parents: trees x 2 nodes."""
    return np.stack([left, right], -1).reshape(len(left), -1)


def grow(rows: DataFrame, columns: tuple[str, ...], target: str, key: list[Column], trees: int = 50, depth: int = 10, seed: int = 42) -> Forest:
    """A forest on all rows. As MLlib's, trees are grown on rows drawn with replacement, each node looks at a third of the columns (at most twelve) cut into 32 bins, and
    a node of one row, or whose target no cut tells apart, is a leaf. key names a row. Rows with a value that is missing or not finite take no part.

    Where the cuts between bins lie is taken from about CUT_ROWS rows, chosen by the hash (MLlib takes 10,000).
    """
    if not 1 <= len(columns) <= 12 or depth < 1:
        raise ValueError("a forest has one to twelve columns and at least one level")
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_target"), F.xxhash64(F.lit(seed), *key).alias("_hash"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in (*columns, "_target")]))  # NaN is above all
    n, low, high = rows.agg(F.count("*"), F.min("_target"), F.max("_target")).first()
    if not n:
        return Forest(columns, [np.zeros(0)] * len(columns), [], np.full((trees, 1), np.nan))
    seen = rows.where(F.pmod("_hash", F.lit(n // CUT_ROWS + 1)) == 0).select(*columns).toArrow()
    cuts = [_cuts(seen.column(c).to_numpy()) if len(seen) else np.zeros(0) for c in columns]
    middle = low / 2 + high / 2
    unit = (high / 2 - low / 2) / 2.0 ** min(30, SUM_BITS - 1 - n.bit_length()) or 1.0
    blocks = materialize(rows.mapInArrow(_pack(cuts, middle, unit), "bins binary, units binary, hashes binary"), "blocks")
    some, random = math.ceil(len(columns) / 3), np.random.default_rng(seed)
    passes = min(PASSES, trees)
    passes = [range(trees * i // passes, trees * (i + 1) // passes) for i in range(passes)]
    splits, values, open_ = [], None, np.ones((trees, 1), bool)
    for level in range(depth):
        drawn = np.sort(random.random((trees, 1 << level, len(columns))).argsort(-1)[..., :some], -1).astype(np.int8)
        counted = reduce(DataFrame.union, [blocks.mapInArrow(_count(p, splits, drawn), "tree int, part int, sums binary") for p in passes])
        slot, cut = np.full(open_.shape, -1), np.zeros(open_.shape, int)
        own, left, right = (np.zeros(open_.shape) for _ in range(3))
        for r in counted.groupBy("tree", "part").applyInArrow(_choose(some), FOUND).toArrow().to_pylist():
            at = r["tree"], slice(r["part"] * NODES, (r["part"] + 1) * NODES)
            for into, name in ((slot, "slot"), (cut, "cut"), (own, "own"), (left, "left"), (right, "right")):
                into[at] = r[name]
        split = open_ & (slot >= 0)
        column = np.where(split, np.take_along_axis(drawn, np.maximum(slot, 0)[..., None], -1)[..., 0], -1)
        values = np.nan_to_num(own) if values is None else values  # a tree without rows says the middle
        values = _both(np.where(split, left, values), np.where(split, right, values))
        splits.append((column.astype(np.int8), cut.astype(np.int8)))
        open_ = _both(split, split)
        if not split.any():
            break
    return Forest(columns, cuts, splits, middle + unit * values)
