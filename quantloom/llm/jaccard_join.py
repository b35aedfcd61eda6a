"""N-gram Jaccard join with a count-vector R-tree.

Each document's set of word shingles is hashed into groups; the group counts are a point. The overlap of
two sets is at most the sum of the smaller counts of each group, and at most what the parities of sixteen
times as many finer groups allow. The number of groups is a power of two that grows with the set, so that
the bounds are as sharp for long texts; points of neighbouring classes are compared by adding groups up. Documents that can be similar enough share one of the ``prefix`` smallest shingle
hashes, so pairs are sought only among documents that share one. There the points are kept in an R-tree,
whose boxes hold the largest counts of their points; two boxes are left out if even these counts don't
reach the overlap that their set sizes need. Surviving pairs are verified on the whole texts.

Equal sets are one class from the start. Links are needed only for components: in up to three rounds each document
of a group tries a few hubs, then the last round tries all remaining pairs of different components, each in the first of
the groups that both are in. Groups of more than ``block`` members are split into blocks. Each task gets one block and
the hubs, or two blocks.

A-Z are lower-cased; words end at ASCII white space. A document of fewer words than ``width``, but not none,
has its whole sequence as its one shingle. Null and empty texts have no shingles, are linked with nothing and
are their own component. Repeated rows each get a row; rows of one id are one document to which any of their
texts can link, so they have one component. Rows without id have the component of a row of the same set, or none.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import bigints, materialize, mix, raw_texts, small_side, table, word_hashes
from quantloom.llm.components import components

#: Groups of the smallest class, finer groups for each group, and the largest class.
DIMS, FINER, MAX_CLASS = 32, 16, 12
#: A stored count of 65535 stands for any larger one too; as a bound it counts as unlimited.
MOST, UNLIMITED = 0xFFFF, 1 << 40
LEAF = 32
#: Members that all others of a group try in each of the first rounds, whose salts these are.
HUBS, SALTS = 8, (1, 2, 3)
#: Groups of its class that a row of the last round has with it.
FIRST = 6
#: Rounds with hubs end when one links less than one in so many members.
FEW = 100
#: In place of its block, for a hub that is sent to each block of its group.
HUB = -1
#: Classes and groups that a task remembers so as not to send them again.
MAX_SEEN = 500_000


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))], np.uint64)
    h = word_hashes(words)
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s = mix(s + h[i : i + n] + np.uint64(i + 1))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def size_class(n: np.ndarray) -> np.ndarray:
    """Class k has 32 << k groups, for sets of up to 512 << k shingles. Sets two classes apart never have a similarity above a half."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / (16 * DIMS))), 0, MAX_CLASS).astype(np.int64)


def point(s: np.ndarray) -> bytes:
    dims = DIMS << int(size_class(np.array(len(s))))
    counts = np.minimum(np.bincount((s % np.uint64(dims)).astype(np.int64), minlength=dims), MOST).astype("<u2")
    parity = np.bincount(((s >> np.uint64(24)) % np.uint64(dims * FINER)).astype(np.int64), minlength=dims * FINER) & 1
    return counts.tobytes() + np.packbits(parity.astype(np.uint8)).tobytes()


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _describe(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, halves, points, prefixes = [], [], [], []
            for text, known in zip(raw_texts(batch.column(1)), batch.column(0).is_valid().to_pylist(), strict=True):
                s = shingles(text, width)
                n = len(s)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(n)
                halves.append(digest)
                if n and known and digest not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(digest)
                    points.append(point(s))
                    prefixes.append(s[: n + percent * -n // 100 + 1].view(np.int64))
                else:
                    points.append(None)
                    prefixes.append(None)
            c = np.frombuffer(b"".join(halves), "<u8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), bigints(c[:, 0]), bigints(c[:, 1]), pa.array(points, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "c1", "c2", "point", "prefix"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, c1), the members of groups of at least two classes; groups of the same members once a task."""
    seen: set[int] = set()
    old = np.zeros((2, 0), np.int64)
    parted: int | None = None

    def closed(sig: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])])
        sig, c = sig[keep], c[keep]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        key = np.add.reduceat(mix(c.view(np.uint64)), first).view(np.int64)
        tail = sig[first] == parted if parted is not None else np.zeros(len(first), bool)
        key[tail] = sig[first][tail]  # as the parts sent before
        _, once = np.unique(key, return_index=True)
        good = np.zeros(len(first), bool)
        good[once] = size[once] > 1
        good |= tail
        at = np.flatnonzero(good)
        at = at[[k not in seen for k in key[at].tolist()] | tail[at]] if at.size else at
        if len(seen) > MAX_SEEN:
            seen.clear()
        seen.update(key[at].tolist())
        rows = np.repeat(good & np.isin(np.arange(len(first)), at), size)
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, size)[rows]), pa.array(c[rows])], ["gid", "c1"])

    for batch in batches:
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype(np.int64)
        both = np.concatenate([old, new], axis=1)
        if both.shape[1]:
            # The last group may go on in the next batch. One beyond MAX_SEEN members is sent in parts, all named by its shingle.
            cut = int(np.searchsorted(both[0], both[0, -1]))
            if cut:
                yield from closed(both[0, :cut], both[1, :cut])
            old = both[:, cut:]
            if old.shape[1] > MAX_SEEN:
                yield pa.RecordBatch.from_arrays([pa.array(old[0]), pa.array(old[1])], ["gid", "c1"])
                parted, old = int(old[0, 0]), old[:, :0]
    if old.shape[1]:
        yield from closed(old[0], old[1])


class Points:
    """Sizes and points of some documents."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, raw: list[bytes]):
        self.ids, self.labels, self.sizes, self.raw, self.kind = ids, labels, sizes, raw, size_class(sizes)
        self.seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and parities of a class and the next, both with the class's groups, and the row of each place."""
        if kind not in self.seen:
            parts, row, n = [], np.full(len(self.ids), -1), 0
            for k in (kind, kind + 1):
                places = np.flatnonzero(self.kind == k)
                if places.size:
                    dims = DIMS << k
                    cells = np.frombuffer(b"".join([self.raw[i] for i in places.tolist()]), np.uint8).reshape(len(places), -1)
                    counts = np.ascontiguousarray(cells[:, : 2 * dims]).view("<u2").astype(np.int64)
                    counts[counts == MOST] = UNLIMITED
                    bits = np.ascontiguousarray(cells[:, 2 * dims :]).view(np.uint64)
                    if k > kind:  # a hash's group in half as many groups is its group less the upper half
                        counts = counts[:, : dims // 2] + counts[:, dims // 2 :]
                        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
                    parts.append((counts, bits))
                    row[places] = np.arange(n, n + len(places))
                    n += len(places)
            self.seen[kind] = (np.concatenate([c for c, _ in parts]), np.concatenate([x for _, x in parts]), row)
        return self.seen[kind]

    def passing(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of places the bounds allow."""
        need = needed(self.sizes[a], self.sizes[b], percent)
        ok = (self.labels[a] != self.labels[b]) & (need <= np.minimum(self.sizes[a], self.sizes[b])) & (abs(self.kind[a] - self.kind[b]) <= 1)
        out = np.zeros(len(a), bool)
        least = np.minimum(self.kind[a], self.kind[b])
        for kind in np.unique(least[ok]).tolist():
            counts, bits, row = self.at(kind)
            every = np.flatnonzero(ok & (least == kind))
            width = max(1, (1 << 21) // counts.shape[1])
            for first in range(0, len(every), width):  # pairs of a few MB at a time
                at = every[first : first + width]
                x, y = row[a[at]], row[b[at]]
                keep = np.minimum(counts[x], counts[y]).sum(1) >= need[at]
                at, x, y = at[keep], x[keep], y[keep]
                differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                out[at[differ <= self.sizes[a[at]] + self.sizes[b[at]] - 2 * need[at]]] = True
        return out


class Node:
    """A box of the R-tree of one class: largest counts, sizes from and to, and children or places."""

    def __init__(self, p: Points, places: np.ndarray, kind: int):
        all_counts, _, row = p.at(kind)
        counts, sizes = all_counts[row[places]], p.sizes[places]
        self.upper, self.least, self.most = counts.max(0), sizes.min(), sizes.max()
        self.places, self.children = places, []
        if len(places) > LEAF:
            by = sizes if self.most > 1.25 * self.least else counts[:, int(np.argmax(counts.var(0)))]
            order = places[np.argsort(by, kind="stable")]
            half = len(order) // 2
            self.children = [Node(p, order[:half], kind), Node(p, order[half:], kind)]


def tree_pairs(p: Points, left: np.ndarray, right: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that the bounds allow, within left or between left and right."""
    for kind in np.unique(p.kind).tolist():
        own, above = left[p.kind[left] == kind], left[p.kind[left] == kind + 1]
        if right is None:
            sides = [(own, None), (own, above)]
        else:
            sides = [(own, right[p.kind[right] == kind]), (own, right[p.kind[right] == kind + 1]), (above, right[p.kind[right] == kind])]
        for x, y in sides:
            if x.size and (y is None or y.size):
                yield from _tree_pairs(p, x, y, kind, percent)


def _tree_pairs(p: Points, left: np.ndarray, right: np.ndarray | None, kind: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    one = Node(p, left, kind)
    stack = [(one, one if right is None else Node(p, right, kind))]
    while stack:
        a, b = stack.pop()
        need = needed(a.least, b.least, percent)
        if need > min(a.most, b.most) or np.minimum(a.upper, b.upper).sum() < need:
            continue
        if a.children and (not b.children or len(a.places) >= len(b.places)):
            if a is b:
                x, y = a.children
                stack += [(x, x), (y, y), (x, y)]
            else:
                stack += [(c, b) for c in a.children]
        elif b.children:
            stack += [(a, c) for c in b.children]
        else:
            i, j = (x.ravel() for x in np.meshgrid(a.places, b.places, indexing="ij"))
            if a is b:
                i, j = i[i < j], j[i < j]
            ok = p.passing(i, j, percent)
            if ok.any():
                yield i[ok], j[ok]


def _hub_pairs(p: Points, own: np.ndarray, salt: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place with each of a few hubs: those sent to a block, else picked by a salted hash among the members of the most common label."""
    hubs = np.flatnonzero(own == HUB)
    if not hubs.size:
        labels, n = np.unique(p.labels, return_counts=True)
        common = np.flatnonzero(p.labels == labels[np.argmax(n)])
        order = np.argsort(mix(p.ids[common].view(np.uint64) + np.uint64(salt)), kind="stable")
        hubs = common[order[:HUBS]]
    for hub in hubs.tolist():
        others = np.flatnonzero((own != HUB) & (np.arange(len(p.ids)) != hub))
        hubs = np.full(len(others), hub)
        ok = p.passing(hubs, others, percent)
        if ok.any():
            yield hubs[ok], others[ok]


def _candidates(percent: int, salt: int | None):
    """Rows sorted by (gid, i, j): pairs of each (gid, i, j), with a few hubs of the group if salt is given, else all.

    Near copies meet in many groups. Each row has the FIRST smallest groups of its class, and a pair is not sent from a group if both have a
    smaller one in common, as it is sent from there; so nearly all pairs are sent once, and all at least once.
    """

    def first_here(gid: np.ndarray, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Which pairs of rows of group gid have no smaller group in common, as far as their first groups tell."""
        out = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            x, y = groups[a[part]], groups[b[part]]
            both = (x[:, :, None] == y[:, None, :]).any(2) & (x < gid[part, None])
            out[part] = ~both.any(1)
        return out

    def pairs(cols: list[np.ndarray], raw: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gid, i, j, own, ids, labels, sizes = cols
        if (labels == labels[0]).all():
            return
        p = Points(ids, labels, sizes, raw)
        if salt is not None:
            found = _hub_pairs(p, own, salt, percent)
        elif i[0] == j[0]:
            found = tree_pairs(p, np.arange(len(ids)), None, percent)
        else:
            found = tree_pairs(p, np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]), percent) if len(np.unique(own)) > 1 else iter(())
        for a, b in found:
            once = first_here(gid[a], a, b, groups)
            yield p.ids[a[once]], p.ids[b[once]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old: tuple[np.ndarray, list[bytes], np.ndarray] = (np.zeros((7, 0), np.int64), [], np.zeros((0, FIRST), np.int64))

        def closed(cols: np.ndarray, raw: list[bytes], groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (cols[:3, 1:] != cols[:3, :-1]).any(0)])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(raw))
            found = []
            twos = first[ends - first == 2]
            if twos.size:  # most groups are pairs; these go through the bounds together
                p = Points(cols[4], cols[5], cols[6], raw)
                twos = twos[p.passing(twos, twos + 1, percent)]
                twos = twos[first_here(cols[0][twos], twos, twos + 1, groups)]
                found.append((cols[4][twos], cols[4][twos + 1]))
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                if b - a > 2:
                    found += pairs(list(cols[:, a:b]), raw[a:b], groups[a:b])
            if found:
                a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)])
            cols, raw = np.concatenate([old[0], cols], axis=1), old[1] + batch.column(7).to_pylist()
            groups = np.concatenate([old[2], batch.column(8).flatten().to_numpy().reshape(-1, FIRST)])
            if raw:
                same = (cols[:3] == cols[:3, -1:]).all(0)
                cut = int(np.argmax(same))
                if cut:
                    yield from closed(cols[:, :cut], raw[:cut], groups[:cut])
                old = (cols[:, cut:], raw[cut:], groups[cut:])
        if old[1]:
            yield from closed(*old)

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, bytes], np.ndarray] = {}  # pairs of one hub often follow one another
            keep = []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3)), strict=True):
                sets = [held[k] if k in held else shingles(k[1], width) for k in ((x, s), (y, t))]
                held = {(x, s): sets[0], (y, t): sets[1]}
                s, t = sets
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), batch.column(1).filter(pa.array(mask))], ["a", "b"])

    return run


def _with_hubs(rows: DataFrame, salt: int) -> DataFrame:
    """rows: rep, gid, label, blocks. Members each in one block of their group, and the hubs of a split group in all its blocks.

    Hubs of a group in one block are picked where it is tried. Those of the others are members of the most
    common label, picked within blocks and then among blocks, so that no task reads a whole group.
    """
    members = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    split = members.where("blocks > 1")
    # One row for each group of more than a block of members.
    common = split.groupBy("gid", "label").agg(F.count("*").alias("n")).groupBy("gid").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    hubs = split.join(small_side(common, 1_000_000), ["gid", "label"]).withColumn("order", F.xxhash64("rep", F.lit(salt)))
    for keys in (["gid", "own"], ["gid"]):
        hubs = hubs.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("order", "rep"))).where(F.col("k") <= HUBS)
    hubs = hubs.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).withColumn("own", F.lit(HUB))
    columns = ["gid", "i", F.col("i").alias("j"), "own", "rep", "label"]
    return members.withColumn("i", F.col("own")).select(*columns).unionByName(hubs.select(*columns))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of docs. percent must be above 50."""
    if not 50 < percent <= 100:
        raise ValueError("the points of sets compare only for more than 50 percent")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n long, c1 long, c2 long, point binary, prefix array<long>"
    described = materialize(slim.mapInArrow(_describe(width, percent), schema), "shingles")
    classes = materialize(described.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("point").alias("point")), "classes")
    named = materialize(described.select("doc_id", "n", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"], "left").select("doc_id", "n", "rep"), "named")
    # Ids of several rows; first is the smallest of the classes of their sets.
    shared = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("doc_id", "first")
    shared = materialize(shared, "shared")

    sigs = described.where("prefix is not null").select(F.explode("prefix").alias("sig"), "c1")
    groups = sigs.repartition("sig").sortWithinPartitions("sig", "c1").mapInArrow(_groups, "gid long, c1 long").distinct()
    members = materialize(groups.join(classes.select("c1", "rep"), "c1").select("gid", "rep"), "groups")
    sizes = members.groupBy("gid").agg(F.count("*").alias("size"))
    points = classes.select("rep", "n", "point")

    links = named.join(small_side(shared, 2_000_000), "doc_id").where("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    labels = None
    n_members = members.select("rep").distinct().count()
    none = F.array_repeat(F.lit((1 << 63) - 1).cast("long"), FIRST)  # no group is below it
    rounds = [*SALTS, None]
    while rounds:
        salt = rounds.pop(0)
        if labels is None:
            rows = members.withColumn("label", F.col("rep"))
        else:
            rows = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("gid", "rep", F.coalesce("component", "rep").alias("label"))
            # Groups whose members are all linked need no more pairs.
            open_ = rows.groupBy("gid").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("gid")
            rows = rows.join(open_, "gid", "left_semi")
        if salt is None:
            rows = materialize(rows, "open")
            # At most a fifth of the set and one are collected.
            of = rows.groupBy("rep").agg(F.slice(F.concat(F.array_sort(F.collect_set("gid")), none), 1, FIRST).alias("groups"))
            large = sizes.where(F.col("size") > block).select("gid", F.ceil(F.col("size") / block).alias("blocks"))
            rows = rows.join(large, "gid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            rows = rows.join(points, "rep").join(of, "rep")
        else:
            # For a hub each document tries its largest group only: groups of near copies overlap in most members.
            most = F.max_by("gid", F.struct("size", "gid"))
            rows = rows.join(sizes, "gid").groupBy("rep").agg(most.alias("gid"), F.first("label").alias("label"), F.max("size").alias("size"))
            rows = materialize(rows.select("rep", "gid", "label", F.ceil(F.col("size") / block).alias("blocks")), "largest")
            rows = _with_hubs(rows, salt).join(points, "rep").withColumn("groups", none)
        rows = rows.select("gid", "i", "j", "own", "rep", "label", "n", "point", "groups")
        # Of the pairs tried before only those that were not similar can come again; they are few.
        pairs = materialize(rows.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(_candidates(percent, salt), "a long, b long").distinct(), "pairs")
        # Texts of both sides: the first comes to the pairs where it lies if these are few, the second by a shuffle.
        first = slim.select(F.col("doc_id").alias("a"), F.col("text").alias("s")).join(small_side(pairs, 2_000_000), "a")
        second = slim.join(small_side(pairs.select(F.col("b").alias("doc_id")).distinct(), 2_000_000), "doc_id", "left_semi")
        wide = first.join(second.select(F.col("doc_id").alias("b"), F.col("text").alias("t")).hint("shuffle_hash"), "b")
        true = materialize(wide.select("a", "b", "s", "t").mapInArrow(_verify(width, percent), "a long, b long"), "links")
        links = links.unionByName(true)
        labels = components(links, None if salt is None else 1)  # before the last round it only tells which pairs need no test
        if salt is not None and true.count() * FEW < n_members:
            rounds = [None] if None in rounds else []  # more hubs would link few
    component = named.join(shared, "doc_id", "left").withColumn("rep", F.coalesce("rep", "first")).join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return component.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both FROM s l JOIN s r ON l.g = r.g AND l.doc_id <> r.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.both >= 80 * (na.n + nb.n - x.both)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON m.a = w.doc_id
"""
