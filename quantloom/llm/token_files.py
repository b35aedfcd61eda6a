"""Token files: documents' ids in blocks, compressed by a context-mixing range coder.

Format of a record (little-endian): b"QTB2", u32 documents, u32 blocks, u64 ids; i64 document ids, u8 flags
of missing document ids, u32 ids of each document; then the blocks. A block holds up to 4096 ids: u32 ids,
u32 CRC-32 of its ids as u32, u32 words of code; u16 code words. Before each 1536 blocks stands what this group
shares: u32 bytes, u32 their CRC-32, and base-128 numbers: distinct ids, places with a follower, the sorted ids as
differences, their frequencies less 1, the places as differences, their followers, how sure these are, and shares.

An id is coded as its place by frequency in its group. Three predictors share the coding interval: the id that last
followed the two ids before it within the block (order 2), the likeliest follower of the one before it in the group
(order 1), and the frequencies of the group (order 0). The shares are how often each order is right in the group at
the same confidences. The interval is coded by a range coder of 52 bits with 16-bit words. Given what the group
shares, blocks do not depend on one another, so numpy codes one id of many blocks at each step; what is known of all
ids before coding is computed for many steps at once.

Null and empty texts have the end id only. Rows are written in ascending order of document id, missing ids
first; rows of one id stay separate. A bad checksum raises ValueError. An empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import raw_texts, shared_path, small_side, table
from quantloom.llm.tokens import default_tokenizer, encoder

BLOCK, RECENT = 4096, 4096
#: Blocks of a group, coded side by side.
GROUP = 1536
#: Steps of which the intervals are found at once.
ROWS = 128
SHARE_BITS, LEAST_REST = 10, 16
SHARES = 1 << SHARE_BITS
#: No prediction; other places are below it.
NONE = (1 << 24) - 1
SURER = 1 << 24
STATES = 64
#: Contexts of two places are spread over RECENT cells.
SPREAD = 2477
MAGIC = b"QTB2"
#: The interval is at least that before each id, and at most 2**52; a code word holds 16 bits.
LEAST = 1 << 36
#: Texts are tokenized in portions of about this size.
PORTION_BYTES = 4 << 20
RECORD = "part int, seq int, start long, n_ids long, record binary"


class _Model:
    """What the blocks of a group share: frequencies of order 0, the likeliest follower of each place, shares of the interval.

    Places count from the most frequent id. A prediction is its confidence << 24 (order 2, 0 to 3) or << 26 (order 1,
    0 to 7) | a place, or NONE. A state is both confidences and whether the places agree, a kind is the order that was
    right (0 to 2). The interval of an id is begin + rest * below to begin + span + rest * (below + freq), by state and kind.
    """

    def __init__(self, freq: np.ndarray, best: np.ndarray):
        self.freq, self.best, self.below = freq, best, np.cumsum(freq) - freq
        self.bits = int(freq.sum()).bit_length() - 1
        self.unit_bits = self.bits + SHARE_BITS

    def share(self, shares: np.ndarray) -> None:
        """shares: those of orders 1 and 2 for each state. Tables are by case: state << 2 | kind."""
        self.shares = shares
        one, two = (shares << self.bits).T
        none, left = np.zeros_like(one), SHARES - shares.sum(1)
        self.begin = np.stack([one + two, two, none, none], 1).reshape(-1)
        self.span = np.stack([none, one, two, none], 1).reshape(-1)
        self.rest = np.stack([left, none, none, none], 1).reshape(-1)


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """In proportion to counts, at least 1 each, with a power of two as their sum."""
    k = len(counts)
    bits = max(k.bit_length() + 1, min(20, k.bit_length() + 6))
    ends = np.cumsum(counts) * ((1 << bits) - k) // max(1, int(counts.sum())) + np.arange(1, k + 1)
    return np.diff(ends, prepend=0)


def _followers(columns: np.ndarray, k: int) -> np.ndarray:
    """The likeliest follower of each place by every eighth block; a wrong one costs bits, never a wrong id."""
    some = columns[:, ::8]
    pair = np.sort((some[:-1] * k + some[1:]).reshape(-1))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    count, (place, follower) = np.diff(first, append=len(pair)), np.divmod(pair[first], k)
    total = np.bincount(place, count, k).astype(np.int64)[place]
    good = np.flatnonzero((count >= 4) & (16 * count >= total))
    good = good[np.argsort(count[good], kind="stable")]  # of one place, the commonest comes last
    best = np.full(k, NONE)
    best[place[good]] = (np.minimum(1 + 7 * count[good] // total[good], 7) << 26) | follower[good]
    return best


def _cells(one: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Where order 2 keeps what last followed two places."""
    return (one + SPREAD * earlier) & (RECENT - 1)


def _encode_lanes(columns: np.ndarray, model: _Model) -> list[np.ndarray]:
    """columns: places, a column for each block below two rows of zeros. The code words of each block; sets the model's shares."""
    length, n = len(columns) - 2, columns.shape[1]
    lane, second, found = np.arange(n) * RECENT, np.full(n * RECENT, NONE, np.int32), np.zeros((length, n), np.int32)
    cases, right = np.zeros((length, n), np.uint8), np.zeros(4 * STATES, np.int64)
    for r in range(0, length, ROWS):
        p2s = found[r : r + ROWS]
        earlier, one, x = (columns[r + i : r + i + len(p2s)] for i in range(3))
        places = x.astype(np.int32)
        for at, p2, c, new, most in zip(_cells(one, earlier) + lane, p2s, places, places + SURER, places + 3 * SURER, strict=True):
            second.take(at, out=p2, mode="clip")
            second[at] = np.where((p2 & NONE) == c, np.minimum(p2 + SURER, most), new)
        p1 = model.best.take(one)
        c1, c2 = p1 & NONE, p2s & NONE
        hit2 = c2 == x
        case = (((p1 - c1 + p2s - c2) >> 24) << 3) + ((c1 == c2) << 2) + 2 * hit2 + (~hit2 & (c1 == x))
        right += np.bincount(case.reshape(-1), minlength=4 * STATES)
        cases[r : r + ROWS] = case
    right = right.reshape(-1, 4)
    shares = right[:, 1:3] * (SHARES - LEAST_REST) // np.maximum(1, right.sum(1))[:, None]
    model.share(np.maximum(shares, right[:, 1:3] > 0))
    low, size = np.zeros(n, np.int64), np.full(n, (1 << 52) - 1)
    words, lanes = [], []
    for r in range(0, length, ROWS):
        case, x = cases[r : r + ROWS], columns[r + 2 : r + ROWS + 2]
        rest = model.rest.take(case)
        begins, widths = model.begin.take(case) + rest * model.below.take(x), model.span.take(case) + rest * model.freq.take(x)
        for begin, width in zip(begins, widths, strict=True):
            unit = size >> model.unit_bits
            low += unit * begin
            size = unit * width
            due = (size < LEAST).nonzero()[0]
            while due.size:
                high = low.take(due)
                words.append((high >> 36).astype(np.int32))  # with any carry, which _carried passes on
                lanes.append(due.astype(np.uint16))
                low[due] = (high & (LEAST - 1)) << 16
                size[due] = wide = size.take(due) << 16
                due = due[wide < LEAST]
    words.append(((low + LEAST - 1) >> 36).astype(np.int32))
    lanes.append(np.arange(n, dtype=np.uint16))
    own = np.concatenate(lanes)
    return np.split(np.concatenate(words)[np.argsort(own, kind="stable")], np.cumsum(np.bincount(own))[:-1])


def _carried(words: np.ndarray) -> np.ndarray:
    while (over := words >> 16).any():
        words = words & 0xFFFF
        words[:-1] += over[1:]
    return words.astype("<u2")


def _decode_lanes(codes: list[np.ndarray], length: int, model: _Model) -> np.ndarray:
    """A column of places for each block."""
    n, stride = len(codes), max(map(len, codes)) + 8
    words = np.zeros((n, stride), np.int64)
    for row, c in zip(words, codes, strict=True):
        row[: len(c)] = c
    words = words.reshape(-1)
    pos = np.arange(n) * stride + 3
    code = (words[pos - 3] << 36) | (words[pos - 2] << 20) | (words[pos - 1] << 4) | (words[pos] >> 12)
    words[:-1] = ((words[:-1] & 0xFFF) << 4) | (words[1:] >> 12)  # 52 bits are no whole number of words
    slots = np.repeat(np.arange(len(model.freq)), model.freq).astype(np.uint16 if len(model.freq) < 1 << 16 else np.int32)
    lane, second = np.arange(n), np.full(n * RECENT, NONE)
    cell, size = lane * RECENT, np.full(n, (1 << 52) - 1)
    inside, unit_bits, bits = np.array((1 << model.unit_bits) - 1), np.array(model.unit_bits), np.array(model.bits)
    none, low24, sixteen, share_bits, least = (np.array(v) for v in (NONE, 24, 16, SHARE_BITS, LEAST))
    case = np.arange(4 * STATES)
    kind = case & 3
    # The case of each share of each state; by case, where its place is found, what is divided by, and a cell's new confidence.
    one, two = model.shares.T
    cases = np.repeat(np.flatnonzero(kind < 3), np.stack([SHARES - one - two, one, two], 1).reshape(-1)).reshape(STATES, SHARES)
    cases = np.ascontiguousarray(cases[:, ::-1]).reshape(-1)  # order 2 comes first
    source, divisor = kind % 3 * n, np.maximum(model.rest, 1)
    sure = np.where(kind == 2, np.minimum(((case >> 3) & 3) + 1, 3), 1) << 24
    columns, found = np.zeros((length + 2, n), np.int64), np.zeros((3, n), np.int64)
    place, c1, c2 = found
    for earlier, one, x in zip(columns, columns[1:], columns[2:], strict=False):
        at = _cells(one, earlier) + cell
        p1, p2 = model.best.take(one), second.take(at)
        np.bitwise_and(p1, none, out=c1)
        np.bitwise_and(p2, none, out=c2)
        state = (((p1 - c1 + p2 - c2) >> low24) << 1) + (c1 == c2)
        unit = size >> unit_bits
        value = code // unit & inside
        case = cases.take((state << share_bits) + (value >> bits))
        begin, rest = model.begin.take(case), model.rest.take(case)
        place[:] = slots.take((value - begin) // divisor.take(case), mode="clip")
        found.take(source.take(case) + lane, out=x, mode="clip")
        code -= unit * (begin + rest * model.below.take(x))
        size = unit * (model.span.take(case) + rest * model.freq.take(x))
        due = (size < least).nonzero()[0]
        while due.size:
            next_word = pos.take(due)
            code[due] = (code.take(due) << sixteen) | words.take(next_word, mode="clip")
            pos[due] = next_word + 1
            size[due] = wide = size.take(due) << sixteen
            due = due[wide < least]
        second[at] = x + sure.take(case)
    return columns[2:]


def _packed(values: np.ndarray) -> bytes:
    """Numbers in base 128, low digits first, the last digit of each with its high bit clear."""
    digits = (np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 7) // 7
    at = np.cumsum(digits) - digits
    out = np.zeros(int(digits.sum()), np.uint8)
    for k in range(int(digits.max(initial=0))):
        own = digits > k
        out[at[own] + k] = ((values[own] >> (7 * k)) & 127) | ((digits[own] > k + 1) << 7)
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127) << (7 * place), first)


def _encode_group(ids: np.ndarray) -> list[bytes]:
    length = -(-len(ids) // -(-len(ids) // BLOCK))
    blocks = [ids[i : i + length] for i in range(0, len(ids), length)]
    if int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        alphabet, at = np.flatnonzero(counts), (np.cumsum(counts > 0) - 1).astype(np.int32)[ids]
        counts = counts[alphabet]
    else:
        alphabet, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = _frequencies(counts)
    order = np.argsort(-freq, kind="stable")
    filled = np.zeros(len(blocks) * length, np.int32)  # with less than one id a block more
    filled[: len(ids)] = np.argsort(order).astype(np.int32)[at]
    columns = np.concatenate([np.zeros((2, len(blocks)), np.int64), filled.reshape(-1, length).T])
    model = _Model(freq[order], _followers(columns[2:], len(order)))
    codes = _encode_lanes(columns, model)
    known = np.flatnonzero(model.best != NONE)
    best = model.best[known]
    gaps = np.diff(alphabet.astype(np.int64), prepend=0)
    raw = _packed(np.concatenate([[len(order), len(known)], gaps, freq - 1, np.diff(known, prepend=0), best & NONE, best >> 26, model.shares.reshape(-1)]))
    out = [struct.pack("<3I", len(b), zlib.crc32(b.astype("<u4").tobytes()), len(c)) + c.tobytes() for b, c in zip(blocks, map(_carried, codes), strict=True)]
    out[0] = struct.pack("<2I", len(raw), zlib.crc32(raw)) + raw + out[0]
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of one row of ids; the first block of a group begins with what the group shares."""
    return list(chain.from_iterable(_encode_group(ids[i : i + GROUP * BLOCK]) for i in range(0, len(ids), GROUP * BLOCK)))


def _shared(raw: bytes) -> tuple[np.ndarray, _Model]:
    """Ids by place, and the model of a group."""
    values = _unpacked(raw)
    k, n = values[:2].tolist()
    alphabet, freq, known, follower, sure, shares = np.split(values[2:], np.cumsum([k, k, n, n, n]))
    freq, best = freq + 1, np.full(k, NONE)
    order = np.argsort(-freq, kind="stable")
    best[np.cumsum(known)] = (sure << 26) | follower
    model = _Model(freq[order], best)
    model.share(shares.reshape(STATES, 2))
    return np.cumsum(alphabet)[order].astype(np.uint32), model


def decode_blocks(data: bytes, n_blocks: int) -> np.ndarray:
    """The ids of n_blocks blocks in a row; ValueError if a checksum is wrong."""
    out, at = [np.zeros(0, np.uint32)], 0
    for first in range(0, n_blocks, GROUP):
        n_raw, crc = struct.unpack_from("<2I", data, at)
        raw, at = data[at + 8 : at + 8 + n_raw], at + 8 + n_raw
        if zlib.crc32(raw) != crc:
            raise ValueError(f"group of block {first}: wrong checksum")
        alphabet, model = _shared(raw)
        heads, codes = [], []
        for _ in range(first, min(first + GROUP, n_blocks)):
            n, crc, n_code = struct.unpack_from("<3I", data, at)
            heads.append((n, crc))
            codes.append(np.frombuffer(data, "<u2", n_code, at + 12))
            at += 12 + 2 * n_code
        columns = _decode_lanes(codes, min(BLOCK, max(n for n, _ in heads)), model)
        for i, (row, (n, crc)) in enumerate(zip(alphabet[columns.T], heads, strict=True), first):
            if zlib.crc32(row[:n].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {i}: wrong checksum")
            out.append(row[:n])
    return np.concatenate(out)


def encode_record(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    head = MAGIC + struct.pack("<IIQ", len(doc_ids), len(blocks), len(ids))
    known = np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()
    return b"".join([head, known, bytes(d is None for d in doc_ids), lengths.astype("<u4").tobytes(), *blocks])


def decode_record(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, how many ids each has, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a record of token blocks")
    n, n_blocks, n_ids = struct.unpack_from("<IIQ", data, 4)
    at = 20
    known, missing = np.frombuffer(data, "<i8", n, at).tolist(), data[at + 8 * n : at + 9 * n]
    lengths = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
    ids = decode_blocks(data[at + 13 * n :], n_blocks)
    if len(ids) != n_ids or lengths.sum() != n_ids:
        raise ValueError("a record's lengths don't agree")
    return [None if m else d for d, m in zip(known, missing, strict=True)], lengths, ids


def portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes | None]]]:
    """First column and texts of the second, in runs of about PORTION_BYTES."""
    keys, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= PORTION_BYTES:
            yield keys[first : i + 1], texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield keys[first:], texts[first:]


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        keys, ids, lengths = [], [], []

        def record() -> pa.RecordBatch:
            nonlocal seq, start
            row = [part, seq, start, total := sum(map(len, ids)), encode_record(keys, np.concatenate(lengths), np.concatenate(ids))]
            seq, start = seq + 1, start + total
            for x in (keys, ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "start", "n_ids", "record"])

        try:
            for own, texts in chain.from_iterable(map(portions, batches)):
                coded, sizes = tool.encode_all(texts, end_id)
                keys += own
                ids.append(coded)
                lengths.append(sizes)
                if sum(map(len, ids)) >= GROUP * BLOCK:
                    yield record()
            if keys:
                yield record()
        finally:
            tool.forget()  # else idle workers hold their caches

    return run


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, files: int | None = None) -> None:
    """Tokenize docs and write their ids to files in path, in ascending order of document id."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]  # rows of one id, or without id, need not be in one file
    ordered = slim.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_write(tokenizer or default_tokenizer(), end_id), RECORD).write.option("compression", "none").parquet(path)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("part", "start", "record")), strict=True):
                docs, lengths, ids = decode_record(data)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    records = spark.read.schema(RECORD).parquet(path)
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    rows = records.select("part", "start", "record").mapInArrow(_read(with_ids), "doc_id long, part int, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    joined = rows.join(small_side(parts, 1_000_000), "part")
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, end_id=1)
    return read_tokens(spark, path)
