"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two Markov models of order 2 give the probability of each character of a candidate after the two before it:
one of random strings, one of ordinary identifiers. Both are trained from labelled samples of the corpus at
hand: values that the fixed patterns find (label 1) and all words and numbers outside, also joined as compounds() does (label 0), counted
over all documents; runs of 12 or more that mix letters and digits are no samples. Every run of 12 or more of
``[A-Za-z0-9+/_=-]`` with a letter is a candidate: it is a secret of kind ``markov`` if the ratio exceeds ``least_ratio`` nats
a character and it overlaps no span of the fixed patterns, which always stay.

Kinds: assign (a named value of 8 or more characters; the span is the whole match), access, hex, markov.
Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are scanned one
by one. Without samples of a kind its model is uniform.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import table

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
LETTER, DIGIT = re.compile(rb"[A-Za-z]").search, re.compile(rb"[0-9]").search
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A character is one byte here, others than Latin-1 a question mark, so that offsets stay and bytes can be searched fast.
AS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: Symbols of the models: 0 for the border and others, then these.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(SYMBOLS) + 1
CODES = np.zeros(256, np.int64)
CODES[[ord(c) for c in SYMBOLS]] = np.arange(1, SIZE)

#: Nats a character above which a candidate is a secret, chosen on the labelled list of the tests: no ordinary string, nine of ten random keys of 16 characters.
LEAST_RATIO = 3.0
#: Characters counted at once.
PORTION = 1 << 20

Span = tuple[str, int, int]


def _bytes(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def base_spans(text: str, flat: bytes | None = None) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    flat = _bytes(text) if flat is None else flat
    found: list[Span] = []
    low = flat.lower()
    if any(n.encode() in low for n in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in flat:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in flat.translate(AS_HEX):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(text: str, span: Span) -> str:
    kind, a, b = span
    return ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b]


def transitions(values: bytes) -> np.ndarray:
    """Codes of (two characters before, character) for each symbol; whatever else lies between two words ends them."""
    c = CODES[np.frombuffer(values, np.uint8)]
    before = np.concatenate([[0], c[:-1]])
    earlier = np.where(before > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)], 0)
    return ((earlier * SIZE + before) * SIZE + c)[c > 0]


def compounds(words: bytes) -> list[bytes]:
    """Ordinary words, and what identifiers, paths, dates and versions make of them and of numbers: joined by marks, or with capitals."""
    return [words, *(words.replace(b" ", mark) for mark in (b"_", b"-", b"/")), words.title().replace(b" ", b""), words.upper().replace(b" ", b"_")]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE**3), np.int64)
    secrets: list[bytes] = []
    plain: list[bytes] = []

    def add() -> None:
        words = b" ".join(plain)
        for label, values in (*((0, v) for v in compounds(words)), (1, b" ".join(secrets))):
            for at in range(0, len(values), PORTION):
                counts[label] += np.bincount(transitions(values[at : at + PORTION]), minlength=SIZE**3)
        plain.clear()
        secrets.clear()

    held = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            text = text or ""
            flat = bytearray(_bytes(text))
            for span in base_spans(text, bytes(flat)):
                secrets.append(_bytes(_value(text, span)))
                flat[span[1] : span[2]] = b" " * (span[2] - span[1])
            for m in CANDIDATE.finditer(bytes(flat)) if DIGIT(flat) else ():  # what may be secret is no sample of words
                if DIGIT(m[0]) and LETTER(m[0]):
                    flat[m.start() : m.end()] = b" " * len(m[0])
            plain.append(bytes(flat))
            if (held := held + len(flat)) >= PORTION:
                add()
                held = 0
    add()
    label, code = counts.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[label, code])], ["label", "code", "n"])


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of random string to identifier for each transition; a fixed-size table."""
    seen = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_samples, "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SIZE**3))
    for r in seen.collect():  # at most 2 * SIZE**3 rows
        counts[r.label, r.code] = r.n
    logs = []
    for c in counts.reshape(2, SIZE, SIZE, SIZE):
        one = c.sum((0, 1)) + 1.0
        two = c.sum(0) + SIZE * one / one.sum()
        two /= two.sum(1, keepdims=True)
        three = c + 16.0 * two[None]
        logs.append(np.log(three / three.sum(2, keepdims=True)))
    return (logs[1] - logs[0]).reshape(-1)


def ratios(model: np.ndarray, values: list[bytes]) -> np.ndarray:
    """Mean log-likelihood ratio a character of each value, all of them of SYMBOLS only."""
    if not values:
        return np.zeros(0)
    ends = np.cumsum([len(v) for v in values])
    return np.add.reduceat(model[transitions(b" ".join(values))], np.append(0, ends[:-1])) / np.diff(ends, prepend=0)


def _scan(model, least_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[Span]] = []
            places, values = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                flat = _bytes(text)
                spans = base_spans(text, flat)
                for m in CANDIDATE.finditer(flat):
                    a, b = m.span()
                    if LETTER(m[0]) and (not spans or all(b <= s or a >= e for _, s, e in spans)):
                        places.append((len(rows), a, b))
                        values.append(m[0])
                rows.append(spans)
            for i in np.flatnonzero(ratios(model.value, values) > least_ratio).tolist():
                row, a, b = places[i]
                rows[row].append(("markov", a, b))
            rows = [sorted(r, key=lambda s: (s[1], KINDS.index(s[0]))) for r in rows]
            flat = [s for r in rows for s in r]
            kinds, starts, ends = (list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [])
            items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], ["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: np.ndarray | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each row; the model is trained on docs if none is given."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, text) if model is None else model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = slim.select("doc_id", F.lit(None).cast("array<struct<kind:string,start:long,end:long>>").alias("spans")).schema
    return slim.mapInArrow(_scan(shared, least_ratio), schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
