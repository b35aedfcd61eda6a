"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, stop) over buffers that never change: its text, and the sentinels. Cutting it
into prefix, middle and suffix splits descriptors, an arrangement permutes them, the inverse permutation restores the
document, and hashes run over the descriptors; no text is copied for any of it.

A unit is a run of ASCII letters or any other code point. Cuts, forms and their shares come from the sha256 of
``seed:doc_id``, so a document has the same form wherever and whenever it is made. A document stays plain if its text is empty or holds a
sentinel, or by its hash. Null texts are empty ones, a null id counts as an empty one, repeated rows give equal rows, and an
empty table gives none. A long text takes two more bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import raw_texts, table

#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
#: The order in which the parts of a document (prefix, middle, suffix, then the three sentinels) are written.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: Bytes that begin a code point of their own unit.
SINGLE = np.array([not LETTER[b] and b & 0xC0 != 0x80 for b in range(256)])
BLOCK = 1 << 16


class PieceTable:
    def __init__(self, *buffers: bytes):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [(i, 0, len(b)) for i, b in enumerate(buffers)]

    def cut(self, piece: int, *offsets: int) -> None:
        """Split a descriptor at byte offsets from its start, in ascending order; parts may be empty."""
        buffer, start, stop = self.pieces[piece]
        ends = [start, *(start + o for o in offsets), stop]
        self.pieces[piece : piece + 1] = [(buffer, a, b) for a, b in zip(ends, ends[1:])]

    def arrange(self, order: Sequence[int]) -> None:
        self.pieces = [self.pieces[i] for i in order]

    def restore(self, order: Sequence[int]) -> None:
        """Undo arrange(order)."""
        self.arrange(np.argsort(order).tolist())

    def parts(self) -> Iterator[memoryview]:
        return (self.buffers[b][start:stop] for b, start, stop in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.parts():
            digest.update(part)
        return digest.hexdigest()


def unit_starts(text: bytes) -> np.ndarray:
    """For each byte whether a unit begins there."""
    b = np.frombuffer(text, np.uint8)
    letter = LETTER[b]
    begins = SINGLE[b]
    begins[:1] |= letter[:1]
    begins[1:] |= letter[1:] & ~letter[:-1]
    return begins


def offset_of(begins: np.ndarray, unit: int) -> int:
    """The byte at which a unit begins; the end for the unit after the last."""
    at = 0
    while at < len(begins):
        here = int(np.count_nonzero(begins[at : at + BLOCK]))
        if unit < here:
            return at + int(np.flatnonzero(begins[at : at + BLOCK])[unit])
        unit, at = unit - here, at + BLOCK
    return len(begins)


def code_points(part: memoryview) -> int:
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def restored(output: bytes, form: str, sentinels: Sequence[bytes]) -> PieceTable:
    """The document, rebuilt from what was written and its form."""
    made = PieceTable(output)
    if form == "plain":
        return made
    order = ARRANGEMENTS[form]
    bounds, at = [], 0
    for mark in (sentinels[i - 3] for i in order if i >= 3):
        at = output.index(mark, at)
        bounds += [at, at := at + len(mark)]
    made.cut(0, *bounds[1:])  # the first sentinel begins at 0
    made.restore(order)
    made.pieces = made.pieces[:3]
    return made


def _transform(sentinels: Sequence[bytes], seed: int, plain: int, spm: int, texts: bool):
    def one(doc_id: str | None, text: bytes) -> tuple:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        begins = unit_starts(text)
        n = int(np.count_nonzero(begins))
        made = PieceTable(text, *sentinels)
        if not text or h3 % 100 >= 100 - plain or any(s in text for s in sentinels):
            made.pieces = made.pieces[:1]
            form, chars = "plain", (None, None)
        else:
            form = "spm" if h4 % 100 < spm else "psm"
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            made.cut(0, offset_of(begins, first), offset_of(begins, last))
            prefix, middle = list(made.parts())[:2]
            chars = code_points(prefix), code_points(middle)
            made.arrange(ARRANGEMENTS[form])
        output = b"".join(made.parts())
        return n, form, *chars, made.sha256(), restored(output, form, sentinels).sha256(), output if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            size = pa.compute.sum(pa.compute.binary_length(batch.column(2))).as_py() or 0
            step = max(1, batch.num_rows * BLOCK * 64 // max(size, 1))  # outputs of about 4 MB at once
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                found = [one(i, t or b"") for i, t in zip(ids[at : at + step], raw_texts(rows.column(2)))]
                n, form, prefix, middle, output_hash, restored_hash, output = zip(*found)
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output_hash), pa.array(restored_hash)]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                if texts:
                    columns.append(pa.array(output, pa.binary()).cast(pa.string()))
                    names.append("output")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS, texts: bool = True) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if plain), hashes of the output and of the text rebuilt from it; with texts also output.

    One row a document, without a shuffle. Sentinels must differ, and none may begin inside another.
    """
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("three different sentinels are needed, and the first character of any must not be within another")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id_text"), F.col(text).cast("string").alias("text"))
    schema = slim.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output_sha256", "string").add("restored_sha256", "string")
    return slim.mapInArrow(_transform([s.encode() for s in sentinels], seed, plain_percent, spm_percent, texts), schema.add("output", "string") if texts else schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
v AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM h),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
m AS (SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(output, '<M>') AS y FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, x - 4) || substr(output, y + 3) || substr(output, x + 3, y - x - 3)
    ELSE substr(output, x + 3, y - x - 3) || substr(output, y + 3) || substr(output, 4, x - 4) END) AS restored_sha256
FROM m"""
