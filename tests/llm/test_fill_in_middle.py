"""Piece tables and the fill-in-middle transformation."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.fill_in_middle import ARRANGEMENTS, SENTINELS, PieceTable, fill_in_middle, offset_of, restored, unit_starts

DOC = "doc_id long, text string, form string, n long, output string, id_text string"
LONG = "word, ünï 日本 " * 40_000
ROWS = [(1, None), (2, ""), (3, "one"), (4, "a<P>b"), (5, "日本 ünï\n\nxy Z9"), (6, LONG), (7, "same text"), (7, "same text"), (None, "no id here"), *[(i, f"doc {i}, with <some> words and <S marks>") for i in range(10, 400)]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_python(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_like_plain_python(spark):
    docs = spark.createDataFrame([(i, t, "f", 1, "o", "x") for i, t in ROWS], DOC).repartition(3)
    found = fill_in_middle(docs).collect()
    key = lambda r: tuple(str(v) for v in r)
    expected = [(i, *plain_python(i, t), sha(plain_python(i, t)[-1]), sha(t or "")) for i, t in ROWS]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in found), key=key) == sorted(expected, key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_other_columns_and_parameters(spark):
    assert fill_in_middle(spark.createDataFrame([], DOC)).count() == 0
    docs = spark.createDataFrame([("a", "some text"), ("b", "more text")], "key string, body string")
    rows = fill_in_middle(docs, "key", "body", seed=7, plain_percent=0, spm_percent=100, sentinels=("[1]", "[2]", "[3]")).collect()
    assert {r.form for r in rows} == {"spm"} and all(r.output.startswith("[2]") for r in rows)
    assert {r.restored_sha256 for r in rows} == {sha("some text"), sha("more text")}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle(docs, "key", "body", sentinels=bad)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM> é日", max_size=30), st.data())
def test_any_cut_comes_back(text, data):
    if any(s in text for s in SENTINELS):
        return
    raw, marks = text.encode(), [s.encode() for s in SENTINELS]
    begins = unit_starts(raw)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert int(begins.sum()) == len(units)
    a, b = sorted(data.draw(st.integers(0, len(units))) for _ in range(2))
    for form, order in ARRANGEMENTS.items():
        made = PieceTable(raw, *marks)
        made.cut(0, offset_of(begins, a), offset_of(begins, b))
        assert [bytes(p).decode() for p in made.parts()][:3] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
        made.arrange(order)
        output = b"".join(made.parts())
        assert made.sha256() == hashlib.sha256(output).hexdigest()
        assert b"".join(restored(output, form, marks).parts()) == raw
