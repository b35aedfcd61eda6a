"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.common import table
from quantloom.llm.periodic_runs import find_runs, op12_periodic_runs, periodic_runs, planted

DOC = "doc_id long, text string, runs string, n_words long, collapsed string, id_text string"


def runs_of(words, least=6, times=4):
    """By the definition: for each period all stretches that cannot be longer, without those of a smaller period."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(a <= i and j + q <= a + n and p < q for a, n, p in found):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_of(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(seed):
    """Words of a few letters with repeated blocks, so that runs of many periods meet and overlap."""
    r, words = random.Random(seed), []
    while len(words) < 150:
        block = [r.choice("ab" if r.random() < 0.5 else "abcdef") for _ in range(r.randint(1, 12))]
        words += block * r.randint(1, 7) + block[: r.randint(0, len(block))]
    return words


@pytest.mark.parametrize("least, times", [(6, 4), (2, 3), (20, 5), (9, 3)])
def test_many_documents_at_once(least, times):
    docs = [periodic(i) for i in range(60)] + [[], ["a"], ["a"] * 400, ["a", "b"] * 100, [f"w{i}" for i in range(300)]]
    names = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    start, length, period = find_runs(doc, np.array([names[w] for d in docs for w in d]), least, times)
    first = np.cumsum([0, *(len(d) for d in docs)])
    expected = [(a + first[k], n, q) for k, d in enumerate(docs) for a, n, q in runs_of(d, least, times)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == expected
    assert len(expected) > 50


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab", max_size=60))
def test_two_words(text):
    words = np.array([ord(c) for c in text], np.int64)
    assert list(zip(*(x.tolist() for x in find_runs(np.zeros(len(words), np.int64), words)), strict=True)) == runs_of(text)


def test_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "A b\x0bA b A\tb A b c"), (5, "x " * 9), (6, long), (7, "é é é é é é 日本"), (7, "é é é é é é 日本"), (None, "z z z z z z")]
    docs = spark.createDataFrame([(i, t, "r", 1, "c", "x") for i, t in rows], DOC).repartition(3)
    found = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(docs).collect()}
    words = [(i, (t or "").split()) for i, t in rows if i != 6]
    expected = {(i, len(w), tuple(runs_of(w)), collapsed_of(w, runs_of(w))) for i, w in words}
    assert found == expected | {(6, 60_000, ((0, 60_000, 997),), " ".join(f"w{i}" for i in range(997)))}
    assert periodic_runs(docs).count() == len(rows)
    assert periodic_runs(spark.createDataFrame([], DOC)).count() == 0
    with pytest.raises(ValueError, match="three times"):
        periodic_runs(docs, times=2)


def test_planted_periods(spark, sf_dir):
    """The registered query over the smallest table, whole."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected, with_runs = {}, 0
    for r in table(spark, sf_dir, "documents").collect():
        words = [w for w in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            a, g = h // 10 % len(words), h // 10
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            assert (planted(str(r.doc_id), len(words)) < a + p).all()
        runs = runs_of(words) if len(words) < 3000 else None
        if runs is not None:
            best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
            with_runs += bool(runs)
            expected[r.doc_id] = (len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed_of(words, runs)))
    found = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert {k: found[k] for k in expected} == expected
    assert len(found) == table(spark, sf_dir, "documents").count() and with_runs > 5
