"""Language identification: accuracy on documents that were not learned from, and against plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.llm import language_id
from quantloom.llm.common import table

DOC = "doc_id long, text string, lang string, tag string, word string, key string"


def grams(word, n):
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def plain_python(learned, texts, longest=4):
    """lang_pred and score of each text, by the docstring."""
    said = lambda t: re.findall(r"[^\W\d_]{1,40}", (t or "").lower())
    names = sorted({g for _, g in learned})
    words = {g: Counter(w for t, x in learned if x == g for w in said(t)) for g in names}
    pieces = {g: {n: Counter() for n in range(1, longest + 1)} for g in names}
    for g in names:
        for w, times in words[g].items():
            for n in pieces[g]:
                for p in grams(w, n):
                    pieces[g][n][p] += times
    micro = lambda x: math.floor(x * 1e6 + 0.5)

    def scores(tables, key):
        if not any(t[key] for t in tables):
            return None
        totals = [max(1, sum(t.values())) for t in tables]
        return [micro(math.log(t[key] / n) if t[key] else math.log(0.5 / max(totals))) for t, n in zip(tables, totals, strict=True)]

    def word_scores(w):
        if (s := scores([words[g] for g in names], w)) is not None:
            return s
        for n in range(longest, 0, -1):
            known = [s for p in grams(w, n) if (s := scores([pieces[g][n] for g in names], p)) is not None]
            if known:
                return [micro(sum(x) / len(known) / 1e6) for x in zip(*known, strict=True)]
        return None

    out, cache = [], {}
    for t in texts:
        found = said(t)
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        for w in set(found) - set(cache):
            cache[w] = word_scores(w)
        kept = [cache[w] for w in found if cache[w] is not None]
        if not kept:
            out.append((min(names, key=lambda g: (-sum(words[g].values()), g)), 1 / len(names)))
            continue
        sums = [sum(x) for x in zip(*kept, strict=True)]
        out.append((names[sums.index(max(sums))], 1 / sum(math.exp((s - max(sums)) / len(kept) / 1e6) for s in sums)))
    return out


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("cells", [language_id.HEAD_CELLS, 4000, 0])
def test_like_plain_python_wherever_scores_are_found(spark, rows, monkeypatch, cells):
    """With fewer cells, words are looked up by broadcast or by join instead of in the readers of documents."""
    monkeypatch.setattr(language_id, "HEAD_CELLS", cells)
    some = rows[:120] + [(1000, None, "en"), (1001, "", "en"), (1002, "12 ½ !", None), (1003, "日本 語", None), (1004, "der der the the", None), (1004, "der der the the", None), (None, "ÉÈ zzz qqqq", "xx"), (1005, "x" * 3_000_000, None), (1006, "Straße und Größe " * 90_000, None)]
    docs = spark.createDataFrame([(i, t, g, "t", "w", "k") for i, t, g in some], DOC).repartition(3)
    model = language_id.learn(docs.where("doc_id is null or doc_id % 2 = 0"))
    found = language_id.identify(docs, model, tag=F.length("text")).collect()
    expected = plain_python([(t, g) for i, t, g in some if g is not None and (i is None or i % 2 == 0)], [t for _, t, _ in some])
    key = lambda x: (str(x[0]), str(x[1]))
    ours = sorted([(r.doc_id, r.tag, r.lang_pred, round(r.score, 5)) for r in found], key=key)
    assert ours == sorted([(i, None if t is None else len(t), g, round(s, 5)) for (i, t, _), (g, s) in zip(some, expected, strict=True)], key=key)


def test_nothing_learned_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words", None, "t", "w", "k"), (2, None, None, "t", "w", "k")], DOC)
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, language_id.learn(docs)).collect()} == {("und", 0.0)}
    blank = spark.createDataFrame([(1, "", "en", "t", "w", "k"), (2, None, "de", "t", "w", "k")], DOC)
    model = language_id.learn(blank)
    assert model.languages == ["de", "en"]
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()} == {("de", 0.5), ("und", 0.0)}
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert language_id.learn(docs.limit(0)).languages == []


def test_held_out_documents(spark, rows):
    """The registered query: all rows, the third held out by id, and the languages of that third."""
    found = {r.doc_id: r for r in language_id.op13_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {i for i, _, _ in rows} and len(found) == len(rows)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in found.values())
    told = [(found[i].lang_pred, g) for i, t, g in rows if found[i].held_out and found[i].lang_pred != "und"]
    assert sum(a == b for a, b in told) >= 0.97 * len(told) and len(told) > 40
