"""Shift tables for many patterns and long windows."""

import random

import numpy as np
import pytest

from quantloom.llm import decontamination as d


def zipf(n, seed, vocabulary=50_000):
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    return [b"w%d" % i for i in r.choice(vocabulary, n, p=p / p.sum())]


def test_few_positions_are_let_through_by_many_patterns():
    n, window = 400_000, 13
    width, cells = d.sizes(n)
    text = zipf(n + window - 1, 1)
    # As each block of the item but the first ones ends a window, the shift of a block is 0.
    table = np.full(cells, window - width + 1, np.uint16)
    table[[d.cell(text[i - width : i], cells) for i in range(window, len(text) + 1)]] = 0
    tool = d.WuManber({window: table}, None, width)
    other = zipf(40_000, 2)
    assert sum(1 for _ in tool.find(other)) < 0.02 * len(other)


@pytest.mark.parametrize("two, three", [(0, 0), (0, 1 << 17), (1 << 15, 1 << 17)])
@pytest.mark.parametrize("window", [1, 3, 13, 300])
def test_blocks_of_any_width_like_plain_python(spark, monkeypatch, two, three, window):
    monkeypatch.setattr(d, "TWO_WORDS", two)
    monkeypatch.setattr(d, "THREE_WORDS", three)
    r = random.Random(window)
    say = lambda n, k: " ".join(r.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(str(i), say(r.choice((1, 2, 5, 14, 40, 320)), 8)) for i in range(12)] + [("none", None), ("blank", "")]
    docs = [(i, say(r.choice((3, 50)), 8) + " " + r.choice(items[:12])[1] + " " + say(9, 3)) for i in range(25)] + [(90, None), (91, ""), (91, "")]
    found = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=window).collect()
    expected = []
    for i, text in docs:
        own, hit, which = (text or "").split(), set(), set()
        for item, words in items:
            words = (words or "").split()
            m = min(window, len(words))
            wanted = {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if m else set()
            for at in range(len(own) - m + 1 if m else 0):
                if tuple(own[at : at + m]) in wanted:
                    hit |= set(range(at, at + m))
                    which.add(item)
        expected.append((i, len(own), len(hit), sorted(which)))
    assert sorted((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in found) == sorted(expected)


def test_windows_have_a_limit(spark):
    with pytest.raises(ValueError, match="windows"):
        d.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string"), window=70_000)
