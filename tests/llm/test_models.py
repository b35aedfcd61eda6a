"""The language models against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import lm_scoring, ngrams, quality

R = random.Random(9)
WORDS = ["".join(R.choice("abcdeé字") for _ in range(R.randint(1, 5))) for _ in range(60)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ROWS = [(i, text(R.randint(1, 60), i)) for i in range(40)] + [(7, text(20, 99)), (3, None), (50, ""), (None, text(9, 98)), (51, "x"), (52, "a\0b😀"), (52, "a\0b😀")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def positions(t, order):
    """The n-gram that ends at each symbol, a border before the first."""
    units = [x if x else 0xFFFF for x in memoryview((t or "").encode("utf-16-le")).cast("H")]
    padded = [0] * (order - 1) + units
    return [tuple(padded[i : i + order]) for i in range(len(units))]


def test_cross_entropy_difference_like_plain_python(spark, docs):
    order, strength = 4, 5.0
    target = {1, 2, 3, 4, 5, 7, 50, 52}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    folds = {(r.doc_id, r.text): r.f for r in docs.select("doc_id", "text", lm_scoring.fold("doc_id", "text").alias("f")).collect()}
    grams = {0: {"t": Counter(), "b": Counter()}, 1: {"t": Counter(), "b": Counter()}}
    for i, t in ROWS:
        for g in positions(t, order):
            grams[folds[i, t]]["b"][g] += 1
            grams[folds[i, t]]["t"][g] += i in target
    n_symbols = len({g[-1] for f in grams.values() for g in f["b"]})

    def model(seen, scale):
        tables = []
        for k in range(1, order + 1):
            own, ctx = Counter(), Counter()
            for g, n in seen.items():
                own[g[-k:]] += n * scale
                ctx[g[-k:-1]] += n * scale
            tables.append((own, ctx))

        def p(g):
            out = 1.0 / n_symbols
            for k, (own, ctx) in enumerate(tables, 1):
                out = (own[g[-k:]] + strength * out) / (ctx[g[-k:-1]] + strength)
            return out

        return p

    models = {}
    for f in (0, 1):
        other = grams[1 - f]
        models[f] = model(other["t"], 1.0), model(other["b"], sum(other["t"].values()) / sum(other["b"].values()))
    got = Counter((r.doc_id, r.n_tokens, r.target_loss and round(r.target_loss, 9), r.background_loss and round(r.background_loss, 9), r.score and round(r.score, 9)) for r in lm_scoring.cross_entropy_difference(docs, ids).collect())
    expected = Counter()
    for i, t in ROWS:
        own = positions(t, order)
        losses = [-sum(math.log(m(g)) for g in own) / len(own) if own else None for m in models[folds[i, t]]]
        expected[i, len(own), *(x and round(x, 9) for x in losses), round(losses[0] - losses[1], 9) if own else None] += 1
    assert got == expected


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_like_plain_python(spark, docs, order):
    chosen = set(range(25))
    counts = ngrams.count_grams(docs.select("text", F.coalesce(F.col("doc_id") < 25, F.lit(False)).cast("int").alias("part")), order, 2)
    got = {r.gram: r.loss for r in quality.kneser_ney(counts, order, ngrams.n_symbols(counts)).collect()}
    own, every = Counter(), set()
    for i, t in ROWS:
        for g in positions(t, order):
            every.add(g)
            own[g] += i in chosen
    tables = [Counter({g: n for g, n in own.items() if n})]
    for k in range(order - 1, 0, -1):
        tables.insert(0, Counter(g[-k:] for g in tables[0]))
    p = dict.fromkeys(every, 1.0 / len({g[-1] for g in every}))
    for k, table in enumerate(tables, 1):
        m = Counter(table.values())
        y = m[1] / max(1, m[1] + 2 * m[2])
        d = [min(max(x, 0.1), j - 0.1) for j, x in enumerate((1 - 2 * y * m[2] / max(1, m[1]), 2 - 3 * y * m[3] / max(1, m[2]), 3 - 4 * y * m[4] / max(1, m[3])), 1)]
        total, freed = Counter(), defaultdict(float)
        for g, n in table.items():
            total[g[:-1]] += n
            freed[g[:-1]] += d[min(n, 3) - 1]
        for g in every:
            s = g[-k:]
            if total[s[:-1]]:
                seen = table[s] - d[min(table[s], 3) - 1] if table[s] else 0.0
                p[g] = (seen + freed[s[:-1]] * p[g]) / total[s[:-1]]
    key = lambda g: (lambda x: x - (1 << 64) if x >> 63 else x)(sum(v << 16 * (order - 1 - j) for j, v in enumerate(g)))
    assert {k: round(v, 9) for k, v in got.items()} == {key(g): round(-math.log(v), 9) for g, v in p.items()}
    if order == 2:  # all that can follow a symbol add up to one
        assert sum(math.exp(-v) for g, v in ((g, -math.log(x)) for g, x in p.items()) if g[0] == ord("a")) <= 1 + 1e-9


def test_too_long_ngrams_are_refused():
    with pytest.raises(ValueError):
        ngrams.grams("text", 5)
