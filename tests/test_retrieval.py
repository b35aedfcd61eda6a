"""Searching articles and symbols: matches before cuts, the inverted index, substrings."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quantloom.operators import news, news_index, portfolio, substring
from quantloom.plans import registry
from quantloom.sources import market as src

ARTICLE = "article_id long, pos long, feed string, title string, description string, published_at string, source struct<name:string>, query string, count string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijk") for _ in range(RNG.randint(2, 5))) for _ in range(250)]
ASOF = "2024-01-31 00:00:00"
QUERIES = [(f"{WORDS[0]} {WORDS[1]}", 5), (f"{WORDS[2]} {WORDS[2]} {WORDS[3]} xyzzy", 8), ("the and of", 4), ("nowhere", 3), (WORDS[4].upper(), 20)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def articles(spark):
    text = lambda r, n: " ".join(r.choice(WORDS[: r.choice((10, 60, 250))]) for _ in range(n))
    rows = []
    for i in range(300):
        r = random.Random(i)
        rows.append((i, 1000 - i, "backup" if i % 3 else "primary", None if i % 41 == 0 else text(r, 6), None if i % 17 == 0 else text(r, r.choice((3, 40, 900))), "2024-01-30T00:00:00Z" if i % 5 == 0 else "unknown", None, "q", "c"))
    return spark.createDataFrame(rows, ARTICLE).repartition(3)


def plain_similarity(query, title, description):
    terms = lambda t: collections.Counter(x for x in re.findall("[a-z0-9_]{2,}", t.lower()) if x not in news.STOP_WORDS)
    q, a = terms(query), terms(" ".join(x for x in (title, description or "") if x is not None))
    kept = sorted(set(q) | set(a), key=lambda t: (-(q[t] + a[t]), t))[: news.MAX_TERMS]
    w = lambda t: 1.0 if q[t] and a[t] else math.log(1.5) + 1
    na, nq = (math.sqrt(sum((c[t] * w(t)) ** 2 for t in kept)) for c in (a, q))
    return (sum(a[t] * q[t] for t in kept) / na / nq if na and nq else 0.0), bool(set(q) & set(a))


def test_similarity_like_plain_python(articles):
    rows = {r.article_id: r for r in articles.collect()}
    found = news.similarity(articles, QUERIES).collect()
    assert len(found) == len(rows) * len(QUERIES)
    for r in found:
        assert r.similarity == pytest.approx(plain_similarity(r.query, rows[r.article_id].title, rows[r.article_id].description)[0], abs=1e-9)
    assert sum(r.similarity > 0 for r in found) > 200


def test_terms_are_counted_without_shuffle_and_texts_are_not_repeated(articles):
    plan = plan_of(news.similarity(articles.select("*"), QUERIES))
    assert plan.count("Exchange") <= 1  # the repartition of the fixture
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    assert "description" not in generate.split("[")[0]


@pytest.mark.parametrize("how", ["scan", "index"])
def test_search_matches_before_it_cuts(spark, articles, tmp_path, how):
    rows = articles.collect()
    if how == "index":
        news_index.write(articles.where("article_id < 200"), f"{tmp_path}/index")
        news_index.write(articles.where("article_id >= 200"), f"{tmp_path}/index", mode="append")
        found = news_index.top_relevant(spark, f"{tmp_path}/index", QUERIES, ASOF)
    else:
        found = news.top_relevant(articles, QUERIES, ASOF)
    found = {(r.query, r.rank): (r.article_id, r.relevance) for r in found.collect()}
    scores = {(r.query, r.article_id): r.relevance for r in news.relevance(articles, QUERIES, ASOF).collect()}
    expected = {}
    for query, count in QUERIES:
        hits = sorted((r.pos, r.article_id) for r in rows if plain_similarity(query, r.title or "", r.description)[1])[: 3 * count]
        best = sorted((i for _, i in hits), key=lambda i: (-round(scores[query, i], 9), i))[:count]
        expected |= {(query, k + 1): i for k, i in enumerate(best)}
    assert {k: v[0] for k, v in found.items()} == expected
    assert all(v[1] == pytest.approx(scores[k[0], v[0]]) for k, v in found.items())
    assert {q for q, _ in found} == {QUERIES[0][0], QUERIES[1][0], QUERIES[4][0]}


def test_index_reads_the_folders_of_its_terms(spark, articles, tmp_path):
    news_index.write(articles, f"{tmp_path}/index")
    df = news_index.postings(spark, f"{tmp_path}/index", [WORDS[0], WORDS[1]])
    every = spark.read.parquet(f"{tmp_path}/index/postings")
    assert len(df.inputFiles()) == len(every.inputFiles())  # before the filter
    plan = plan_of(df)
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    df.collect()
    node = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert node.metrics().get("numFiles").get().value() <= 2
    assert {r.term for r in df.collect()} == {WORDS[0], WORDS[1]}


def test_most_similar_of_all_matches(spark, articles, tmp_path):
    news_index.write(articles, f"{tmp_path}/index")
    queries = [*QUERIES, (" ".join(WORDS[:60]), 7), (WORDS[5], 400)]
    exact = collections.defaultdict(list)
    for r in news.similarity(articles, queries).collect():
        exact[r.query].append((-round(r.similarity, 9), r.article_id))
    matches = news_index.matched(spark, f"{tmp_path}/index", queries).select("query", "article_id", news_index.bound().alias("bound")).collect()
    known = {(q, i): -s for q, v in exact.items() for s, i in v}
    assert all(r.bound >= known[r.query, r.article_id] - 1e-9 for r in matches) and len(matches) > 500
    found = {(r.query, r.rank): (r.article_id, round(r.similarity, 9)) for r in news_index.most_similar(spark, f"{tmp_path}/index", queries).collect()}
    expected = {}
    for q, count in queries:
        best = [x for x in sorted(exact[q]) if x[0] < 0][:count]
        expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert found == expected


def test_registered_queries_score_something(spark, sf_dir):
    """Queries of the registry have terms that occur, so that their rows are not all zeros."""
    found = news.similarity(src.articles(spark, sf_dir), registry.NEWS).groupBy("query").agg(F.avg((F.col("similarity") > 0).cast("int")).alias("share")).collect()
    assert sum(r.share > 0.05 for r in found) >= 3
    top = registry.queries()["news_relevance_topk"](spark, sf_dir).collect()
    assert len({r.query for r in top}) >= 3 and max(r.article_id for r in top) > 100
    merged = registry.queries()["news_merge"](spark, sf_dir).collect()
    assert {r.feed for r in merged} == {"primary", "backup"}


def test_clashing_columns_and_no_articles(spark, articles):
    assert news.asked(articles, QUERIES).select("query", "count").distinct().count() == len(QUERIES)
    assert news.top_relevant(articles.limit(0), QUERIES, ASOF).count() == 0
    assert news.searched(articles, [("", 3)]).count() == 0


def test_substrings_like_plain_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ABC-é.") for _ in range(r.randint(0, 9))) for _ in range(150)] + [None, "", "AAAAAAA"]
    needles = ["".join(r.choice("ABC-é.") for _ in range(r.randint(0, 5))) for _ in range(60)] + [None, "AAAA", "ABCABCABCABC", "A.C"]
    found = substring.holding(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), "text", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    assert sorted((r.id, r.needle) for r in found.collect()) == sorted((i, n) for i, t in enumerate(texts) for n in set(needles) if t and n and n in t)


def test_symbol_search_has_no_cartesian_product(spark):
    symbols = spark.createDataFrame([(s,) for s in ("AAPL", "AMZN", "APA", "PA", "Z")], "symbol string")
    asked = spark.createDataFrame([(s,) for s in (" pa", "a", "zz", "", "apl", "pa")], "query string")
    found = portfolio.symbol_search(symbols, asked, 2)
    assert sorted((r.query, r.rank, r.symbol) for r in found.collect()) == [(" pa", 1, "APA"), (" pa", 2, "PA"), ("a", 1, "AAPL"), ("a", 2, "AMZN"), ("apl", 1, "AAPL"), ("pa", 1, "APA"), ("pa", 2, "PA")]
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert sorted((r.query, r.symbol) for r in portfolio.symbol_resolve(symbols, asked).collect())[:3] == [("", ""), (" pa", "APA"), ("a", "AAPL")]


def test_terms_are_ranked_once_an_article(articles):
    plan = plan_of(news.similarity(articles, QUERIES)).splitlines()
    at = lambda name: next(i for i, x in enumerate(plan) if name in x)
    assert at("Generate") < at("ArrowEvalPython")  # below it, so that rows of pairs need a division only
    assert not any("namedlambdavariable" in x.lower() and "sort_array" in x for x in plan)
    many = [{t: RNG.randint(1, 9) for t in RNG.sample(WORDS, k)} for k in (0, 1, 5, 120, 200)]
    for n in (0, 3, 90, 900):
        text = " ".join(RNG.choice(WORDS) for _ in range(n))
        asked = [" ".join(t for t, k in q.items() for _ in range(k)) for q in many]
        assert news.cosines(text, [news.query_terms(q) for q in asked]) == pytest.approx([plain_similarity(q, text, "")[0] for q in asked], abs=1e-12)


def test_boosts_are_found_once_an_article(articles):
    plan = plan_of(news.relevance(articles, QUERIES, ASOF)).splitlines()
    generate = next(i for i, x in enumerate(plan) if "Generate" in x)
    assert all(i > generate for i, x in enumerate(plan) if "gettimestamp" in x or "unix_timestamp" in x)


def test_a_search_cuts_before_matches_of_a_query_meet(articles):
    for df in (news.searched(articles, QUERIES), news.fetched(articles.withColumn("published_at", F.lit(ASOF)), [("all", 7), ("energy", 3)], ASOF)):
        plan = plan_of(df)
        assert "WindowGroupLimit" in plan and "Partial" in plan
    many = [(f"{WORDS[0]} {WORDS[1]}", 2), (f"{WORDS[0]} {WORDS[1]}", 2), ("the", 9), (WORDS[2], 700)]
    found = news.searched(articles, many).groupBy("query").count().collect()
    rows = articles.collect()
    hits = sum(plain_similarity(WORDS[2], r.title or "", r.description)[1] for r in rows)
    assert {r["query"]: r["count"] for r in found} == {many[0][0]: 6, WORDS[2]: hits}
