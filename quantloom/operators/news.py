"""News: routing, filters, relevance, merging of feeds.

Queries are a user's few: pairs of (query, count), at most ``MAX_QUERIES``. They are literals of the plan, so that no join brings them
to the articles. A search finds the articles that have any of a query's terms, and its first ones are scored. These functions read all articles
once; news_index keeps postings for searches that come again. Terms of a text are counted by a small Python function over Arrow arrays, once
an article for all queries.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import text as fn

# Category keywords and boosts.
KEYWORDS = {
    "healthcare": ["healthcare", "pharma", "biotech", "medical", "drug", "hospital"],
    "energy": ["energy", "oil", "gas", "renewable", "solar", "wind"],
    "banking": ["bank", "banking", "financial", "fed", "interest"],
    "mergers": ["merger", "acquisition", "deal", "takeover", "buyout"],
    "food": ["food", "beverage", "restaurant", "consumer"],
}
IMPORTANT = ["earnings", "billion", "merger", "breakthrough", "deal"]
GENERAL = ["all", "financial markets economy stocks"]
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has "
    "have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than "
    "that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your"
).split()
TERM = "[a-z0-9_]{2,}"
TERMS = "array<struct<term:string,n:bigint>>"
MAX_TERMS = 100
MAX_QUERIES = 1000
Queries = list[tuple[str, int]]


def route(query: Column) -> Column:
    """Category of a query; first match wins, else 'symbol:' and the first word without ' STOCK'."""
    q = F.lower(query)
    has = lambda s: F.contains(q, F.lit(s))
    symbol = F.element_at(F.split(F.trim(F.replace(F.upper(query), F.lit(" STOCK"), F.lit(""))), r"\s+"), 1)
    return (
        F.when(has("technology stocks"), "technology").when(has("healthcare"), "healthcare").when(has("energy"), "energy").when(has("banking") | has("finance stocks"), "banking")
        .when(has("mergers"), "mergers").when(has("food"), "food").when(has("financial markets") | (q == "all"), "general").otherwise(F.concat(F.lit("symbol:"), symbol))
    )


def keywords(category: Column) -> Column:
    """Words of which one must occur: those of a category, the symbol itself for a symbol's news; null if nothing is filtered."""
    out = F.when(F.startswith(category, F.lit("symbol:")), F.array(F.lower(F.substr(category, F.lit(8)))))
    for name, words in KEYWORDS.items():
        out = out.when(category == name, F.array(*map(F.lit, words)))
    return out


def query_terms(query: str) -> dict[str, int]:
    found = Counter(t for t in re.findall(TERM, query.lower(), re.ASCII) if t not in STOP_WORDS)
    return dict(sorted(found.items()))


def asked(rows: DataFrame, queries: Queries, where: Callable[[Column], Column] | None = None, **more: Column) -> DataFrame:
    """Each row for each query that ``where`` (of a query's fields) holds for: query, count, keywords (by its route) and tq (its terms and how often it has them).

    More columns are taken from arrays with a value for each query, in their order.
    Queries are filtered within the row, so that it is repeated for those that want it only. Columns of rows with these names go.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at once")
    terms = lambda q: F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).cast("long").alias("n")) for t, n in query_terms(q).items()]).cast(TERMS)
    one = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(n).alias("count"), keywords(route(F.lit(q))).alias("keywords"), terms(q).alias("tq")) for q, n in queries])
    put = lambda name, values: lambda q, i: q.withField(name, F.get(values, i))
    for name, values in more.items():
        one = F.transform(one, put(name, values))
    kept = [c for c in rows.columns if c.lower() not in ("query", "count", "keywords", "tq", *more)]
    # Explode itself would infer a filter from its array and compute this, with all it is made of, a second time.
    return rows.withColumn("_q", F.explode_outer(one if where is None else F.filter(one, where))).where("_q is not null").select(*kept, "_q.*")


def recent(articles: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """Articles of the last days; undated ones pass."""
    at = fn.published(F.col("published_at"))
    return articles.where(at.isNull() | (at >= F.to_timestamp(F.lit(asof)) - F.make_dt_interval(days=F.lit(days))))


def matches(title: Column, description: Column, words: Column) -> Column:
    """Whether any word is part of the title or description; no list passes."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return words.isNull() | F.exists(words, lambda k: F.contains(low(title), k) | F.contains(low(description), k))


def card(articles: DataFrame, asof: str) -> DataFrame:
    """Articles with defaults for what is missing."""
    feed = F.when(F.col("feed") == "primary", "Primary Feed").otherwise("Backup Feed")
    return articles.select("article_id", F.coalesce("title", F.lit("No title")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.col("source.name"), F.lit("Unknown")).alias("source_name"), feed.alias("feed_name"), F.coalesce("published_at", F.lit(asof)).alias("published_at"))


def fetched(articles: DataFrame, queries: Queries, asof: str) -> DataFrame:
    """query, count and its primary articles: routed, recent, filtered, the first ``count`` by position."""
    rows = asked(recent(articles.where("feed = 'primary'"), asof), queries, lambda q: matches(F.col("title"), F.col("description"), q["keywords"]))
    return first_rows(rows, queries)


def first_rows(rows: DataFrame, queries: Queries, times: int = 1) -> DataFrame:
    """The first times * count rows of each query by position. The largest count is a literal, so that tasks cut to it before a query's rows come together."""
    order = Window.partitionBy("query").orderBy("pos")
    most = times * max((n for _, n in queries), default=0)
    return rows.withColumn("_k", F.row_number().over(order)).where((F.col("_k") <= most) & (F.col("_k") <= times * F.col("count"))).drop("_k")


def _text() -> Column:
    return F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))


def term_counts(text: str) -> dict[str, int]:
    """Terms of a text in lower case and how often it has them: runs of at least two ASCII letters, digits or underscores, but for stop words."""
    return {t: n for t, n in Counter(_terms(text)).items() if t not in _stop}


_terms, _stop = re.compile(TERM).findall, frozenset(STOP_WORDS)


def _term_lists(lists: list[list[tuple[str, int]]]) -> pa.Array:
    flat = [x for one in lists for x in one]
    values = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int64())], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), values)


def counted(articles: DataFrame, wanted: frozenset[str] = frozenset()) -> DataFrame:
    """terms: all terms of each article by name, and how often it has them; ta: the MAX_TERMS with the largest counts, ties by name, and the wanted ones. Without a shuffle."""

    def run(texts: pa.Array) -> pa.Array:
        terms = [sorted(term_counts(t).items()) for t in texts.to_pylist()]
        ranked = (sorted(one, key=lambda x: -x[1]) for one in terms)
        top = [one[:MAX_TERMS] + [x for x in one[MAX_TERMS:] if x[0] in wanted] for one in ranked]
        return pa.StructArray.from_arrays([_term_lists(terms), _term_lists(top)], ["terms", "ta"])

    rows = articles.withColumn("_t", F.arrow_udf(run, f"struct<terms:{TERMS},ta:{TERMS}>")(_text()))
    return rows.withColumns({"terms": F.col("_t.terms"), "ta": F.col("_t.ta")}).drop("_t")


def with_terms(articles: DataFrame, queries: Queries) -> DataFrame:
    """ta: of each article its most frequent terms and those of the queries. They are counted apart from the queries, so the number of these does not multiply them."""
    return counted(articles, frozenset(t for q, _ in queries for t in query_terms(q))).drop("terms")


def cosines(text: str, queries: list[dict[str, int]]) -> list[float]:
    """What cosine() says of a text and the terms of each query, from one ranking of the text's terms."""
    n = term_counts(text)
    ranked = sorted((-k, t) for t, k in n.items())
    squares = [0, *accumulate(k * k for k, _ in ranked)]
    weight = (math.log(1.5) + 1) ** 2
    out = []
    for query in queries:
        shared = sorted((-n[t], t) for t in query if t in n)
        dot = own = other = na = kept = 0
        # A query's term takes part if fewer than MAX_TERMS come before it; those that do are its first ones.
        for k, t in sorted((-(n.get(t, 0) + q), t) for t, q in query.items()):
            if bisect_left(ranked, (k, t)) - bisect_left(shared, (k, t)) + kept >= MAX_TERMS:
                break
            kept, a, q = kept + 1, n.get(t, 0), query[t]
            dot, na = dot + a * q, na + a * a
            own, other = (own + q * q, other) if a else (own, other + q * q)
        # The rest are the article's first terms that the query has not.
        end = MAX_TERMS - kept
        places = [bisect_left(ranked, x) for x in shared]
        for at in places:
            end += at < end
        rest = squares[min(end, len(ranked))] - sum(ranked[at][0] ** 2 for at in places if at < end)
        na, nq = na + weight * rest, own + weight * other
        out.append(dot / (math.sqrt(na) * math.sqrt(nq)) if na > 0 and nq > 0 else 0.0)
    return out


def with_similarities(articles: DataFrame, queries: Queries) -> DataFrame:
    """similarities: of each article with each query, in their order."""
    terms = [query_terms(q) for q, _ in queries]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cosines(t, terms) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return articles.withColumn("similarities", F.arrow_udf(run, "array<double>")(_text()))


def cosine(ta: Column, tq: Column) -> Column:
    """TF-IDF cosine of an article's and a query's terms, fitted on the two texts alone.

    With two texts a term of both has weight 1 and any other ln(1.5) + 1. Of each pair the MAX_TERMS terms with the
    largest counts take part, ties by term.
    """
    n_in = lambda terms, t: F.aggregate(terms, F.lit(0).cast("long"), lambda n, x: n + F.when(x["term"] == t, x["n"]).otherwise(0))
    entry = lambda t, a, q: F.struct((-(a + q)).alias("rank"), t.alias("term"), a.alias("a"), q.alias("q"))
    of_article = F.transform(ta, lambda x: entry(x["term"], x["n"], n_in(tq, x["term"])))
    of_query = F.transform(F.filter(tq, lambda x: n_in(ta, x["term"]) == 0), lambda x: entry(x["term"], F.lit(0).cast("long"), x["n"]))
    kept = F.slice(F.sort_array(F.concat(of_article, of_query)), 1, MAX_TERMS)
    weight = lambda x: F.when((x["a"] > 0) & (x["q"] > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    total = lambda f: F.aggregate(kept, F.lit(0.0), lambda s, x: s + f(x))
    dot, na, nq = total(lambda x: (x["a"] * x["q"]).cast("double")), total(lambda x: (x["a"] * weight(x)) ** 2), total(lambda x: (x["q"] * weight(x)) ** 2)
    return F.when((na > 0) & (nq > 0), dot / (F.sqrt(na) * F.sqrt(nq))).otherwise(0.0)


def similarity(articles: DataFrame, queries: Queries) -> DataFrame:
    """query, article_id, similarity of each pair."""
    return asked(with_similarities(articles, queries).select("article_id", "similarities"), queries, similarity=F.col("similarities")).select("query", "article_id", "similarity")


def with_boosts(articles: DataFrame, asof: str) -> DataFrame:
    """_title, _known and _recent: what relevance takes of an article itself, so that it is found once and not for each query."""
    known = F.filter(F.array(*map(F.lit, IMPORTANT)), lambda w: F.contains("_title", w))
    age = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(asof))) - F.unix_timestamp(fn.published(F.col("published_at")))) / 86400)
    recent = F.coalesce(F.when(age <= 1, 0.3).when(age <= 3, 0.2), F.lit(0.0))
    return articles.withColumn("_title", F.lower("title")).withColumns({"_known": F.size(known), "_recent": recent})


def scored(rows: DataFrame) -> DataFrame:
    """rows of asked() with boosts and similarity: relevance adds boosts for query words and important words in the title, and for recency.

    An article without title has relevance 0.5.
    """
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: (F.length(w) > 3) & F.contains("_title", w))
    relevance = F.when(F.col("title").isNull(), 0.5).otherwise(F.col("similarity") + 0.2 * F.size(words) + 0.1 * F.col("_known") + F.col("_recent"))
    return rows.withColumn("relevance", relevance).drop("_title", "_known", "_recent")


def relevance(articles: DataFrame, queries: Queries, asof: str) -> DataFrame:
    """query, article_id, similarity, relevance of each pair, with the article's columns but for its text."""
    rows = with_boosts(with_similarities(articles, queries).drop("description"), asof)
    return scored(asked(rows, queries, similarity=F.col("similarities")).drop("similarities", "tq"))


def with_hits(articles: DataFrame, queries: Queries) -> DataFrame:
    """hits: the queries that share a term with an article."""
    holders: dict[str, list[str]] = {}
    for query in dict.fromkeys(q for q, _ in queries):
        for term in query_terms(query):
            holders.setdefault(term, []).append(query)

    def run(texts: pa.Array) -> pa.Array:
        found = (holders.keys() & set(_terms(t)) for t in texts.to_pylist())
        return pa.array([sorted({q for t in terms for q in holders[t]}) for terms in found], pa.list_(pa.string()))

    return articles.withColumn("hits", F.arrow_udf(run, "array<string>")(_text()))


def searched(articles: DataFrame, queries: Queries) -> DataFrame:
    """Each query with its first 3 * count articles, by position, of those that have any of its terms; none for a query without terms.

    Terms are counted of these few only.
    """
    found = asked(with_hits(articles, queries), queries, lambda q: F.array_contains("hits", q["query"])).drop("hits")
    return with_terms(first_rows(found, queries, 3), queries).drop("description")


def best(rows: DataFrame, asof: str) -> DataFrame:
    """Of the rows of a search the ``count`` most relevant of each query; ties by id."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("relevance", 9)), "article_id")
    rows = with_boosts(rows, asof).withColumn("similarity", cosine(F.col("ta"), F.col("tq"))).drop("ta", "tq")
    return scored(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("count"))


def top_relevant(articles: DataFrame, queries: Queries, asof: str) -> DataFrame:
    """What a search finds for each query, the most relevant first."""
    return best(searched(articles, queries), asof)


def merged(articles: DataFrame, queries: Queries, asof: str, enough: int = 5) -> DataFrame:
    """query, rank, article_id, feed: primary articles, and where they are few the backup feed's best after them, without repeated titles."""
    query = Window.partitionBy("query")
    primary = fetched(articles, queries, asof).select("query", "count", "article_id", "title", "pos", F.lit("primary").alias("feed"), F.lit(0).alias("r"))
    backup = top_relevant(articles.where("feed = 'backup'"), queries, asof).select("query", "count", "article_id", "title", F.col("rank").cast("long").alias("pos"), F.lit("backup").alias("feed"), F.lit(1).alias("r"))
    both = primary.unionByName(backup).withColumn("few", (F.count_if(F.col("r") == 0).over(query) < enough) & ~F.lower("query").isin(GENERAL)).where("r = 0 or few")
    same = Window.partitionBy("query", F.when(F.col("few"), F.lower("title")).otherwise(F.col("article_id").cast("string"))).orderBy("r", "pos")
    once = both.withColumn("_k", F.row_number().over(same)).where("_k = 1")
    return once.withColumn("rank", F.row_number().over(query.orderBy("r", "pos"))).where(F.col("rank") <= F.col("count")).select("query", "rank", "article_id", "feed")
