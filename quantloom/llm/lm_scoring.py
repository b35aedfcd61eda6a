"""Cross-entropy difference: how much more a text is like a target corpus than like all text.

Both models are character 4-gram models over one vocabulary and one set of n-grams, that of the whole
corpus. Each order's probability is the count with ``strength`` pseudo-counts of the next lower order; the
lowest order starts from a uniform distribution. The models are matched in size: background counts, which are of all
documents, are scaled to the number of symbols of the target, as a sample of that size would have on average. No document is
scored by a model that has seen it: a hash of id and text deals documents into two folds, and each fold is scored by the
models of the other. The score of a document is its mean loss under the target
model less that under the background model, in nats a symbol: the lower, the more like the target.

Null and empty texts have 0 tokens and null losses and scores. Without target documents the target model is
uniform. Repeated rows each get a row and are in one fold; rows without id are scored too. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, table
from quantloom.llm.ngrams import context, count_grams, flagged, n_symbols, score_docs, suffix


def fold(doc_id: str, text: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(2)).cast("int")


def loss_table(counts: DataFrame, order: int, strength: float) -> DataFrame:
    """gram, and for the documents of each fold f: target_f and background_f, losses by the counts of the other fold.

    counts: gram, and n0 to n3, in all but target and in target documents of fold 0, then of fold 1.
    """
    total = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(4)]).first()
    first = 1.0 / n_symbols(counts)
    out = counts.select("gram", *[F.lit(first).alias(f"p{m}{f}") for m in "tb" for f in (0, 1)])
    scale = {f: total[f"n{2 * g + 1}"] / max(1, total[f"n{2 * g}"] + total[f"n{2 * g + 1}"]) or 1.0 for f, g in ((0, 1), (1, 0))}
    seen = counts.select("gram", *[c for f, g in ((0, 1), (1, 0)) for c in (F.col(f"n{2 * g + 1}").alias(f"t{f}"), ((F.col(f"n{2 * g}") + F.col(f"n{2 * g + 1}")) * scale[f]).alias(f"b{f}"))])
    names = ["t0", "t1", "b0", "b1"]
    for k in range(1, order + 1):
        own = seen.groupBy(suffix(F.col("gram"), k).alias("k")).agg(*[F.sum(x).alias(x) for x in names])
        ctx = own.groupBy(context(F.col("k")).alias("c")).agg(*[F.sum(x).alias(f"c{x}") for x in names])
        joined = out.join(own, suffix(F.col("gram"), k) == F.col("k")).join(ctx, context(F.col("k")) == F.col("c"))
        out = joined.select("gram", *[((F.col(x) + strength * F.col(f"p{x}")) / (F.col(f"c{x}") + strength)).alias(f"p{x}") for x in names])
    return out.select("gram", *[(-F.log(f"p{m[0]}{f}")).alias(f"{m}_{f}") for m in ("target", "background") for f in (0, 1)])


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 4, strength: float = 5.0) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss (nats a symbol), score of each row of docs."""
    both = flagged(docs, doc_id, text, target_ids).withColumn("fold", fold("doc_id", "text"))
    counts = materialize(count_grams(both.withColumn("part", 2 * F.col("fold") + F.col("chosen").cast("int")), order, 4), "grams")
    losses = materialize(loss_table(counts, order, strength), "losses")
    values = [f"{m}_{f}" for m in ("target", "background") for f in (0, 1)]
    found = score_docs(both.select(F.struct("doc_id", "fold").alias("row"), "text"), order, losses, values).select("row.*", "n_tokens", *values)
    mean = lambda m: F.try_divide(F.when(F.col("fold") == 0, F.col(f"{m}_0")).otherwise(F.col(f"{m}_1")), F.col("n_tokens")).alias(f"{m}_loss")
    return found.select("doc_id", "n_tokens", mean("target"), mean("background")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)
