"""Substring search as a join on n-grams.

Texts are indexed by their distinct n-grams of three, two and one characters. A needle is looked up by one n-gram of at most three characters that it
holds, the one in the fewest texts, so it meets few texts that do not hold it; ``contains`` then decides. A needle shorter than
three is an n-gram itself. Whatever its length, it is joined by equality, and no pair of a text and a needle without common n-gram is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def grams(text: Column, n: Column) -> Column:
    """The distinct n-grams of a text; none if it is shorter."""
    last = F.length(text) - n + 1
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, n))
    return F.when(last > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def index(texts: DataFrame, text: str) -> DataFrame:
    """_gram and the columns of texts, for each n-gram of each text."""
    every = F.concat(*[grams(F.col(text), F.lit(n)) for n in range(1, LONGEST + 1)])
    return texts.select(F.explode_outer(every).alias("_gram"), "*").where("_gram is not null")


def holding(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Each text with each of the distinct needles that it holds; columns must differ. Empty and null needles and texts give no rows."""
    indexed = index(texts, text)
    sought = needles.where(F.length(needle) > 0).distinct()
    each = sought.select("*", F.explode(grams(F.col(needle), F.least(F.length(needle), F.lit(LONGEST)))).alias("_gram"))
    sizes = indexed.join(each.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_texts"))
    # A needle with an n-gram that no text has is in none.
    rarest = each.join(sizes, "_gram", "left").groupBy(*needles.columns).agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    return indexed.join(rarest, "_gram").where(F.col(text).contains(F.col(needle))).drop("_gram")
