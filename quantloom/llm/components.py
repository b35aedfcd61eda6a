"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges: two long columns. id, component (smallest id reachable) of each id that has an edge to another.

    After ``rounds`` rounds, if given, component is the smallest id found so far, which may be of a part of the
    component only. Each round links every id to the smallest in reach of its neighbours; the number of rounds grows with
    the logarithm of the longest path. Each round's edges are written to the shared folder. Null ids and
    edges from an id to itself are ignored.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    stars = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a != b).alias("real")).where("real and u is not null and v is not null").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        stars = materialize(small, "edges")
        if rounds is not None and (rounds := rounds - 1) <= 0:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        now = stars.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == seen:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = tuple(now)
