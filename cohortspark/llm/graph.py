"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b", owner: str = "") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that links reach.

    Large-star and small-star steps take turns until nothing changes (Kiveris et al. 2014). A step is one
    minimum per node and one join, so no neighbourhood is ever collected; a hub is a hot join key that Spark
    splits. Each round is a written table. Self links and nulls are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = scratch.written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", owner)
    last = None
    for _ in range(MAX_ROUNDS):
        step = scratch.written(_small(_large(e)), "stars", owner)
        now = step.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("y")).first()
        scratch.forget(e)
        e = step
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large(e: DataFrame) -> DataFrame:
    """For each node, its larger neighbours point to the smallest of its neighbours and itself."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself point to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()
