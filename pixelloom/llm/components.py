"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two equi-joins, so
a hub that holds a third of all edges is pre-aggregated before it is
shuffled and its join partition can be split by adaptive execution. The
number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import forget, written


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any direction -> (id, component), one row for each vertex but the least of its component.

    Vertices without a row are their own component or the least of theirs;
    self-links and null ends are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    e = written(e.where("ok and a <> b").select("a", "b").distinct())
    seen = _fingerprint(e)
    while seen[0]:
        before, e = e, written(_small_star(_large_star(e)))
        forget(before)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
