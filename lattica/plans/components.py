"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import cut, drop


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of distinct edges apart: their number and two digests of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of `edges` (its first two columns) with the smallest node it reaches.

    Nulls are dropped; self-loops only register their node. Each round is one aggregation and one
    join per star, written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. Hubs are safe: a node's minimum is a partial aggregate, and the join back may be split.
    """
    a, b = edges.columns[:2]
    base = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    base = cut(base, "edges")
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(base.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now, before = now, cut(small, "star"), state
        drop(last)
        state = _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    low = now.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(low, nodes["node"] == low["u"], "left").select("node", F.coalesce("m", "node").alias("component"))
