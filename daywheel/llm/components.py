"""Distributed connected components by alternating large-star and small-star steps, with DataFrame functions only.

Every round shrinks the edge set towards stars around the smallest node of each component; minima are combined before
each shuffle, a hub's edges are dealt to tasks of HUB edges each, and each round is written to the shared folder. Only a
count, a checksum and the largest degree come to the driver each round; hubs are broadcast after their rows were
counted (edges / HUB at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fewer, release, small_side

#: Edges of a node that one task takes.
HUB = 20_000


def _with_least(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """edges (u, v) with m from least (u, m, d: u's edges). If some nodes are hubs, theirs are dealt to many tasks."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    parts = least.where(F.col("d") > HUB).select("u", F.ceil(F.col("d") / HUB).cast("int").alias("parts"))
    side, small = small_side(parts, 32)
    if not small:
        return edges.join(least.select("u", "m"), "u")
    deal = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).otherwise(0)
    rows = edges.join(side, "u", "left").withColumn("deal", deal).drop("parts")
    ends = least.join(side, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("deal"))
    return rows.join(ends, ["u", "deal"]).drop("deal")


def _step(edges: DataFrame, small: bool, n: int) -> tuple[DataFrame, tuple]:
    """(edges after a large-star or a small-star step over edges (u, v), the state before it: edges, checksum)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    least = cut(fewer(least.withColumn("m", F.least("u", "m")), n))
    state = least.agg(F.coalesce(F.sum("d"), F.lit(0)), F.sum("h"), F.coalesce(F.max("d"), F.lit(0))).first()
    rows = _with_least(edges, least, state[2] > HUB)
    if small:
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        rows = rows.select(F.explode(pair).alias("e")).select("e.u", "e.v")
    else:
        rows = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return fewer(rows.where("u != v").distinct(), n), tuple(state[:2])


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of an edge between two different nodes; label is the smallest node of its component.

    Null ends and loops are dropped, repeated edges count once; no edges: an empty result. Nodes may be of any ordered type.
    """
    high, low = F.greatest(F.col(src), F.col(dst)), F.least(F.col(src), F.col(dst))
    rows = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    rows = cut(rows.select(high.alias("u"), low.alias("v")).distinct())
    n = 2 * rows.count()
    rows, seen = cut(fewer(rows, n)), None
    while n:
        both = rows.union(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, state = _step(both, False, n)
        if state == seen:
            break
        seen = state
        rows = cut(_step(large, True, n)[0])
    release(edges.sparkSession)
    ends = rows.select(F.col("u").alias("node"), F.col("v").alias("label")).union(rows.select(F.col("v"), F.col("v")))
    return fewer(ends.groupBy("node").agg(F.min("label").alias("label")), n)
