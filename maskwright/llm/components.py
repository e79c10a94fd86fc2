"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame, keep: Scratch, name: str = "cc") -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``u, v``); the root is the smallest node reachable.

    Each round points neighbours at the smallest node around them, first from every node to its larger neighbours, then
    from every node to its smaller ones; edges never outnumber those given, and the rounds needed grow as the logarithm
    of a component. Minima are summed before the shuffle; they are written before the join, so that the rows of a hub
    can be split by the engine. Nothing goes to the driver but the count and checksum that tell when to stop.
    """

    def pointed(rows: DataFrame, step: str) -> DataFrame:
        least = keep.write(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-min-{step}")
        return rows.join(least.hint("merge"), "u")

    def stored(rows: DataFrame, step: str) -> tuple[DataFrame, tuple]:
        out = keep.write(rows.filter("u <> v").distinct(), f"{name}-{step}")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, seen = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "0")
    step = 0
    while seen[0]:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = stored(pointed(both, f"{step}l").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), f"{step}l")
        star = pointed(large, f"{step}s")
        last = seen
        now, seen = stored(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))), f"{step}s")
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
