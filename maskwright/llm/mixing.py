"""Mixing sources to target weights: water-filled targets, then subset-sum fitting of each source's rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

#: Seeded rank buckets inside one (source, length), so that no window holds a hot group whole.
_BUCKETS = 256


def fit_lengths(lengths, counts, budget: int, window: int = 1 << 16) -> list[int]:
    """How many documents of each length to take for a sum at or just under ``budget``.

    First the same share of each length, rounded down; then, in order of what rounding lost, one more of each while
    more than ``window`` tokens are missing; the rest, at most ``window`` tokens, is a bounded knapsack over
    the documents left, solved by dynamic programming over the reachable sums. Its state is ``window`` cells, whatever
    the corpus. Lengths of 0 are never taken.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    held = int((lengths * counts).sum())
    budget = min(int(budget), held)
    if budget <= 0:
        return [0] * len(lengths)
    take = [c * budget // held if n else 0 for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)]  # exact integers
    lost = [c * budget % held for c in counts.tolist()]
    short = budget - sum(n * t for n, t in zip(lengths.tolist(), take, strict=True))
    for i in sorted(range(len(take)), key=lambda i: (-lost[i], -int(lengths[i]))):
        if short <= window:
            break
        if 0 < lengths[i] <= short and take[i] < counts[i]:
            take[i] += 1
            short -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():  # where one more of each was not enough
        if short <= window:
            break
        if lengths[i]:
            more = min(int(counts[i]) - take[i], (short - window + int(lengths[i]) - 1) // int(lengths[i]), short // int(lengths[i]))
            take[i] += more
            short -= more * int(lengths[i])
    reach = np.zeros(short + 1, bool)
    reach[0] = True
    by = np.full(short + 1, -1, np.int64)  # the step that first reached a sum
    steps: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        left, n, power = int(counts[i]) - take[i], int(lengths[i]), 1
        while n and left and not reach[short]:
            some = min(power, left)  # 1, 2, 4, ... copies make any number up to what is left
            left, power, jump = left - some, power * 2, some * n
            if jump > short:
                break
            new = reach[:-jump] & ~reach[jump:]
            by[jump:][new] = len(steps)
            reach[jump:] |= new
            steps.append((i, some))
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, some = steps[by[at]]
        take[i] += some
        at -= some * int(lengths[i])
    return take


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size`` with each source's ``target``: the share of all sizes by weight, filled like water under the caps."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("_full", F.col("source").asc_nulls_last())
    table = (
        sources.withColumn("_w", weight)
        .withColumns({"_cap": F.col("source_size") * F.lit(float(most)), "_all": F.sum("source_size").over(Window.partitionBy())})
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumns({
            "_capped": F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.col("_capped")) / F.col("_open"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(Window.partitionBy())["_level"]
    return table.withColumn("_at", level).select("source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("_w")), F.col("_cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, repeats, taken`` after the ``carry`` columns.

    ``size`` counts maximal runs of what is not ASCII white space (null: 0). Sources in code point order, null as one
    source at the end, weigh ``weights`` in turn and share ``share`` of all sizes; no target exceeds ``most`` times its source.
    A source repeats all documents as often as its target holds it whole and fits the rest by ``fit_lengths``;
    which documents of a length are taken follows a seeded hash of the id, so reruns agree. Empty documents take
    nothing. Repeated rows count as rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "mix")
    sized = keep.write(
        docs.select(
            *carry,
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("_draw"),
        ).withColumns({"_bucket": F.pmod("_draw", F.lit(_BUCKETS)).cast("int"), "_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}),
        "sized",
    )
    cells = keep.write(sized.groupBy("_key", "source", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "cells")
    wanted = keep.write(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, share, most).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "wanted")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        held, target = int(group["source_size"][0]), float(group["target"][0])
        full = int(target // held) if held else 0
        return group.assign(_full=full, _take=fit_lengths(group["size"], group["_n"], round(target - full * held)))

    lengths = cells.groupBy("_key", "size").agg(F.sum("_n").alias("_n")).join(wanted, "_key")
    plan = lengths.groupBy("_key").applyInPandas(fit, "_key string, size long, _n long, source_size long, target double, _full long, _take long").drop("_n")
    ahead = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select("_key", "size", "_bucket", "_ahead")
    decided = keep.write(cells.join(plan.hint("merge"), ["_key", "size"]), "decided")
    drawn = Window.partitionBy("_key", "size", "_bucket").orderBy("_draw", "doc_id")
    repeats = F.when(F.col("size") > 0, F.col("_full") + (F.col("_ahead") + F.row_number().over(drawn) <= F.col("_take")).cast("long")).otherwise(F.lit(0))
    return (
        sized.join(decided.hint("merge"), ["_key", "size", "_bucket"])
        .withColumn("repeats", repeats.cast("long"))
        .select(*carry, "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))
    )
