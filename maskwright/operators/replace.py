"""Replacing findings: one fake for each distinct value, spliced in, with a log of changes by line and column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.batches import small_batches
from ..functions.fakes import render, template_of
from ..functions.stable import stable

# The coarse type of a category; other categories are their own type.
TYPES = {
    "email": "pii", "phone": "pii", "person_name": "pii", "username": "pii", "ip_address": "pii", "url": "url", "hostname": "hostname", "file_path": "path", "org": "org",
    "aws_access_key": "secret", "github_token": "secret", "gitlab_token": "secret", "slack_token": "secret", "google_api_key": "secret", "jwt": "secret",
    "oauth_bearer_token": "secret", "ssh_public_key": "secret", "private_key_block": "secret", "db_connection_string": "secret", "azure_connection_string": "secret",
    "generic_password_assignment": "secret", "generic_secret_assignment": "secret", "high_entropy_string": "secret",
}
CHANGE = "struct<type:string,category:string,original:string,replacement:string,start_line:int,start_col:int,end_line:int,end_col:int,confidence:double,detector:string>"


def first_seen(found: DataFrame, order_col: str) -> DataFrame:
    """``category, value, seen``: each distinct pair with the (document, offset) where it comes first. Summed before the shuffle."""
    rows = found.select(F.col(order_col).alias("_order"), F.explode("findings").alias("f"))
    return rows.groupBy("f.category", "f.value").agg(F.min(F.struct(F.col("_order").alias("document"), F.lit(1).alias("phase"), F.col("f.start").alias("start"))).alias("seen"))


def number(pairs: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``category, value, replacement``: pairs numbered in the order they are first seen, one sequence for each template.

    Only distinct pairs are ranked, never findings. A sequence counts the pairs of each sorted range first, then within ranges, so that
    no task ranks a whole sequence. forced: ``category, value, forced``, a fake to use; the number it would have had stays unused.
    """
    pool = template_of(F.col("category"))
    spread = stable(pairs.withColumn("pool", pool).repartitionByRange("pool", "seen", "category", "value").withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("pool", "_part").agg(F.count(F.lit(1)).alias("_n"))  # partitions x pools rows
    before = Window.partitionBy("pool").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("pool", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("pool", "_part").orderBy("seen", "category", "value")
    out = spread.join(sizes, ["pool", "_part"]).withColumn("n", F.col("_ahead") + F.row_number().over(within))
    out = out.select("category", "value", "seen", "n", render(F.col("pool"), F.col("n")).alias("replacement"))
    if forced is not None:
        out = out.join(forced, ["category", "value"], "left").withColumn("replacement", F.coalesce("forced", "replacement")).drop("forced")
    return out


def spliced(text: str, findings: list[dict]) -> tuple[str, list[dict]]:
    """A text with every finding replaced, and its changes. findings: sorted, with a ``replacement``; positions are those in the new text.

    Lines end at line feeds alone; lines and columns count from 1 and the end column is exclusive. One that begins inside the one before is skipped.
    """
    parts, changes, at, line, col = [], [], 0, 1, 1

    def passed(piece: str) -> tuple[int, int]:
        parts.append(piece)
        breaks = piece.count("\n")
        return line + breaks, len(piece) - piece.rfind("\n") if breaks else col + len(piece)

    for f in findings:
        if f["start"] < at:
            continue
        line, col = start = passed(text[at : f["start"]])
        line, col = passed(f["replacement"])
        at = f["end"]
        changes.append({
            "type": TYPES.get(f["category"], f["category"]), "category": f["category"], "original": f["value"], "replacement": f["replacement"],
            "start_line": start[0], "start_col": start[1], "end_line": line, "end_col": col, "confidence": f["confidence"], "detector": f["detector"],
        })
    return "".join(parts) + text[at:], changes


_CHANGES = pa.list_(pa.struct([(name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[kind]) for name, kind in (part.split(":") for part in CHANGE[7:-1].split(","))]))


def _splice(texts: pa.Array, findings: pa.Array) -> pa.Array:
    done = [spliced(t.as_py() or "", f.as_py() or ()) for t, f in zip(texts, findings, strict=True)]
    return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], _CHANGES)], ["sanitized", "changes"])


def replace_findings(found: DataFrame, order_col: str, fakes: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with ``sanitized`` and ``changes`` in place of ``findings``. fakes: ``category, value, replacement``.

    Only findings are shuffled to their fakes, keyed by their document; texts stay where they are until their own findings come back.
    A document without findings is unchanged. ``order_col`` must be unique.
    """
    small_batches(found.sparkSession)
    rows = found.select(F.col(order_col).alias("_order"), F.explode("findings").alias("f"))
    rows = rows.select("_order", "f.*").join(fakes.select("category", "value", "replacement"), ["category", "value"])
    mine = rows.groupBy("_order").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", "value", "confidence", "detector", "replacement"))).alias("_found"))
    joined = found.drop("findings").join(mine, F.col(order_col) == F.col("_order"), "left").drop("_order")
    splice = F.arrow_udf(_splice, f"struct<sanitized:string,changes:array<{CHANGE}>>")  # linear in a text and its findings
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = joined.withColumn("_made", splice(F.when(F.col("_found").isNotNull(), text), F.col("_found")))  # a text without findings does not travel
    sanitized = F.when(F.col("_found").isNull(), text).otherwise(F.col("_made")["sanitized"])
    return some.withColumns({"sanitized": sanitized, "changes": F.col("_made")["changes"]}).drop("_made", "_found")


def change_log(sanitized: DataFrame, order_col: str, *keys: str) -> DataFrame:
    """A row for each change with its ``chg_`` id, numbered through all documents in order.

    Numbers are sums over the documents before: ranges of documents are counted first, then documents within a range.
    """
    rows = stable(sanitized.filter(F.size("changes") > 0).select(order_col, *keys, "changes").repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = rows.groupBy("_part").agg(F.sum(F.size("changes")).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "_part").withColumn("_ahead", F.col("_ahead") + F.coalesce(F.sum(F.size("changes")).over(within), F.lit(0)))
    rows = rows.select(order_col, *keys, "_ahead", F.posexplode("changes").alias("_i", "c"))
    n = (F.col("_ahead") + F.col("_i") + 1).cast("long")
    return rows.select(F.concat(F.lit("chg_"), F.when(n < 1_000_000, F.lpad(n.cast("string"), 6, "0")).otherwise(n.cast("string"))).alias("id"), order_col, *keys, "c.*")
