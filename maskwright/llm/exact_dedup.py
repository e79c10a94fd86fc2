"""Exact de-duplication by distributed MSD radix partitioning.

Groups start as all rows of one byte length and are split by successive bytes of the text, most significant first,
until a group holds one row or its texts have ended. Keys are the raw bytes themselves, so equality needs no digest.
Digits widen geometrically, so a text of n bytes takes O(log n) passes, and rows that are alone leave after the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: White space runs that are not already a single space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_END = 2147483647


def normal_text(column) -> F.Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), _RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 64, growth: int = 16, max_width: int = 1 << 20) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are; null and empty texts are equal. Of a group the row with the
    smallest id stays; of rows that repeat that id, one. Null ids come after all others. An empty table gives no rows;
    other columns are ignored. ``first_width`` is the width of the first digit in bytes; each next one is ``growth``
    times as wide, up to ``max_width``, which bounds the size of a key.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "exact")
    base = docs.select(F.col(id_col).alias("doc_id"), normal_text(F.col(text_col)).alias("norm")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.encode("norm", "utf-8").alias("rest")
    )
    base = base.withColumns({"gid": F.octet_length("rest").cast("long"), "digit": F.substring("rest", 1, first_width)})

    def groups(rows: DataFrame, name: str) -> DataFrame:
        """Groups with more than one row, summed before the shuffle, so that a hot group is one row from each task."""
        found = rows.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("next_gid"), F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"))
        return keep.write(found.filter("n > 1"), name)

    # The row ids of this first grouping are not used: the join below deals them once and for all.
    shared = keep.write(base.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gid", "digit", F.lit(True).alias("shared")), "shared0")
    alive = F.col("shared").isNotNull()
    first = keep.write(
        base.join(shared.hint("merge"), ["gid", "digit"], "left").select("row", "doc_id", "text_sha256", "gid", F.when(alive, F.col("rest")).alias("rest"), F.coalesce("shared", F.lit(False)).alias("shared")),
        "first",
    )
    left, ended, width, step = first.filter("shared").select("row", "doc_id", "gid", "rest"), [], first_width, 0
    while True:
        left = left.withColumn("digit", F.substring("rest", 1, width))
        multi = groups(left, f"groups{step}")
        split = left.join(multi.hint("merge"), ["gid", "digit"])
        done = F.octet_length("rest") <= width
        split = keep.write(split.select("row", "doc_id", F.col("next_gid").alias("gid"), F.when(~done, F.substring("rest", width + 1, _END)).alias("rest"), F.when(done, F.col("keep_id")).alias("keep_id"), F.when(done, F.col("keep_row")).alias("keep_row"), F.when(done, F.col("n")).alias("n")), f"split{step}")
        ended.append(split.filter("rest IS NULL").select("row", "keep_id", "keep_row", "n"))
        left = split.filter("rest IS NOT NULL").select("row", "doc_id", "gid", "rest")
        if left.isEmpty():
            break
        width, step = min(width * growth, max_width), step + 1
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    alone = F.col("n").isNull()
    return first.select("row", "doc_id", "text_sha256").join(found.hint("merge"), "row", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
