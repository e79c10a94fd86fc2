"""Contiguous byte-balanced shards: prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, bucket_count


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = (), range_rows: int = 2_000_000) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` after the ``carry`` columns.

    Rows are put in one global order (by a hash of the text, then id), so equal texts are neighbours and sources are
    spread. Range partitions, one for each ``range_rows`` rows but no fewer than shuffle partitions, give that order in parallel; the sums of the partitions before give each partition's
    offset in bytes and rows; a running sum inside each gives every row's place. The axis of all bytes is cut into
    ``n_shards`` equal pieces and a row goes where its middle lies. Equal texts move as one as long as together they
    are no larger than the largest row or a hundredth of a shard, and not so many as a quarter of a shard's rows and 1000, so no shard is off its target by more than that at either end.
    ``slot`` numbers the rows of a shard from 0 without gaps. The size of a null text is ``overhead`` alone, its CRC
    that of no bytes; null ids and repeated rows are rows like others; an empty table gives no rows. Only copies beyond
    that are cut over many range partitions, by id. A ``carry`` column must not bear the name of a result column. A very long text is one row whose size may pass
    a shard's target; only its size, CRC and hash are taken unless it is carried.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep.write(
        docs.select(
            *carry,
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_order"),
        ),
        "rows",
    )
    total, largest, n_rows = rows.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    parts = bucket_count(spark, n_rows, range_rows)
    total, limit = total or 1, max(largest or 0, (total or 0) // (100 * n_shards))
    copies = rows.groupBy("_order").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    hot = keep.write(copies.filter((F.col("_bytes") > limit) | (F.col("_n") > n_rows / (4 * n_shards) + 1000)).select("_order", F.lit(True).alias("_hot")), "hot")
    cut = rows.join(F.broadcast(hot), "_order", "left").withColumn("_cut", F.when(F.col("_hot"), F.col("doc_id")))  # fewer than 104 * n_shards are hot
    ranged = keep.write(cut.repartitionByRange(parts, "_order", "_cut").drop("_hot", "_cut").withColumn("_part", F.spark_partition_id()), "ranged")
    keep.drop("rows")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (
        ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows0"))
    )
    running = Window.partitionBy("_part").orderBy("_order", "doc_id")
    same = Window.partitionBy("_part", "_order")
    placed = (
        ranged.withColumns({
            "_end": F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)),
            "_row": F.row_number().over(running).cast("long") - 1,
        })
        .withColumns({"_group": F.sum("size").over(same), "_first": F.min(F.col("_end") - F.col("size")).over(same)})
        .join(F.broadcast(offsets), "_part")
    )
    whole = F.col("_group") <= limit
    start = F.col("_bytes0") + F.when(whole, F.col("_first")).otherwise(F.col("_end") - F.col("size"))
    twice_middle = 2 * start + F.when(whole, F.col("_group")).otherwise(F.col("size"))
    placed = keep.write(
        placed.select(
            *carry, "doc_id", "size", "text_crc32",
            F.least(F.lit(n_shards - 1), F.floor(twice_middle * n_shards / F.lit(2 * total))).cast("int").alias("shard"),
            (F.col("_rows0") + F.col("_row")).alias("_row"),
        ),
        "placed",
    )
    keep.drop("ranged")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        *carry, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
