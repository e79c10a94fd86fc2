"""The corpus pipeline: five operators in turn over ``documents``.

Each stage is a function of (spark, docs, sf_dir) on all rows its predecessor kept; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. Null or empty texts have no language
and go in the first stage; repeated rows are rows; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm.common import Scratch, table
from maskwright.llm.decontamination import decontaminate
from maskwright.llm.language_id import fit, identify
from maskwright.llm.mixing import mix_sources
from maskwright.llm.sharding import shard_by_bytes
from maskwright.llm.similar import similar_texts

N_SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels of ``documents`` teach; what is in none of them goes."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_all"))
    return identify(whole, fit(docs), carry=("_all",)).filter("NOT rejected").select("_all.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at Jaccard 0.8 of their five-word shingles the document with the smallest id; rows that repeat it stay.

    A row without an id goes if its group has one with an id; a group of none but such rows stays.
    """
    kept = similar_texts(docs).filter("doc_id = component_id OR component_id IS NULL").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (F.xxhash64(docs["text"]) == kept["text_hash"])
    return docs.join(kept.hint("merge"), same, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item: no eight words of one in a row, nor a shorter one whole."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", "text", F.struct(*others).alias("_others")) if others else docs
    found = decontaminate(named, table(spark, sf_dir, "benchmark"), carry=("text", "_others") if others else ("text",)).filter("n_items = 0")
    return found.select(*[F.col("_others")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: a document appears as often as the mix takes it."""
    mixed = mix_sources(docs.withColumn("_all", F.struct(*docs.columns)), carry=("_all",)).filter("repeats > 0")
    return mixed.select("_all", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("_copy")).select("_all.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, its text and other columns too, with its shard and slot. A column named like one of the operator's is called ``document_`` and its name."""
    made = shard_by_bytes(docs.withColumn("_all", F.struct(*docs.columns)), N_SHARDS, carry=("_all",))
    own = [c for c in made.columns if c != "_all"]
    taken, rest = {c.lower() for c in (*own, *docs.columns)}, []
    for column in docs.columns:
        if column == "doc_id":
            continue
        name = column
        if column.lower() in own:
            while name.lower() in taken:
                name = f"document_{name}"
            taken.add(name.lower())
        rest.append(F.col("_all")[column].alias(name))
    return made.select(*own, *rest)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The stages are not expressible in SQL (trained centroids, fingerprints, knapsacks); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    keep = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
