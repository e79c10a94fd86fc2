"""Identifiers over many files: occurrences, the catalog of definitions, findings, and fakes that clash with no real name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import IDENTIFIER_OPTION, Settings
from ..functions.code import RESERVED, is_ignored, occurrences
from ..functions.spans import FINDING, TIERS

_OUT = "file_ord long, language string, start int, end int, name string, category string, usable boolean"


def collect(files: DataFrame) -> DataFrame:
    """A row for each identifier of files (``file_ord, language, content``), ``category`` set where it is a definition."""

    def read(batches):
        for batch in batches:
            rows = {"file_ord": [], "language": [], "start": [], "end": [], "name": [], "category": [], "usable": []}
            for order, language, text in zip(*(batch.column(c).to_pylist() for c in ("file_ord", "language", "content")), strict=True):
                for o in occurrences(language, text):
                    for key, value in zip(rows, (order, language, o.start, o.end, o.name, o.category, not is_ignored(language, o.name)), strict=True):
                        rows[key].append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    return files.filter(F.col("language").isin(*RESERVED)).select("file_ord", "language", "content").mapInArrow(read, _OUT)


def catalog(found: DataFrame) -> DataFrame:
    """``name, category``: every defined name with the category of its first definition in file order, whatever the language."""
    return found.filter("category IS NOT NULL").groupBy("name").agg(F.min_by("category", F.struct("file_ord", "start")).alias("category"))


def eligible(found: DataFrame, settings: Settings, shared: bool = True) -> DataFrame:
    """Occurrences of names that may be renamed, with their category.

    A name is eligible where it is defined: anywhere in the run if ``shared``, else in its own file. Ignored and protected names and
    the categories that are off are left out.
    """
    off = [c for c, option in IDENTIFIER_OPTION.items() if not getattr(settings.options, option)]
    keys = ["name"] if shared else ["file_ord", "name"]
    defined = found.filter("category IS NOT NULL").groupBy(*keys).agg(F.min_by("category", F.struct("file_ord", "start")).alias("kind"))
    rows = found.filter("usable").drop("category").join(defined, keys).withColumnRenamed("kind", "category")
    if off:
        rows = rows.filter(~F.col("category").isin(*off))
    if settings.protected_identifiers:
        rows = rows.filter(~F.col("name").isin(*sorted(settings.protected_identifiers)))
    return rows


def as_findings(rows: DataFrame) -> DataFrame:
    """``file_ord, named``: the findings of eligible occurrences, an array for each file."""
    finding = F.struct("start", "end", "category", F.col("name").alias("value"), F.lit(1.0).alias("confidence"), F.lit("tree-sitter").alias("detector"), F.lit(TIERS["tree-sitter"]).alias("tier"), F.lit(1 << 20).alias("emit"))
    return rows.groupBy("file_ord").agg(F.sort_array(F.collect_list(finding)).cast(f"array<{FINDING}>").alias("named"))


def first_named(rows: DataFrame) -> DataFrame:
    """``category, value, seen`` of identifiers: they take their numbers before the values of the same file do."""
    return rows.groupBy("category", F.col("name").alias("value")).agg(F.min(F.struct(F.col("file_ord").alias("document"), F.lit(0).alias("phase"), "start")).alias("seen"))


def without_clashes(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """``category, value, forced``: a suffix _001, _002, ... for each identifier's fake that is another real name, the first that is free."""
    names = found.select("name").distinct()
    fakes = numbered.filter(F.col("category").isin(*IDENTIFIER_OPTION)).select("category", "value", "replacement")
    clash = fakes.filter("replacement <> value").join(names, F.col("replacement") == F.col("name"), "left_semi")
    ending = r"^(.*)_(\d{3}|[1-9]\d{3,8})$"  # only as a suffix is written: three digits, or more without leading zeros
    suffixed = names.filter(F.col("name").rlike(ending)).select(F.regexp_extract("name", ending, 1).alias("base"), F.regexp_extract("name", ending, 2).cast("int").alias("k"))
    taken = suffixed.groupBy("base").agg(F.collect_set("k").alias("taken"))
    out = clash.join(taken, clash["replacement"] == taken["base"], "left").withColumn("taken", F.coalesce("taken", F.expr("CAST(array() AS array<int>)")))
    k = F.expr("filter(sequence(1, size(taken) + 1), k -> NOT array_contains(taken, k))[0]")
    return out.select("category", "value", F.concat("replacement", F.lit("_"), F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))).alias("forced"))
