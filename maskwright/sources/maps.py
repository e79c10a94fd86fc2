"""Change maps: one JSON document, or, for many changes, a table with a row for each."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..security import decrypt, encrypt

CHANGE_FIELDS = (
    "id string, file string, type string, category string, language string, original string, replacement string, start_line int, start_col int, "
    "end_line int, end_col int, scope string, confidence double, detector string, reversible boolean"
)
MAP = "version string, created_at string, session_id string, mode string, files array<struct<path:string,language:string>>, changes array<struct<" + CHANGE_FIELDS.replace(" ", ":").replace(",:", ",") + ">>"


def change_rows(log: DataFrame) -> DataFrame:
    """Rows of a map from a change log with ``path`` and ``language``."""
    return log.select(
        "id", F.col("path").alias("file"), "type", "category", "language", "original", "replacement", "start_line", "start_col", "end_line", "end_col",
        F.lit("text").alias("scope"), "confidence", "detector", F.lit(True).alias("reversible"),
    )


def map_document(files: DataFrame, changes: DataFrame, created_at: str | None = None, session_id: str | None = None) -> DataFrame:
    """The whole map as one row. files: ``file_ord, path, language``. For maps that one row can hold; else keep the rows of ``change_rows``."""
    listed = files.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "path", "language"))), lambda f: F.struct(f["path"].alias("path"), f["language"].alias("language"))).alias("files"))
    logged = changes.agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in CHANGE_FIELDS.split(", ")]))).alias("changes"))
    head = [("version", "1.0"), ("created_at", created_at or datetime.now(timezone.utc).isoformat()), ("session_id", session_id or str(uuid.uuid4())), ("mode", "sanitize")]
    return listed.crossJoin(logged).select(*[F.lit(v).alias(k) for k, v in head], "files", "changes")  # one row each


def to_json(document: DataFrame) -> Column:
    return F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    """A map from its JSON; malformed JSON fails."""
    return F.from_json(text, MAP, {"mode": "FAILFAST"})


def write_map(document: DataFrame, path: str, password: str | None = None) -> None:
    """One pretty JSON file, encrypted under a password. It holds the originals."""
    text = document.select(to_json(document)).first()[0]
    data = json.dumps(json.loads(text), indent=2, ensure_ascii=False).encode()
    with open(path, "wb") as out:
        out.write(encrypt(document.sparkSession, data, password) if password else data)


def read_map(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """The rows of a map's changes."""
    blob = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    data = decrypt(spark, blob, password) if password else blob
    try:
        text = data.decode()
        json.loads(text)
    except ValueError as bad:
        raise ValueError("the mapping file is not JSON; is it encrypted?") from bad
    parsed = spark.createDataFrame([(text,)], "text string").select(from_json(F.col("text")).alias("m"))
    return parsed.select(F.explode("m.changes").alias("c")).select("c.*")
