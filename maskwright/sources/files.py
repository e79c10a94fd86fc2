"""Folders of text files: what is read, in which order, and how bytes become text."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import Settings
from ..functions.stable import stable

PROBE = 8192
# What the bytes 80 to 9F mean in Windows-1252; 81, 8D, 8F, 90 and 9D mean nothing.
_WINDOWS = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
_LATIN = "".join(map(chr, range(0x80, 0xA0)))


def is_binary(content: Column) -> Column:
    """Whether the first 8,192 bytes hold a zero byte, or are neither UTF-8 nor Windows-1252. A character that begins in them is read whole."""
    probe = F.substring(content, 1, PROBE)
    text = F.decode(probe, "ISO-8859-1")
    utf8 = F.is_valid_utf8(probe.cast("string"))
    for more in (1, 2, 3):
        utf8 = utf8 | F.is_valid_utf8(F.substring(content, 1, PROBE + more).cast("string"))
    return text.contains("\u0000") | ~(utf8 | ~text.rlike("[\u0081\u008d\u008f\u0090\u009d]"))


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, whether the fallback was needed): UTF-8, else Windows-1252 with U+FFFD for what has no meaning."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _WINDOWS)), ~utf8


def wanted(path: Column, settings: Settings = Settings()) -> Column:
    """Whether a relative path lies in no ignored folder and matches no ignored glob (``*.ext`` forms)."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in settings.ignored_dirs]).cast("array<string>"))
    for glob in settings.ignored_globs:
        keep = keep & ~F.element_at(parts, -1).rlike("(?s)^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$")
    return keep


def walk_key(path: Column) -> Column:
    """A key that sorts paths as a walk meets them: in a folder first its files by name, then its folders by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).alias("folder"), p.alias("name")))


def numbered(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) with ``file_ord``, their place in the walk, counted by sorted ranges."""
    rows = stable(files.withColumn("_key", walk_key(F.col("path"))).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ahead = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_part").orderBy("_key")
    return rows.join(F.broadcast(ahead), "_part").withColumn("file_ord", (F.col("_ahead") + F.row_number().over(within) - 1).cast("long")).drop("_key", "_part", "_ahead")


def _empty_files(found: DataFrame) -> DataFrame:
    """The files of no bytes, which Spark lists but never reads: those listed that no scan meets."""
    spark = found.sparkSession
    listed = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", found._jdf.inputFiles())  # as URIs, which hold no line feed; the driver has this list already
    plain = lambda uri: F.regexp_replace(uri, "^([^:/]+):/+", "$1:/")  # the two spell file:/ and file:///
    listed = spark.createDataFrame([(uri,) for uri in listed.split("\n") if uri], "uri string").select(plain("uri").alias("uri"))
    rest = listed.join(found.select(plain("_metadata.file_path").alias("uri")), "uri", "left_anti")  # contents are not read for this
    return rest.select(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"), F.lit(b"").alias("content"))


def load_folder(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """``file_ord, path, content, source_path, used_fallback`` of the text files below a folder; unreadable ones are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    bare = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), r"^/+", "/")
    relative = F.substring(bare, len("/" + base.split(":", 1)[-1].lstrip("/")) + 2, 1 << 30)
    rows = found.select("path", "content").unionByName(_empty_files(found)).select(relative.alias("path"), F.col("path").alias("source_path"), "content")
    return numbered(_as_text(rows.filter(wanted(F.col("path"), settings)).filter(~is_binary(F.col("content")))))


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file under its own name; neither ignore rules nor the binary test apply."""
    found = spark.read.format("binaryFile").load(path)
    return _as_text(found.select(F.lit(os.path.basename(path)).alias("path"), F.col("path").alias("source_path"), "content")).withColumn("file_ord", F.lit(0).cast("long"))


def load_text(spark: SparkSession, text: str) -> DataFrame:
    """A text as the file ``input.txt``."""
    return spark.createDataFrame([(0, "input.txt", text, None, False)], "file_ord long, path string, content string, source_path string, used_fallback boolean")


def load_input(spark: SparkSession, input_path: str | None = None, text: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """A text before a path; a path that holds files is a folder."""
    if text is not None:
        return load_text(spark, text)
    if not input_path:
        raise ValueError("either a path or a text is needed")
    where = spark._jvm.org.apache.hadoop.fs.Path(input_path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    return load_folder(spark, input_path, settings) if folder else load_file(spark, input_path)


def _as_text(rows: DataFrame) -> DataFrame:
    text, fallback = decoded(F.col("content"))
    return rows.select("path", text.alias("text"), "source_path", fallback.alias("used_fallback")).withColumnRenamed("text", "content")


def keyword_terms(lines: DataFrame, column: str = "value") -> DataFrame:
    """``term, category``: the distinct trimmed lines of keyword lists, each an ``org``."""
    rows = lines.select(F.explode(F.split(column, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("line"))
    term = F.regexp_replace("line", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return rows.select(term.alias("term")).filter("term <> ''").distinct().withColumn("category", F.lit("org"))


def write_files(files: DataFrame, root: str, content_col: str = "content") -> None:
    """Write each file below ``root`` as UTF-8, line ends as they are. Running a task again writes the same bytes again."""
    target = root

    def write(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(target.replace("file:/", "file:///", 1) if target.startswith("file:/") and not target.startswith("file://") else target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ".." in path.split("/") or path.startswith("/"):
                    raise ValueError("a path leaves the output folder")
                where.create_dir(os.path.dirname(f"{base}/{path}"), recursive=True)
                with where.open_output_stream(f"{base}/{path}") as out:
                    out.write((content or "").encode())
            yield batch.slice(0, 0)

    files.select("path", content_col).mapInArrow(write, f"path string, {content_col} string").count()
