"""Restoring: by recorded position where the text there is unchanged, else by the replacement wherever it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHANGE = "struct<original:string,replacement:string,start_line:int,start_col:int,end_line:int,end_col:int>"


def _line_starts(text: Column) -> Column:
    """Offsets at which lines begin; only a line feed ends a line."""
    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(F.split(text, "\n", -1), first, lambda acc, line: F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _placed(text: Column, changes: Column, starts: Column) -> Column:
    """The first pass: (text, the changes it could not undo). starts: the offsets of lines; changes: an array of ``original, replacement`` and positions, in the order they were logged.

    From the last position to the first, a span that still equals its replacement becomes its original. What remains is undone by
    substitution in the whole text, longest replacement first, at word boundaries if it is a word. That second pass replaces every
    occurrence, and an original that holds another replacement is replaced again: known limits, kept as they are.
    """
    by_place = F.array_sort(F.transform(changes, lambda c, i: F.struct((-c["start_line"]).alias("l"), (-c["start_col"]).alias("c"), i.alias("i"), c.alias("x"))), lambda a, b: _order(a, b, "l", "c", "i"))

    def place(line, col, now):
        at = F.try_element_at(starts, F.when(line >= 1, line)) + col - 1
        return F.when((at >= 0) & (at <= F.length(now)), at)

    def step(acc, row):
        c, now = row["x"], acc["text"]
        a, b = place(c["start_line"], c["start_col"], now), place(c["end_line"], c["end_col"], now)
        size = F.greatest(b - a, F.lit(0))
        fits = F.coalesce(F.substring(now, a + 1, size) == c["replacement"], F.lit(False))
        undone = F.concat(F.substring(now, F.lit(1), a), c["original"], F.substring(now, b + 1, F.lit(2147483647)))
        return F.struct(F.when(fits, undone).otherwise(now).alias("text"), F.when(fits, acc["left"]).otherwise(F.concat(acc["left"], F.array(c))).alias("left"))

    return F.aggregate(by_place, F.struct(text.alias("text"), F.expr(f"CAST(array() AS array<{CHANGE}>)").alias("left")), step)


def _order(a: Column, b: Column, *names: str) -> Column:
    out = F.lit(0)
    for name in reversed(names):
        out = F.when(a[name] < b[name], F.lit(-1)).when(a[name] > b[name], F.lit(1)).otherwise(out)
    return out


def _substituted(placed: Column) -> Column:
    """The second pass over (text, changes that remain)."""
    by_length = F.array_sort(F.transform(placed["left"], lambda c, i: F.struct((-F.length(c["replacement"])).alias("n"), i.alias("i"), c.alias("x"))), lambda a, b: _order(a, b, "n", "i"))

    def step(text, row):
        c = row["x"]
        literal = F.replace(F.replace(c["original"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        whole = F.regexp_replace(text, F.concat(F.lit(r"(?U)\b"), c["replacement"], F.lit(r"\b")), literal)
        return F.when(c["replacement"].rlike(r"(?U)^\w+$"), whole).when(c["replacement"] == "", text).otherwise(F.replace(text, c["replacement"], c["original"]))

    return F.aggregate(by_length, placed["text"], step)


def restore(docs: DataFrame, text_col: str = "sanitized", changes_col: str = "changes", out: str = "restored") -> DataFrame:
    """Documents with a column ``out``, their text with the changes undone; a document without changes is unchanged."""
    changes = F.transform(F.col(changes_col), lambda c: F.struct(*[c[n].alias(n) for n in ("original", "replacement", "start_line", "start_col", "end_line", "end_col")]))
    # One stage each, so that no part is computed twice.
    some = F.coalesce(F.size(changes_col), F.lit(0)) > 0
    placed = docs.withColumn("_starts", F.when(some, _line_starts(F.col(text_col)))).withColumn("_placed", F.when(some, _placed(F.col(text_col), changes, F.col("_starts"))))
    text = F.when(F.col("_placed").isNull(), F.col(text_col)).when(F.size(F.col("_placed")["left"]) == 0, F.col("_placed")["text"]).otherwise(_substituted(F.col("_placed")))
    return placed.withColumn(out, text).drop("_placed", "_starts")


def restore_files(files: DataFrame, changes: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Files with ``restored``. changes: rows with ``file`` and the columns of a change; files without any pass unchanged."""
    fields = ["original", "replacement", "start_line", "start_col", "end_line", "end_col"]
    mine = changes.groupBy(F.col("file").alias("_file")).agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("_changes"))
    return restore(files.join(mine, F.col(path_col) == F.col("_file"), "left").drop("_file"), text_col, "_changes").drop("_changes")


def compare_trees(left: DataFrame, right: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``path, status`` for each file of two sets: same, changed, missing or extra."""
    a = left.select(F.col(path_col).alias("path"), F.sha2(F.col(content_col).cast("binary"), 256).alias("a"))
    b = right.select(F.col(path_col).alias("path"), F.sha2(F.col(content_col).cast("binary"), 256).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))
