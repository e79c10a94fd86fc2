"""From files to sanitised files, their change log, and counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..functions.language import language_of
from ..functions.spans import FINDING, NONE, merge_overlaps
from ..functions.stable import stable
from ..operators import identifiers
from ..operators.detect import detect, with_names
from ..operators.replace import change_log, first_seen, number, replace_findings
from ..operators.scan import scan_counts


class Sanitized(NamedTuple):
    """``files``: the input with ``language``, ``sanitized`` and ``changes``; ``changes``: a row for each change; ``fakes``: the dictionary."""

    files: DataFrame
    changes: DataFrame
    fakes: DataFrame


def with_findings(files: DataFrame, settings: Settings = Settings(), language: str | None = None, recognise=None) -> tuple[DataFrame, DataFrame | None]:
    """Files (``file_ord, path, content``) with ``language`` and merged ``findings``; and the occurrences of identifiers, if they are wanted.

    With one file its own definitions decide what is renamed, with more those of all. ``language`` overrides what would be found.
    """
    named = files.withColumn("language", F.lit(language) if language else language_of(F.col("path"), F.coalesce("content", F.lit(""))))
    found = with_names(detect(named, settings, "content", merged=False), recognise, settings, "content")
    occurrences = None
    if settings.options.code_identifiers:
        occurrences = stable(identifiers.collect(named))
        rows = identifiers.eligible(occurrences, settings)
        found = found.join(identifiers.as_findings(rows), "file_ord", "left").withColumn("findings", F.concat("findings", F.coalesce("named", F.expr(NONE)))).drop("named")
    return found.withColumn("findings", merge_overlaps("findings").cast(f"array<{FINDING}>")), occurrences


def sanitize(files: DataFrame, settings: Settings = Settings(), language: str | None = None, recognise=None) -> Sanitized:
    """Replace all findings of files (``file_ord, path, content``), the same value by the same fake everywhere."""
    found, occurrences = with_findings(files, settings, language, recognise)
    found = stable(found)
    pairs = first_seen(found, "file_ord")
    forced = None
    if occurrences is not None:
        named = identifiers.first_named(identifiers.eligible(occurrences, settings))
        pairs = named.unionByName(pairs.join(named, ["category", "value"], "left_anti"))
        pairs = stable(pairs)
        forced = identifiers.without_clashes(number(pairs), occurrences)
    fakes = stable(number(pairs, forced))
    done = stable(replace_findings(found, "file_ord", fakes, "content"))
    return Sanitized(done, change_log(done, "file_ord", "path", "language"), fakes)


def scan(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``path, language, category, count`` of findings, without any value."""
    return scan_counts(with_findings(files, settings)[0], "path", "language")
