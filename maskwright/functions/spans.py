"""Findings as arrays of spans: regular expressions to spans, and the merge of overlaps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A finding. Offsets count code points, the end is exclusive; ``tier`` ranks detectors, ``emit`` the order of emission.
FINDING = "struct<start:int,end:int,category:string,value:string,confidence:double,detector:string,tier:int,emit:int>"
NONE = f"CAST(array() AS array<{FINDING}>)"

# The rank of a detector where findings overlap.
TIERS = {"tree-sitter": 5, "custom": 4, "regex": 4, "detect-secrets": 3, "entropy": 2, "presidio": 1}


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(text: Column, pattern: str, prefix: str | None = None) -> Column:
    """Every match as ``array<struct<start,end,value>>``, in order, as Python's ``finditer`` gives them.

    The offsets are sums of what lies between matches and of the matches themselves. With ``prefix``, which must not contain groups that
    capture, the span is what follows it. The pattern must not match nothing.
    """
    full = f"(?Ud)(?:{pattern})" if prefix is None else f"(?Ud)({prefix})({pattern})"
    found = F.regexp_extract_all(text, F.lit(full), F.lit(0))
    lead = F.transform(found, lambda _: F.lit(0)) if prefix is None else F.transform(F.regexp_extract_all(text, F.lit(full), F.lit(1)), lambda p: F.length(p))
    gaps = F.transform(F.split(text, full, -1), lambda g: F.length(g))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"), lead.alias("lead"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc, piece):
        begin, size = acc["at"] + piece["gap"], F.length(piece["match"])
        hit = F.struct((begin + piece["lead"]).alias("start"), (begin + size).alias("end"), F.substring(piece["match"], piece["lead"] + 1, size).alias("value"))
        return F.struct((begin + F.coalesce(size, F.lit(0))).alias("at"), F.when(piece["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def findings(spans: Column, category: str, confidence: Column | float, detector: str, emit: int) -> Column:
    """Spans as findings of one category."""
    sure = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(category).alias("category"), s["value"].alias("value"), sure.alias("confidence"),
        F.lit(detector).alias("detector"), F.lit(TIERS.get(detector, 0)).alias("tier"), F.lit(emit).alias("emit"),
    ))


def merge_overlaps(column: str) -> Column:
    """The findings that stay: a fold by start, ties by emission.

    A finding without overlap stays. One that overlaps kept findings replaces them all if its (tier, length, confidence) is above
    the best of theirs, and else goes; what was replaced never returns. What is kept never overlaps, so the last ends last:
    where the next finding begins behind it, all before is done and only an island of findings is ever compared.
    """
    rank = "struct({0}.tier, {0}.end - {0}.start, {0}.confidence)"
    overlap = "k.start < f.end AND f.start < k.end"
    return F.expr(f"""
        aggregate(
          array_sort({column}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.emit < b.emit THEN -1 WHEN a.emit > b.emit THEN 1 ELSE 0 END),
          named_struct('done', {NONE}, 'open', {NONE}),
          (acc, f) -> CASE
            WHEN size(acc.open) = 0 OR element_at(acc.open, -1).end <= f.start THEN named_struct('done', concat(acc.done, acc.open), 'open', array(f))
            WHEN NOT exists(acc.open, k -> {overlap}) THEN named_struct('done', acc.done, 'open', concat(acc.open, array(f)))
            WHEN {rank.format("f")} > array_max(transform(filter(acc.open, k -> {overlap}), k -> {rank.format("k")}))
              THEN named_struct('done', acc.done, 'open', concat(filter(acc.open, k -> NOT ({overlap})), array(f)))
            ELSE acc END,
          acc -> concat(acc.done, acc.open)
        )
    """)


def merged_list(found: list[tuple]) -> list[tuple]:
    """The same merge of (start, end, category, value, confidence, detector, tier, emit) in plain Python."""
    kept: list[tuple] = []
    rank = lambda f: (f[6], f[1] - f[0], f[4])
    for f in sorted(found, key=lambda f: (f[0], f[7])):
        n = len(kept)
        while n and kept[n - 1][1] > f[0]:
            n -= 1
        if n == len(kept) or rank(f) > max(map(rank, kept[n:])):
            kept[n:] = [f]
    return kept


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits."""
    n = F.length(value)

    def add(total, char):
        share = (n - F.length(F.replace(value, char, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.split(value, "", -1)), F.lit(0.0), lambda total, char: F.when(char == "", total).otherwise(add(total, char)))
