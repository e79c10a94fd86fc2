"""Detectors: from texts to arrays of findings, only those that the settings ask for."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import Settings
from ..functions.batches import small_batches
from ..functions.spans import FINDING, NONE, TIERS, entropy, find_spans, findings, merge_overlaps, merged_list


@dataclass(frozen=True)
class Detector:
    """A regex that Java, Python and RE2 read alike. A text must hold one of the literals in ``hints`` and match ``gate``, which is cheaper."""

    category: str
    pattern: str
    confidence: float
    hints: tuple[str, ...] = ()
    prefix: str | None = None
    gate: str | None = None


# Named secrets: patterns of our own, after the public formats of the tokens. Assignments span the value alone.
SECRETS = (
    Detector("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0.95, ("AKIA", "ASIA")),
    Detector("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 0.95, ("gh",)),
    Detector("gitlab_token", r"\bglpat-[A-Za-z0-9_-]{20,}", 0.95, ("glpat-",)),
    Detector("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0.95, ("xox",)),
    Detector("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}", 0.95, ("AIza",)),
    Detector("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0.9, ("eyJ",)),
    Detector("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0.95, ("PRIVATE KEY",)),
    Detector("ssh_public_key", r"\bssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/]{20,}={0,3}", 0.9, ("ssh-",)),
    Detector("oauth_bearer_token", r"[A-Za-z0-9._~+/-]{16,}=*", 0.8, ("earer",), r"\b[Bb]earer\s+"),
    Detector("db_connection_string", r"\b(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z0-9]+)?://[^\s'\"<>]+", 0.9, ("://",)),
    Detector("azure_connection_string", r"DefaultEndpointsProtocol=https?;AccountName=[^;\s]+;AccountKey=[^;\s'\"]+", 0.95, ("AccountKey=",)),
    Detector("generic_password_assignment", r"[^\s\"']{4,}", 0.75, (), r"\b(?i:password|passwd|pwd)\s*[=:]\s*[\"']?", "(?i)passw|pwd"),
    Detector("generic_secret_assignment", r"[A-Za-z0-9+/_.=-]{8,}", 0.7, (), r"\b(?i:secret|token|api_?key|access_?key)\s*[=:]\s*[\"']?", "(?i)secret|token|key"),
)
# Personal data, network names and paths, with their confidences.
VALUES = (
    Detector("email", r"\b[\w.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+\b", 0.85, ("@",)),
    Detector("url", r"\bhttps?://[^\s'\"<>]+", 0.8, ("://",)),
    Detector("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.8, (".",), gate=r"(?U)\d\.\d"),
    Detector("phone", r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.55, gate=r"(?U)\d{3}"),
    Detector("hostname", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){2,}[a-zA-Z]{2,}\b", 0.6, (".",), gate=r"[a-zA-Z0-9]\.[a-zA-Z0-9]"),
    Detector("file_path", r"\b[A-Za-z]:\\(?:[^<>:\"|?*\r\n\\]+\\)*[^<>:\"|?*\r\n\\]+", 0.7, (":\\",)),
    Detector("file_path", r"(?<![\w/])/(?:home|Users|var|etc|opt|root)/[\w./-]+", 0.7, ("/home/", "/Users/", "/var/", "/etc/", "/opt/", "/root/")),
)
TOKEN = r"\b[A-Za-z0-9+/_=-]{20,}\b"
#: The same with boundaries of ASCII alone, spelt out: neither Java nor Python has another way that both read.
ASCII_TOKEN = TOKEN.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
#: Java's matcher recurses for each repetition of a group; texts with such long tokens, or Windows paths in such long lines, are matched by Python instead.
LONG_TOKEN = r"(?U)(?:^|\s)[^\s]{1000,}"
LONG_TEXT = 1 << 15  # characters beyond which a text may hold so many findings that arrays of them are slow
LONG_PATH = r"(?:^|[<>:\"|?*\r\n])[^<>:\"|?*\r\n]{4000,}"


def _gated(text: Column, hints: tuple[str, ...], gate: str | None, spans: Column) -> Column:
    """Spans only of texts that pass the cheap tests; the rest never meets the pattern."""
    wanted = text.rlike(gate) if gate else F.lit(True)
    if hints:
        some = F.contains(text, F.lit(hints[0]))
        for hint in hints[1:]:
            some = some | F.contains(text, F.lit(hint))
        wanted = some & wanted
    return F.when(wanted, spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")) if hints or gate else spans


def detector_columns(text: Column, settings: Settings, only: tuple[str, ...] | None = None) -> list[Column]:
    """A column of findings for each detector that is on, in order of emission."""
    out, emit = [], 0
    allows = lambda category: settings.allows(category) and (only is None or category in only)
    for d in SECRETS:
        emit += 1
        if allows(d.category) and d.confidence >= settings.min_confidence:
            out.append(findings(_gated(text, d.hints, d.gate, find_spans(text, d.pattern, d.prefix)), d.category, d.confidence, "regex", emit))
    emit += 1
    if allows("high_entropy_string"):
        scored = F.transform(_gated(text, (), "[A-Za-z0-9+/_=-]{20,}", find_spans(text, ASCII_TOKEN if settings.ascii_tokens else TOKEN)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), entropy(s["value"]).alias("h")))
        scored = F.filter(scored, lambda s: s["h"] >= settings.entropy_threshold)
        sure = lambda s: F.least(F.lit(0.3) + (s["h"] - F.lit(float(settings.entropy_threshold))) * F.lit(0.1), F.lit(0.75))
        made = F.transform(scored, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit("high_entropy_string").alias("category"), s["value"].alias("value"), sure(s).alias("confidence"),
            F.lit("entropy").alias("detector"), F.lit(TIERS["entropy"]).alias("tier"), F.lit(emit).alias("emit")))
        out.append(F.filter(made, lambda f: f["confidence"] >= settings.min_confidence))
    for d in VALUES:
        emit += 1
        if allows(d.category) and d.confidence >= settings.min_confidence:
            spans = _gated(text, d.hints, d.gate, find_spans(text, d.pattern))
            if d.category == "hostname":
                labels = F.array(*[F.lit(x) for x in settings.hostname_labels])
                spans = F.filter(spans, lambda s: F.arrays_overlap(F.split(F.lower(s["value"]), r"\."), labels))
            out.append(findings(spans, d.category, d.confidence, "regex", emit))
    emit += 1  # the place of a name recogniser, see with_names
    for name, pattern in settings.custom_patterns.items():
        emit += 1
        if allows(name) and settings.min_confidence <= 0.9:
            out.append(findings(find_spans(text, pattern), name, 0.9, "custom", emit))
    for term, category in settings.known_terms.items():
        emit += 1
        if term and allows(category) and settings.min_confidence <= 0.95:
            out.append(findings(_gated(text, (term,), None, find_spans(text, r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E")), category, 0.95, "custom", emit))
    return out


def python_findings(text: str, settings: Settings, only: tuple[str, ...] | None = None) -> list[tuple]:
    """The same findings by Python's ``re``, which does not recurse: for texts with very long tokens, and to test against."""
    out, emit = [], 0

    def add(matches, category, confidence, detector):
        if settings.allows(category) and (only is None or category in only) and confidence >= settings.min_confidence:
            out.extend((a, b, category, text[a:b], confidence, detector, TIERS[detector], emit) for a, b in matches)

    hinted = lambda d: not d.hints or any(h in text for h in d.hints)
    for d in SECRETS:
        emit += 1
        if hinted(d) and settings.allows(d.category) and (only is None or d.category in only):
            add([m.span("v") for m in re.finditer(f"{d.prefix or ''}(?P<v>{d.pattern})", text)], d.category, d.confidence, "regex")
    emit += 1
    for m in re.finditer(TOKEN, text, re.ASCII if settings.ascii_tokens else 0) if settings.allows("high_entropy_string") and (only is None or "high_entropy_string" in only) else ():
        token = m.group()
        h = -sum(p * math.log2(p) for p in (token.count(c) / len(token) for c in set(token)))
        if h >= settings.entropy_threshold:
            add([m.span()], "high_entropy_string", min(0.3 + (h - settings.entropy_threshold) * 0.1, 0.75), "entropy")
    for d in VALUES:
        emit += 1
        if hinted(d) and settings.allows(d.category) and (only is None or d.category in only):
            add([m.span() for m in re.finditer(d.pattern, text) if d.category != "hostname" or set(m.group().lower().split(".")) & set(settings.hostname_labels)], d.category, d.confidence, "regex")
    emit += 1
    for name, pattern in settings.custom_patterns.items():
        emit += 1
        add([m.span() for m in re.finditer(pattern, text)], name, 0.9, "custom")
    for term, category in settings.known_terms.items():
        emit += 1
        add([m.span() for m in re.finditer(re.escape(term), text)] if term else [], category, 0.95, "custom")
    return out


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("detector", pa.string()), ("tier", pa.int32()), ("emit", pa.int32())]))


def _in_python(settings: Settings, only: tuple[str, ...] | None, merged: bool):
    """A column function over Arrow batches of texts: their findings, none for a null."""

    def find(texts: pa.Array) -> pa.Array:
        names, out = _FOUND.value_type.names, []
        for text in (t.as_py() for t in texts):  # one at a time
            found = None if text is None else python_findings(text, settings, only)
            out.append(None if found is None else [dict(zip(names, x, strict=True)) for x in (merged_list(found) if merged else found)])
        return pa.array(out, _FOUND)

    return F.arrow_udf(find, f"array<{FINDING}>")


def detect(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", merged: bool = True, guard: bool = True, only: tuple[str, ...] | None = None, native: bool = False) -> DataFrame:
    """``docs`` with a column ``findings``; merged, unless asked otherwise, so that none overlap.

    A null text has no findings. The input is read once; its texts go through one Arrow function, whose cost is linear in a text and its
    findings. Detectors that the settings rule out, or that are not of the categories in ``only``, do not run, and one whose hints a text
    lacks is skipped. With ``native`` the same is built of SQL functions alone, which takes several times as long here; with ``guard`` its very long
    texts, and those whose tokens are so long that Java's matcher could exhaust its stack, still go through Python.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not native:
        return docs.withColumn("findings", _in_python(settings, only, merged)(text))
    columns = detector_columns(text, settings, only)
    own = (F.concat(*columns) if columns else F.expr(NONE)).cast(f"array<{FINDING}>")
    if not guard or not columns:
        found = docs.withColumn("findings", own)
        return found.withColumn("findings", merge_overlaps("findings")) if merged else found
    long = (F.length(text) > LONG_TEXT) | text.rlike(LONG_TOKEN) | (F.contains(text, F.lit(":\\")) & text.rlike(LONG_PATH))
    found = docs.withColumn("_slow", _in_python(settings, only, merged)(F.when(long, text)))
    found = found.withColumn("findings", F.when(F.col("_slow").isNull(), own))
    if merged:
        found = found.withColumn("findings", F.when(F.col("findings").isNotNull(), merge_overlaps("findings")))
    return found.withColumn("findings", F.coalesce("findings", "_slow")).drop("_slow")


def with_names(found: DataFrame, recognise, settings: Settings, text_col: str = "text") -> DataFrame:
    """Add what a name recogniser finds to unmerged findings. recognise: a pandas UDF from texts to arrays of (start, end, category, score).

    No recogniser ships with the package; without one, or with ``enable_pii_nlp`` off, nothing is added.
    """
    if recognise is None or not settings.enable_pii_nlp:
        return found
    emit = len(SECRETS) + 1 + len(VALUES) + 1
    named = F.transform(recognise(F.col(text_col)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), F.substring(F.col(text_col), s["start"] + 1, s["end"] - s["start"]).alias("value"),
        s["score"].cast("double").alias("confidence"), F.lit("presidio").alias("detector"), F.lit(TIERS["presidio"]).alias("tier"), F.lit(emit).alias("emit")))
    return found.withColumn("findings", F.concat("findings", F.filter(named, lambda f: f["confidence"] >= settings.min_confidence)))


def exploded(found: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding, with these columns of its document."""
    return found.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.start", "f.end", "f.category", "f.value", "f.confidence", "f.detector")
