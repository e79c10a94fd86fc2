"""The registered queries of the engine over the given tables, and their SQL, written independently of the plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Switches, Settings
from .functions.language import by_extension, by_looks, by_shebang
from .functions.spans import FINDING, entropy, merge_overlaps
from .functions.stable import shared_folder, spread
from .operators import identifiers
from .operators.detect import detect, exploded
from .operators.replace import change_log, first_seen, number, replace_findings
from .operators.restore import compare_trees, restore, restore_files
from .operators.scan import redact, scan_counts, scan_totals
from .plans.sanitize import sanitize
from .sources.files import decoded, is_binary, keyword_terms, load_folder, load_input, numbered, wanted, write_files
from .sources.maps import change_rows, from_json, map_document, to_json
from .streaming.scan import documents_stream, start_counts

_PII = Settings(options=Switches(sensitive_secrets=False))
_HOSTS = Settings(hostname_labels=("example",))
_TERMS = {"stupid": "word", "MIT License": "org", "thorough": "word"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _only(*categories: str, table: str = "documents", key: str = "doc_id", column: str = "text", settings: Settings = Settings()):
    """Raw findings of some categories."""

    def query(spark, sf_dir):
        out = exploded(detect(spread(_table(spark, sf_dir, table).select(key, F.col(column).alias("text"))), settings, merged=False, only=categories), key)
        return out.select(key, "category", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "value", F.round("confidence", 6).alias("confidence"))

    return query


def _given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Fixtures that the tables have no rows for; the SQL has them as VALUES.
PATHS = [(1, r"open C:\Users\bob\a.txt now"), (2, "see /home/bob/x.log, not a/home/b"), (3, "/etc/hosts and /opt/é/z and /usr/bin"), (4, "none"), (5, r"D:\one file.txt")]
NAMES = [(1, "src/a.PY", "x"), (2, "a.h", "class X {};"), (3, "b.h", "int x;"), (4, "noext", "x"), (5, "d.e/f", "x"), (6, "q.tsx", "x"), (7, ".py", "x"), (8, "x.tar.md", "x")]
FIRST_LINES = [(1, "#!/usr/bin/env python3\nx"), (2, "#!/bin/zsh -e\n"), (3, "#!/usr/bin/node"), (4, "#!/bin/fish\npython"), (5, "no #!python"), (6, "")]
LOOKS = [(1, "  \n"), (2, "{a]"), (3, " <x>"), (4, "x\n  def f(a): pass"), (5, "import a.b;\n"), (6, "package main"), (7, "fn main() {}"), (8, "a => {"), (9, "select a\n from b\n"), (10, "key: value"), (11, "## T"), (12, "plain words")]
LOGS = [(1, "user bob logged in from 10.0.0.1", ["bob", "10.0.0.1"]), (2, "nothing", ["x"]), (3, "aa aaa", ["aa"]), (4, "kept", [])]
BYTES = [(1, "plain".encode()), (2, b"a\0b"), (3, "caf\u00e9".encode()), (4, b"Mu\xf1oz \x80"), (5, b"bad \x81\xff"), (6, b"")]
FILES = [("b.txt",), ("a/x.txt",), ("a.b/y",), ("a/c/z",), ("z",), ("a/b",), ("node_modules/q.js",), ("a/p.PNG",), ("a/p.png",)]
CODE = [
    (0, "a.py", "class RealClass:\n    def go(self, url):\n        return url\n"), (1, "b.py", "class Cls001(RealClass):\n    pass\n"),
    (2, "foo.h", "class Foo {\npublic:\n    int count;\n    void bar();\n};\n"), (3, "foo.cpp", "void Foo::bar() { count = 1; }\n"), (4, "q.sql", "SELECT Foo FROM bar;\n"),
]


def language_heuristic(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    return spread(pages.unionByName(docs)).select("kind", "id", by_looks(F.col("text")).alias("language"))


def detect_entropy(spark, sf_dir):
    return _only("high_entropy_string", settings=Settings(entropy_threshold=3.0, min_confidence=0.3, ascii_tokens=True))(spark, sf_dir)


def merged_findings(spark, sf_dir):
    out = exploded(detect(_docs(spark, sf_dir), Settings(min_confidence=0.0, hostname_labels=("com", "example"))), "doc_id")
    return out.filter("category <> 'high_entropy_string'").select("doc_id", "category", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "value")


def merge_fold(spark, sf_dir):
    """The merge on spans made from lineitem rows, where chains and ties abound."""
    rows = _table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select(
        "l_orderkey", F.col("l_linenumber").alias("emit"), (F.col("l_partkey") % 20).cast("int").alias("start"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("size"), (F.col("l_linenumber") % 3 + 2).cast("int").alias("tier"), F.round(F.col("l_discount"), 2).alias("confidence"))
    finding = F.struct("start", (F.col("start") + F.col("size")).alias("end"), F.lit("c").alias("category"), F.lit("v").alias("value"), "confidence", F.lit("d").alias("detector"), "tier", "emit")
    found = rows.groupBy("l_orderkey").agg(F.collect_list(finding).cast(f"array<{FINDING}>").alias("findings"))
    return found.withColumn("findings", merge_overlaps("findings")).select("l_orderkey", F.explode("findings").alias("f")).select("l_orderkey", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end_"), F.col("f.emit").cast("long").alias("emit"))


def scan_by_category(spark, sf_dir):
    return scan_totals(detect(_docs(spark, sf_dir)))


def scan_by_lang_source(spark, sf_dir):
    return scan_counts(detect(spread(_table(spark, sf_dir, "documents").select("lang", "source", "text"))), "lang", "source")


def gated_scan(spark, sf_dir):
    options = Switches(sensitive_secrets=False, sensitive_network=False)
    return scan_counts(detect(_docs(spark, sf_dir), Settings(options=options, min_confidence=0.6)), "doc_id")


def _replaced(spark, sf_dir):
    found = detect(_docs(spark, sf_dir), _PII)
    fakes = number(first_seen(found, "doc_id"))
    return fakes, replace_findings(found, "doc_id", fakes)


def fake_dictionary(spark, sf_dir):
    return _replaced(spark, sf_dir)[0].select("category", "value", "replacement")


def sanitize_documents(spark, sf_dir):
    return _replaced(spark, sf_dir)[1].select("doc_id", "sanitized", F.size("changes").cast("long").alias("n_changes"))


def change_log_query(spark, sf_dir):
    log = change_log(_replaced(spark, sf_dir)[1], "doc_id")
    return log.select("id", "doc_id", "type", "category", "original", "replacement", *[F.col(c).cast("long").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], "detector")


def restore_roundtrip(spark, sf_dir):
    return restore(_replaced(spark, sf_dir)[1]).select("doc_id", (F.col("restored") == F.col("text")).alias("equal"))


def restore_after_edit(spark, sf_dir):
    """A line put before each text makes every position wrong, so all goes by the text."""
    edited = _replaced(spark, sf_dir)[1].withColumn("sanitized", F.concat(F.lit("new line\n"), "sanitized"))
    return restore(edited).select("doc_id", "restored")


def map_json_roundtrip(spark, sf_dir):
    done = _replaced(spark, sf_dir)[1].withColumn("path", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    log = change_rows(change_log(done, "doc_id", "path").withColumn("language", F.lit("text")))
    files = done.filter(F.size("changes") > 0).select(F.col("doc_id").alias("file_ord"), "path", F.lit("text").alias("language"))
    document = map_document(files, log, "2024-01-01T00:00:00+00:00", "session")
    back = document.select(to_json(document).alias("j")).select(from_json(F.col("j")).alias("m")).select(F.explode("m.changes").alias("c")).select("c.*")
    return back.select("id", "file", "type", "category", "original", "replacement", F.col("start_line").cast("long").alias("start_line"), F.col("start_col").cast("long").alias("start_col"), "scope", "reversible")


def restore_files_query(spark, sf_dir):
    """Files restored from the rows of a map, compared with what they were."""
    done = _replaced(spark, sf_dir)[1].withColumn("path", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    log = change_rows(change_log(done, "doc_id", "path").withColumn("language", F.lit("text")))
    back = restore_files(done.select("path", F.col("sanitized").alias("content")), log)
    return compare_trees(done.select("path", F.col("text").alias("content")), back.select("path", F.col("restored").alias("content")))


def scan_labels(spark, sf_dir):
    """Findings beside the labels of their documents."""
    counts = scan_counts(detect(_docs(spark, sf_dir)), "doc_id")
    return counts.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "category").agg(F.sum("count").alias("count"))


def keyword_terms_query(spark, sf_dir):
    names = _table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" \n\n"), "n_name", F.lit("\r\n")).alias("value"))
    return keyword_terms(names)


def known_terms(spark, sf_dir):
    return _only("word", "org", settings=Settings(known_terms=_TERMS))(spark, sf_dir)


def custom_pattern(spark, sf_dir):
    return _only("shout", settings=Settings(custom_patterns={"shout": r" and [a-z]+ |[A-Z]{3,}"}))(spark, sf_dir)


def fixture_paths(spark, sf_dir):
    rows = detect(_given(spark, PATHS, "id long, text string"), merged=False)
    return exploded(rows, "id").filter("category = 'file_path'").select("id", F.col("start").cast("long").alias("start"), "value")


def extension_language(spark, sf_dir):
    return _given(spark, NAMES, "id long, path string, text string").select("id", by_extension(F.col("path"), F.col("text")).alias("language"))


def shebang_language(spark, sf_dir):
    return _given(spark, FIRST_LINES, "id long, text string").select("id", by_shebang(F.col("text")).alias("language"))


def looks_language(spark, sf_dir):
    return _given(spark, LOOKS, "id long, text string").select("id", by_looks(F.col("text")).alias("language"))


def redact_log(spark, sf_dir):
    return _given(spark, LOGS, "id long, message string, terms array<string>").select("id", redact(F.col("message"), F.col("terms")).alias("message"))


def decode_bytes(spark, sf_dir):
    rows = _given(spark, [(i, bytearray(b)) for i, b in BYTES], "id long, content binary")
    text, fallback = decoded(F.col("content"))
    return rows.select("id", is_binary(F.col("content")).alias("is_binary"), text.alias("text"), fallback.alias("fallback"))


def walk_order(spark, sf_dir):
    rows = _given(spark, FILES, "path string").filter(wanted(F.col("path")))
    return numbered(rows).select("path", "file_ord")


def _code(spark) -> DataFrame:
    return _given(spark, CODE, "file_ord long, path string, content string")


def identifier_catalog(spark, sf_dir):
    from .functions.language import language_of

    return identifiers.catalog(identifiers.collect(_code(spark).withColumn("language", language_of(F.col("path"), F.col("content")))))


def rename_identifiers(spark, sf_dir):
    return sanitize(_code(spark)).files.select("path", "sanitized")


def rename_gated(spark, sf_dir):
    settings = Settings(protected_identifiers=frozenset({"bar"}), options=replace(Switches(), code_variables=False))
    return sanitize(_code(spark), settings).files.select("path", "sanitized")


#: A text for each format of a named secret, of a customer's name as hexadecimal digits ({0}, and in capitals {1}). Spark and DuckDB read them alike.
SECRET_TEXTS = (
    "'id AKIA' || substr({1}, 1, 16) || ' end'", "'id ghp_' || {0} || substr({0}, 1, 8) || ' end'", "'glpat-' || substr({0}, 1, 20)", "'xoxb-' || substr({0}, 1, 12) || ' end'", "'AIza' || {0} || 'abc'",
    "'eyJ' || {0} || '.' || {0} || '.' || substr({0}, 3)", "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {0} || chr(10) || '-----END RSA PRIVATE KEY-----'", "'ssh-rsa ' || {0} || ' me'",
    "'Authorization: Bearer ' || {0}", "'at postgres://u:' || {0} || '@h/db now'", "'DefaultEndpointsProtocol=https;AccountName=a;AccountKey=' || {0}", "'password = ' || {0}",
)
NAMED_SECRETS = (
    "aws_access_key", "github_token", "gitlab_token", "slack_token", "google_api_key", "jwt", "private_key_block", "ssh_public_key", "oauth_bearer_token", "db_connection_string", "azure_connection_string",
    "generic_password_assignment",
)


def secret_texts(key: str, name: str) -> str:
    """SQL for one of the texts, by the key."""
    cases = " ".join(f"WHEN {k} THEN {text.format(f'md5({name})', f'upper(md5({name}))')}" for k, text in enumerate(SECRET_TEXTS))
    return f"CASE {key} % {len(SECRET_TEXTS)} {cases} END"


def named_secrets(spark, sf_dir):
    """Every format of a named secret, in texts made from all customers."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(secret_texts("c_custkey", "c_name")).alias("text"))
    out = exploded(detect(spread(rows), merged=False, only=NAMED_SECRETS), "c_custkey")
    return out.select("c_custkey", "category", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "value", "confidence")


#: Code in three languages for each nation, by its key ({0}).
CODE_OF_NATION = (
    ("js", "function calc{0}(a{0}) {{\n  const total{0} = a{0} + 1;\n  return total{0} / external;\n}}\n"),
    ("ts", "interface Shape{0} {{ }}\nclass Box{0} implements Shape{0} {{ }}\n"),
    ("java", "class Item{0} {{\n    int count{0};\n    int step{0}() {{\n        return count{0};\n    }}\n}}\n"),
)


def rename_code(spark, sf_dir):
    """JavaScript, TypeScript and Java for all nations, renamed across files and restored."""
    key = F.col("n_nationkey").cast("string")
    kind = F.col("n_nationkey") % 3
    text = F.lit("")
    for k, (_, code) in enumerate(CODE_OF_NATION):
        pieces = code.replace("{{", "{").replace("}}", "}").split("{0}")
        text = F.when(kind == k, F.concat(*[x for n, p in enumerate(pieces) for x in ([key] if n else []) + [F.lit(p)]])).otherwise(text)
    suffix = F.element_at(F.array(*[F.lit(x) for x, _ in CODE_OF_NATION]), (kind + 1).cast("int"))
    files = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("file_ord"), F.concat(F.lit("n"), key, F.lit("."), suffix).alias("path"), text.alias("content"))
    done = restore(sanitize(files).files)
    return done.select("path", "language", "sanitized", (F.col("restored") == F.col("content")).alias("equal"))


def folder_roundtrip(spark, sf_dir):
    """All documents written as files, read as a folder, replaced, written, read and restored from the rows of their map."""
    import uuid

    root = f"{shared_folder(spark)}/folders-{uuid.uuid4().hex}"
    docs = spread(_table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content")))
    write_files(docs, f"{root}/in")
    done = sanitize(load_input(spark, f"{root}/in"), Settings(options=Switches(code_identifiers=False)))
    write_files(done.files.select("path", F.col("sanitized").alias("content")), f"{root}/out")
    back = restore_files(load_folder(spark, f"{root}/out"), change_rows(done.changes))
    same = compare_trees(docs, back.select("path", F.col("restored").alias("content")))
    return same.join(done.files.select("path", F.col("file_ord").cast("long").alias("file_ord")), "path", "left")


def switched_scan(spark, sf_dir):
    """Counts with everything on, without terms of organisations, and with all sensitive values off."""
    out = None
    for name, options in (("all", Switches()), ("no_org", Switches(sensitive_org_project=False)), ("none", Switches(sensitive_info=False))):
        counts = scan_counts(detect(_docs(spark, sf_dir), Settings(options=options, known_terms=_TERMS), merged=False, only=("email", "org", "word")), "doc_id")
        counts = counts.groupBy("category").agg(F.sum("count").alias("count")).select(F.lit(name).alias("switches"), "category", "count")
        out = counts if out is None else out.unionByName(counts)
    return out


def token_entropy(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(entropy(F.col("c_name")), 6).alias("h"))


def stream_scan(spark, sf_dir):
    """Counts by category of a stream over the documents."""
    import uuid

    docs = documents_stream(spark, f"{sf_dir}/documents.parque[t]", _table(spark, sf_dir, "documents").schema)
    name = f"counts_{uuid.uuid4().hex}"
    start_counts(docs, name).awaitTermination()
    return spark.table(name)


QUERIES = {
    "detect_email": _only("email"), "detect_ip": _only("ip_address"), "detect_phone": _only("phone"),
    "detect_url": _only("url", table="pages", key="page_id", column="url"), "detect_page_email": _only("email", table="pages", key="page_id", column="html"),
    "detect_hostname": _only("hostname", table="pages", key="page_id", column="html", settings=_HOSTS),
    "detect_named_secrets": named_secrets, "switched_scan": switched_scan, "rename_code": rename_code, "folder_roundtrip": folder_roundtrip,
    "detect_secret_assignment": _only("generic_secret_assignment"), "detect_entropy": detect_entropy, "detect_known_terms": known_terms, "detect_custom_pattern": custom_pattern,
    "detect_paths_fixture": fixture_paths, "token_entropy": token_entropy, "merged_findings": merged_findings, "merge_fold": merge_fold,
    "scan_by_category": scan_by_category, "scan_by_lang_source": scan_by_lang_source, "scan_labels": scan_labels, "gated_scan": gated_scan, "stream_scan": stream_scan,
    "fake_dictionary": fake_dictionary, "sanitize_documents": sanitize_documents, "change_log": change_log_query,
    "restore_roundtrip": restore_roundtrip, "restore_after_edit": restore_after_edit, "restore_files": restore_files_query, "map_json_roundtrip": map_json_roundtrip,
    "language_heuristic": language_heuristic, "looks_language": looks_language, "extension_language": extension_language, "shebang_language": shebang_language,
    "redact_log": redact_log, "decode_bytes": decode_bytes, "walk_order": walk_order, "keyword_terms": keyword_terms_query,
    "identifier_catalog": identifier_catalog, "rename_identifiers": rename_identifiers, "rename_gated": rename_gated,
}
