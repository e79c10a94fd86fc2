"""SQL for DuckDB with the same rows as the queries of that name. RE2 dialect: ASCII classes, no lookbehind."""

from __future__ import annotations

EMAIL = r"\b[\w.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+\b"
URL = r"""\bhttps?://[^\s''"<>]+"""
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PHONE = r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){2,}[a-zA-Z]{2,}\b"
TOKEN = r"\b[A-Za-z0-9+/_=-]{20,}\b"
ASSIGN = r"""(?i:\b(?:secret|token|api_?key|access_?key)\s*[=:]\s*["'']?)"""
SECRET = r"[A-Za-z0-9+/_.=-]{8,}"


def spans(table: str, key: str, column: str, pattern: str, category: str, confidence: float, prefix: str | None = None) -> str:
    """A row for each match: key, category, start, end_, value, confidence. Quotes in patterns are doubled already."""
    full = pattern if prefix is None else f"{prefix}{pattern}"
    lead = "0" if prefix is None else f"length(regexp_extract(m[i], '^({prefix})', 1))"
    return f"""
SELECT {key}, '{category}' AS category, CAST(b + lead AS BIGINT) AS start, CAST(b + length(v) AS BIGINT) AS end_, substr(v, CAST(lead + 1 AS BIGINT)) AS value, CAST({confidence} AS DOUBLE) AS confidence
FROM (
  SELECT {key}, m[i] AS v, {lead} AS lead,
    coalesce(list_sum(list_transform(g[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS b
  FROM (
    SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT {key}, regexp_extract_all({column}, '{full}') AS m, regexp_split_to_array({column}, '{full}') AS g FROM {table})
  )
)"""


def values(rows: list[tuple], columns: str, name: str = "t") -> str:
    """A VALUES list of ints, strings, None and lists of strings."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "CAST([" + ", ".join(one(x) for x in v) + "] AS VARCHAR[])"
        return str(v)

    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in row) + ')' for row in rows)}) AS {name}({columns})"


#: Personal data and networks of documents, before the merge, in order of emission.
_RAW = " UNION ALL ".join(
    f"SELECT doc_id, category, start, end_, value, confidence, {tier} AS tier, {emit} AS emit FROM ({sql})"
    for emit, tier, sql in (
        (1, 4, spans("documents", "doc_id", "text", EMAIL, "email", 0.85)),
        (2, 4, spans("documents", "doc_id", "text", URL, "url", 0.8)),
        (3, 4, spans("documents", "doc_id", "text", IP, "ip_address", 0.8)),
        (4, 4, spans("documents", "doc_id", "text", PHONE, "phone", 0.55)),
    )
)
_ALL = (
    f"SELECT doc_id, category, start, end_, value, confidence, 4 AS tier, 0 AS emit FROM ({spans('documents', 'doc_id', 'text', SECRET, 'generic_secret_assignment', 0.7, ASSIGN)}) UNION ALL {_RAW} UNION ALL "
    f"SELECT doc_id, category, start, end_, value, confidence, 4 AS tier, 5 AS emit FROM ({spans('documents', 'doc_id', 'text', DOMAIN, 'hostname', 0.6)}) WHERE list_has_any(string_split(lower(value), '.'), ['com', 'example'])"
)


def folded(raw: str, key: str, fields: str = "s BIGINT, e BIGINT, t BIGINT, c DOUBLE, emit BIGINT, category VARCHAR, value VARCHAR") -> str:
    """The merge as a fold over singleton lists. raw: key, start, end_, tier, confidence, emit, category, value."""
    return f"""
SELECT {key}, unnest(list_reduce(all_, lambda acc, f:
  CASE WHEN len(list_filter(acc, lambda k: k.s < f[1].e AND f[1].s < k.e)) = 0 THEN list_concat(acc, f)
    WHEN {{'t': f[1].t, 'l': f[1].e - f[1].s, 'c': f[1].c}} > list_max(list_transform(list_filter(acc, lambda k: k.s < f[1].e AND f[1].s < k.e), lambda k: {{'t': k.t, 'l': k.e - k.s, 'c': k.c}}))
      THEN list_concat(list_filter(acc, lambda k: NOT (k.s < f[1].e AND f[1].s < k.e)), f)
    ELSE acc END)) AS f
FROM (
  SELECT {key}, list([CAST({{'s': start, 'e': end_, 't': tier, 'c': confidence, 'emit': emit, 'category': category, 'value': value}} AS STRUCT({fields}))] ORDER BY start, emit) AS all_
  FROM ({raw}) GROUP BY {key}
)"""


_MERGED_PII = f"SELECT doc_id, f.s AS start, f.e AS end_, f.category AS category, f.value AS value FROM ({folded(_RAW, 'doc_id')})"
_EVERY = (
    f"SELECT doc_id, f.s AS start, f.e AS end_, f.category AS category, f.value AS value FROM ("
    + folded(f"SELECT doc_id, category, start, end_, value, confidence, 4 AS tier, 0 AS emit FROM ({spans('documents', 'doc_id', 'text', SECRET, 'generic_secret_assignment', 0.7, ASSIGN)}) UNION ALL {_RAW}", "doc_id")
    + ")"
)
_TEMPLATE = "CASE category WHEN 'email' THEN 'user' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '@example.com' WHEN 'ip_address' THEN '10.0.0.' || n WHEN 'url' THEN 'https://fake-service' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '.local' ELSE 'Phone' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END"
_FAKES = f"""
merged AS ({_MERGED_PII}),
seen AS (SELECT category, value, min((doc_id, start)) AS first_at FROM merged GROUP BY ALL),
numbered AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY first_at, value) AS n FROM seen),
fakes AS (SELECT category, value, {_TEMPLATE} AS replacement FROM numbered),
pieces AS (
  SELECT d.doc_id, text, list({{'s': start, 'e': end_, 'r': replacement, 'c': category, 'v': value}} ORDER BY start) AS f
  FROM documents d JOIN merged USING (doc_id) JOIN fakes USING (category, value) GROUP BY ALL
),
heads AS (
  SELECT doc_id, text, f, list_transform(range(1, len(f) + 1), lambda i: text[(CASE WHEN i = 1 THEN 0 ELSE f[i - 1].e END) + 1 : f[i].s]) AS h FROM pieces
),
done AS (
  SELECT doc_id, array_to_string(list_transform(range(1, len(f) + 1), lambda i: h[i] || f[i].r), '') || text[f[len(f)].e + 1 :] AS sanitized, len(f) AS n, f, h FROM heads
),
placed AS (
  SELECT doc_id, i, f[i] AS x, array_to_string(list_transform(range(1, i), lambda j: h[j] || f[j].r), '') || h[i] AS before FROM (SELECT doc_id, f, h, unnest(range(1, len(f) + 1)) AS i FROM done)
),
changes AS (
  SELECT 'chg_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, i) AS VARCHAR), 6, '0') AS id, doc_id,
    CASE x.c WHEN 'url' THEN 'url' ELSE 'pii' END AS type, x.c AS category, x.v AS original, x.r AS replacement,
    CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) AS start_line,
    CAST(length(string_split(before, chr(10))[-1]) + 1 AS BIGINT) AS start_col,
    CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) AS end_line,
    CAST(length(string_split(before, chr(10))[-1]) + length(x.r) + 1 AS BIGINT) AS end_col, 'regex' AS detector
  FROM placed
)"""


def _looks(column: str) -> str:
    cases = (
        (r"(?m)^\s*def\s+\w+\s*\(.*\)\s*:", "python"), (r"(?m)^\s*(import|class)\s+[\w.]+.*;\s*$", "java"), (r"(?m)^\s*package\s+\w+", "go"), (r"\bfn\s+\w+\s*\(", "rust"),
        (r"\bfunction\s+\w+\s*\(|=>\s*\{", "javascript"), (r"(?mi)^\s*SELECT\s+.+\s+FROM\s+", "sql"), (r"(?m)^\s*[\w.-]+:\s+\S", "yaml"), (r"(?m)^#{1,6}\s+\S", "markdown"),
    )
    bare = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    whens = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in cases)
    return f"CASE WHEN {bare} = '' THEN 'text' WHEN {bare}[1] IN ('{{', '[') AND {bare}[-1] IN (']', '}}') THEN 'json' WHEN {bare}[1] = '<' THEN 'xml' {whens} ELSE 'text' END"


#: Named secrets as RE2 reads them: category, confidence, what may come before, the value. Quotes are doubled.
_NAMED = (
    ("aws_access_key", 0.95, None, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), ("github_token", 0.95, None, r"\bgh[opsur]_[0-9A-Za-z]{36,}\b"), ("gitlab_token", 0.95, None, r"\bglpat-[-\w]{20,}"),
    ("slack_token", 0.95, None, r"\bxox[abprs]-[-0-9A-Za-z]{10,}"), ("google_api_key", 0.95, None, r"\bAIza[-\w]{35}"), ("jwt", 0.9, None, r"\beyJ[-\w]+\.[-\w]+\.[-\w]+"),
    ("private_key_block", 0.95, None, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\w+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"), ("ssh_public_key", 0.9, None, r"\bssh-(?:rsa|dss|ed25519) [0-9A-Za-z+/]{20,}={0,3}"),
    ("oauth_bearer_token", 0.8, r"\b[Bb]earer\s+", r"[\w.~+/-]{16,}=*"), ("db_connection_string", 0.9, None, r"""\b(?:postgresql|postgres|mysql|mongodb|redis|amqp)(?:\+[a-z0-9]+)?://[^\s''"<>]+"""),
    ("azure_connection_string", 0.95, None, r"""DefaultEndpointsProtocol=https?;AccountName=[^;\s]+;AccountKey=[^;\s''"]+"""),
    ("generic_password_assignment", 0.75, r"""(?i:\b(?:password|passwd|pwd)\s*[=:]\s*["'']?)""", r"""[^\s"'']{4,}"""),
)


def _renamed() -> str:
    """The code of every nation with the names that files in order of their keys would get."""
    pad = lambda n: f"lpad(CAST({n} AS VARCHAR), 3, '0')"
    rank = lambda kinds: f"count(*) FILTER (n_nationkey % 3 IN ({kinds})) OVER (ORDER BY n_nationkey)"
    return f"""
WITH n AS (
  SELECT n_nationkey AS k, {rank('0, 2')} AS fn, {rank('1, 2')} AS cls, {rank('1')} AS iface,
    2 * {rank('0')} + {rank('2')} AS var FROM nation
)
SELECT 'n' || k || '.' || ['js', 'ts', 'java'][k % 3 + 1] AS path, ['javascript', 'typescript', 'java'][k % 3 + 1] AS language, true AS equal,
  CASE k % 3
    WHEN 0 THEN 'function fn' || {pad('fn')} || '(var' || {pad('var - 1')} || ') {{' || chr(10) || '  const var' || {pad('var')} || ' = var' || {pad('var - 1')} || ' + 1;' || chr(10) || '  return var' || {pad('var')} || ' / external;' || chr(10) || '}}' || chr(10)
    WHEN 1 THEN 'interface Iface' || {pad('iface')} || ' {{ }}' || chr(10) || 'class Cls' || {pad('cls')} || ' implements Iface' || {pad('iface')} || ' {{ }}' || chr(10)
    ELSE 'class Cls' || {pad('cls')} || ' {{' || chr(10) || '    int var' || {pad('var')} || ';' || chr(10) || '    int fn' || {pad('fn')} || '() {{' || chr(10) || '        return var' || {pad('var')} || ';' || chr(10) || '    }}' || chr(10) || '}}' || chr(10)
  END AS sanitized
FROM n"""


def build() -> dict[str, str]:
    from . import queries as q

    made = f"(SELECT c_custkey, {q.secret_texts('c_custkey', 'c_name')} AS text FROM customer)"
    named = " UNION ALL ".join(f"SELECT * FROM ({spans(made, 'c_custkey', 'text', pattern, category, confidence, prefix)})" for category, confidence, prefix, pattern in _NAMED)

    count = "CAST(count(*) AS BIGINT) AS count"
    h = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -((length({0}) - length(replace({0}, c, ''))) / length({0})) * log2((length({0}) - length(replace({0}, c, ''))) / length({0}))))"
    terms = " UNION ALL ".join(f"SELECT doc_id, category, start, end_, value, confidence FROM ({spans('documents', 'doc_id', 'text', t, c, 0.95)})" for t, c in q._TERMS.items())
    entropy = f"SELECT *, {h.format('value')} AS h FROM ({spans('documents', 'doc_id', 'text', TOKEN, 'high_entropy_string', 0)})"
    return {
        "detect_email": spans("documents", "doc_id", "text", EMAIL, "email", 0.85),
        "detect_ip": spans("documents", "doc_id", "text", IP, "ip_address", 0.8),
        "detect_phone": spans("documents", "doc_id", "text", PHONE, "phone", 0.55),
        "detect_url": spans("pages", "page_id", "url", URL, "url", 0.8),
        "detect_page_email": spans("pages", "page_id", "html", EMAIL, "email", 0.85),
        "detect_hostname": f"SELECT * FROM ({spans('pages', 'page_id', 'html', DOMAIN, 'hostname', 0.6)}) WHERE list_contains(string_split(lower(value), '.'), 'example')",
        "detect_secret_assignment": spans("documents", "doc_id", "text", SECRET, "generic_secret_assignment", 0.7, ASSIGN),
        "detect_entropy": f"SELECT doc_id, category, start, end_, value, round(least(0.3 + (h - 3.0) * 0.1, 0.75), 6) AS confidence FROM ({entropy}) WHERE h >= 3.0",
        "detect_known_terms": terms,
        "detect_named_secrets": named,
        "rename_code": _renamed(),
        "folder_roundtrip": """
SELECT coalesce(lang, 'none') || '/d' || doc_id || '.txt' AS path, 'same' AS status, row_number() OVER (ORDER BY coalesce(lang, 'none'), 'd' || doc_id || '.txt') - 1 AS file_ord FROM documents""",
        "switched_scan": f"""
WITH f AS (SELECT category FROM ({terms}) UNION ALL SELECT category FROM ({spans('documents', 'doc_id', 'text', EMAIL, 'email', 0.85)}))
SELECT 'all' AS switches, category, {count} FROM f GROUP BY ALL UNION ALL SELECT 'no_org', category, {count} FROM f WHERE category <> 'org' GROUP BY ALL""",
        "detect_custom_pattern": spans("documents", "doc_id", "text", r" and [a-z]+ |[A-Z]{3,}", "shout", 0.9),
        "detect_paths_fixture": f"SELECT * FROM {values([(1, 5, 'C:' + chr(92) + 'Users' + chr(92) + 'bob' + chr(92) + 'a.txt now'), (2, 4, '/home/bob/x.log'), (3, 0, '/etc/hosts'), (3, 15, '/opt/é/z'), (5, 0, 'D:' + chr(92) + 'one file.txt')], 'id, start, value')}",
        "token_entropy": f"SELECT c_custkey, round({h.format('c_name')}, 6) AS h FROM customer",
        "merged_findings": f"SELECT doc_id, f.category AS category, f.s AS start, f.e AS end_, f.value AS value FROM ({folded(_ALL, 'doc_id')})",
        "merge_fold": "SELECT l_orderkey, f.s AS start, f.e AS end_, f.emit AS emit FROM (" + folded(
            "SELECT l_orderkey, l_partkey % 20 AS start, l_partkey % 20 + l_suppkey % 7 + 1 AS end_, l_linenumber % 3 + 2 AS tier, round(l_discount, 2) AS confidence, l_linenumber AS emit, 'c' AS category, 'v' AS value FROM lineitem", "l_orderkey") + ")",
        "scan_by_category": f"SELECT category, {count} FROM ({_EVERY}) GROUP BY ROLLUP (category)",
        "scan_by_lang_source": f"SELECT lang, source, category, {count} FROM ({_EVERY}) JOIN documents USING (doc_id) GROUP BY ALL",
        "scan_labels": f"SELECT quality, toxic, category, {count} FROM ({_EVERY}) JOIN labels USING (doc_id) GROUP BY ALL",
        "gated_scan": f"SELECT doc_id, category, {count} FROM ({spans('documents', 'doc_id', 'text', EMAIL, 'email', 0.85)}) GROUP BY ALL",
        "stream_scan": f"SELECT category, {count} FROM ({_EVERY}) GROUP BY ALL",
        "fake_dictionary": f"WITH {_FAKES} SELECT category, value, replacement FROM fakes",
        "sanitize_documents": f"WITH {_FAKES} SELECT d.doc_id, coalesce(sanitized, text) AS sanitized, CAST(coalesce(n, 0) AS BIGINT) AS n_changes FROM documents d LEFT JOIN done USING (doc_id)",
        "change_log": f"WITH {_FAKES} SELECT * FROM changes",
        "restore_roundtrip": "SELECT doc_id, true AS equal FROM documents",
        "restore_after_edit": "SELECT doc_id, 'new line' || chr(10) || text AS restored FROM documents",
        "restore_files": "SELECT 'doc' || doc_id AS path, 'same' AS status FROM documents",
        "map_json_roundtrip": f"WITH {_FAKES} SELECT id, 'doc' || doc_id AS file, type, category, original, replacement, start_line, start_col, 'text' AS scope, true AS reversible FROM changes",
        "language_heuristic": f"SELECT 'pages' AS kind, page_id AS id, {_looks('html')} AS language FROM pages UNION ALL SELECT 'documents', doc_id, {_looks('text')} FROM documents",
        "looks_language": f"SELECT * FROM {values([(1, 'text'), (2, 'json'), (3, 'xml'), (4, 'python'), (5, 'java'), (6, 'go'), (7, 'rust'), (8, 'javascript'), (9, 'sql'), (10, 'yaml'), (11, 'markdown'), (12, 'text')], 'id, language')}",
        "extension_language": f"SELECT * FROM {values([(1, 'python'), (2, 'cpp'), (3, 'c'), (4, None), (5, None), (6, 'typescript'), (7, None), (8, 'markdown')], 'id, language')}",
        "shebang_language": f"SELECT * FROM {values([(1, 'python'), (2, 'shell'), (3, 'javascript'), (4, None), (5, None), (6, None)], 'id, language')}",
        "redact_log": f"SELECT id, list_reduce(list_concat([message], terms), lambda m, v: replace(m, v, '[REDACTED]')) AS message FROM {values(q.LOGS, 'id, message, terms')}",
        "decode_bytes": f"SELECT * FROM {values([(1, False, 'plain', False), (3, False, 'café', False), (4, False, 'Muñoz €', True), (5, True, 'bad ' + chr(0xFFFD) + 'ÿ', True), (6, False, '', False)], 'id, is_binary, text, fallback')} UNION ALL SELECT 2, true, 'a' || chr(0) || 'b', false",
        "walk_order": f"SELECT * FROM {values([('b.txt', 0), ('z', 1), ('a/b', 2), ('a/p.PNG', 3), ('a/x.txt', 4), ('a/c/z', 5), ('a.b/y', 6)], 'path, file_ord')}",
        "keyword_terms": "SELECT DISTINCT trim(n_name) AS term, 'org' AS category FROM nation",
        "identifier_catalog": f"SELECT * FROM {values([('RealClass', 'class'), ('go', 'method'), ('self', 'variable'), ('url', 'variable'), ('Cls001', 'class'), ('Foo', 'class'), ('count', 'variable'), ('bar', 'method')], 'name, category')}",
        "rename_identifiers": f"SELECT * FROM {values([(a, b) for a, b in (('a.py', 'class Cls001_001:' + chr(10) + '    def fn001(self, var001):' + chr(10) + '        return var001' + chr(10)), ('b.py', 'class Cls002(Cls001_001):' + chr(10) + '    pass' + chr(10)), ('foo.h', 'class Cls003 {' + chr(10) + 'public:' + chr(10) + '    int var002;' + chr(10) + '    void fn002();' + chr(10) + '};' + chr(10)), ('foo.cpp', 'void Cls003::fn002() { var002 = 1; }' + chr(10)), ('q.sql', 'SELECT Foo FROM bar;' + chr(10)))], 'path, sanitized')}",
        "rename_gated": f"SELECT * FROM {values([(a, b) for a, b in (('a.py', 'class Cls001_001:' + chr(10) + '    def fn001(self, url):' + chr(10) + '        return url' + chr(10)), ('b.py', 'class Cls002(Cls001_001):' + chr(10) + '    pass' + chr(10)), ('foo.h', 'class Cls003 {' + chr(10) + 'public:' + chr(10) + '    int count;' + chr(10) + '    void bar();' + chr(10) + '};' + chr(10)), ('foo.cpp', 'void Cls003::bar() { count = 1; }' + chr(10)), ('q.sql', 'SELECT Foo FROM bar;' + chr(10)))], 'path, sanitized')}",
    }
