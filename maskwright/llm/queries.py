"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch, table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .language_id import fit, identify
from .maxent_lm import score_texts
from .mixing import mix_sources
from .repeats import remove_repeats
from .sharding import shard_by_bytes
from .simhash import as_hex, near_duplicates
from .token_files import count_tokens, write_token_files
from .warc import read_archives, write_archives

#: The vocabulary that op7 counts with; a file of ranks and its id for the end of a document.
VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50256


def op1_warc(spark, sf_dir):
    archives = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc-files").path("archives"))
    whole = read_archives(archives).filter("last")
    return whole.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_suffix_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_shard(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        vocabulary = file.read()
    files, roster = write_token_files(table(spark, sf_dir, "documents"), Scratch(spark, "token-files").path("files"), vocabulary, public_tokenizers.PATTERN, SEPARATOR)
    counted = count_tokens(files, SEPARATOR)
    return roster.join(counted.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_maxent_lm(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held_out)


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return identify(docs.select("doc_id", held_out, "text"), model, carry=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_shard": op5_shard,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_language_id": op10_language_id,
}

ORACLES = {
    "op2_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, p, b[p:p + 49] AS g FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)
), f AS (
  SELECT g, min(doc_id) AS first_id FROM w GROUP BY g
), hit AS (
  SELECT doc_id, p, coalesce(max(p + 49) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach
  FROM w JOIN f USING (g) WHERE first_id < doc_id
), run AS (
  SELECT doc_id, p, sum(CASE WHEN p > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit
), span AS (
  SELECT doc_id, min(p) AS s, max(p) + 49 AS e FROM run GROUP BY doc_id, r
), gap AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM span
  UNION ALL SELECT doc_id, coalesce(e, 0) + 1, n FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM span GROUP BY doc_id) USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(hex(b[a:z]), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) WHERE z >= a GROUP BY doc_id
), total AS (
  SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op1_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY html
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (html)
""",
    "op3_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT item, least(8, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 6)), lambda k: array_to_string(w[k:k + least(8, len(w)) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT DISTINCT doc_id, k, dw.n, item FROM dw JOIN win USING (n, g)
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
}
