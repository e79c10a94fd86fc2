"""Registered queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import itertools
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", ["op1_warc", "op2_suffix_dedup", "op3_decontaminate", "op8_exact_dedup"])
def test_same_as_sql(spark, name):
    import compare

    from maskwright.llm.queries import ORACLES, QUERIES

    df, want = QUERIES[name](spark, SF), compare.connect(SF).execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert compare.canon(df.columns, df.collect()) == compare.canon(columns, want.fetchall())


def targets(size, source):
    """Brute force: weights 3, 1, 2, repeating, share 150 % of all sizes, none above twice its source."""
    have = Counter()
    for i, n in size.items():
        have[source[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    out, left = {}, 1.5 * sum(have.values())
    while True:
        free = [s for s in have if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * have[s]]
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * have[s]
            left -= out[s]


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def similar_components(texts, least=0.8, words=5):
    """Brute force: components over all pairs at Jaccard ``least`` of sets of case-folded ``words``-word shingles."""
    sets = {i: (lambda w: frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())((t or "").casefold().split()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_pipeline(spark):
    """Every stage against what it is to do with what its predecessor kept."""
    import corpus_pipeline as pipeline
    from maskwright.llm.common import Scratch

    keep, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = keep.write(stage(spark, docs, SF), name)
        seen.append(({r.doc_id: r.text for r in docs.collect()}, docs, out))
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns
    texts, before, after = seen[0]
    assert set(texts) - ids(after) == set()  # all texts here are in some language
    texts, before, after = seen[1]
    assert ids(after) == set(similar_components(texts).values())
    texts, before, after = seen[2]
    grams = {tuple(w[k : k + 8]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words_of(r.text)) for k in range(max(1, len(w) - 7))}
    hit = {i for i, t in texts.items() if (w := words_of(t)) and any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))}
    assert hit and ids(after) == set(texts) - hit
    texts, before, after = seen[3]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    source = {r.doc_id: r.source for r in before.collect()}
    target, taken, often = targets(size, source), Counter(), Counter(r.doc_id for r in after.collect())
    for i, n in often.items():
        taken[source[i]] += n * size[i]
    assert max(often.values()) <= 2
    for s, want in target.items():
        assert abs(taken[s] - want) <= max([1.0] + [size[i] for i in size if source[i] == s]), s
    texts, before, after = seen[4]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == often and sum(r.size for r in rows) == sum(n * (len(texts[i].encode()) + 16) for i, n in often.items())
    assert all(r.text == texts[r.doc_id] and r.source == source[r.doc_id] for r in rows) and set(before.columns) <= set(after.columns)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert pipeline.run(spark, SF).count() == len(rows)


def whole(spark, name, tables="documents"):
    """Rows of a query, and of its table, by id."""
    from maskwright.llm.queries import QUERIES

    rows = QUERIES[name](spark, SF).collect()
    table = {r.doc_id: r for r in spark.read.parquet(f"{SF}/{tables}.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(table)
    return rows, table


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def test_query_4(spark):
    rows, table = whole(spark, "op4_mix_sources")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in table.items()}
    source, taken, have = {i: r.source for i, r in table.items()}, Counter(), Counter()
    want = targets(size, source)
    for i, n in size.items():
        have[source[i]] += n
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], have[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, n in want.items():
        assert abs(taken[s] - n) <= max([1.0] + [size[i] for i in size if source[i] == s]), s


def test_query_5(spark):
    rows, table = whole(spark, "op5_shard")
    total, shards, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (table[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        total[r.shard] += r.size
        shards[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    mean, largest = sum(total.values()) / 40, max(r.size for r in rows)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert all(abs(total[k] - mean) <= 2 * largest for k in range(40))
    assert all(len(x) == 1 for x in groups.values())  # no group of copies here is larger than a shard can take whole


def test_query_6(spark):
    from .test_operators import clusters, simhash

    rows, table = whole(spark, "op6_simhash")
    fps = {i: simhash(r.text) for i, r in table.items()}
    root = clusters(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp:016x}", root[i]) for i, fp in fps.items()}


def test_query_7(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from maskwright.llm.queries import SEPARATOR, VOCABULARY

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    assert SEPARATOR not in ranks.values()
    direct = tiktoken.Encoding("direct", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, table = whole(spark, "op7_token_counts")
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(direct.encode_ordinary(r.text or "")) for i, r in table.items()}


def test_query_9(spark):
    import math

    rows, table = whole(spark, "op9_maxent_lm")
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(LOWER)), None] for i, r in table.items()}
    c = Counter(x for i, t in tokens.items() if crc(i) % 10 for x in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(t), sum(x in c for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
    total = lambda name: sum(r[name] for r in rows if r.held_out)
    assert total("score") > total("base_score")


def test_query_10(spark):
    rows, table = whole(spark, "op10_language_id")
    learned = {r.lang for i, r in table.items() if crc(i) % 5 and r.lang and r.text}
    for r in rows:
        letters = any(x.isalpha() for x in table[r.doc_id].text or "")
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and (r.lang_pred in learned if letters else r.lang_pred == "und")
    own = [r for r in rows if r.held_out and table[r.doc_id].lang and r.lang_pred != "und"]
    assert len(own) > 20 and sum(r.lang_pred == table[r.doc_id].lang for r in own) >= 0.97 * len(own)


def test_pipeline_awkward_rows(spark):
    """Nulls, empty texts, copies and columns named like the operators' own: every stage but the last keeps the columns."""
    import corpus_pipeline as pipeline
    from maskwright.llm.common import Scratch
    from .test_operators import SCHEMA, awkward

    keep, docs = Scratch(spark, "test"), spark.createDataFrame(awkward(), SCHEMA)
    for name in ("lang_pred", "score", "rejected", "component_id", "items", "repeats", "_all", "Size", "document_Size", "shard"):
        docs = docs.withColumn(name, F.lit("x"))
    spoken = {i for i, t, *_ in awkward() if t and len(set(t.split())) > 1}  # a lone odd token may be in no language
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = keep.write(stage(spark, docs, SF), name)
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            kept = out.select("doc_id", "text", "score").collect()
            assert spoken <= {r.doc_id for r in kept} and all(r.text.strip() and r.score == "x" for r in kept)
        docs = out
    assert docs.count() > 0 and docs.filter("document_document_Size = 'x' AND document_shard = 'x' AND _all = 'x' AND size >= 16 AND shard < 40 AND text IS NOT NULL").count() == docs.count()


def test_pipeline_removes_documents_with_one_item(spark):
    """A document that holds one benchmark item, whole or in part, goes; what only shares fewer than eight words stays."""
    import corpus_pipeline as pipeline

    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 20)
    part = item.split()
    texts = {1: f"some words before {item} and after", 2: item.upper(), 3: "of it " + " ".join(part[2:18]), 4: "of it " + " ".join(part[:4]) + " and no more", 5: "nothing at all", 6: None}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.decontamination(spark, docs, SF).collect()} == {4, 5, 6}


def test_pipeline_removes_near_copies(spark):
    """A near copy at Jaccard 0.8 or more of five-word shingles goes however far its majority bits are; one below stays."""
    import corpus_pipeline as pipeline

    words = [f"w{k}" for k in range(204)]  # 200 shingles, of which a changed word inside takes five
    changed = lambda n: " ".join(f"x{k}" if k % 20 == 10 and k < 20 * n else w for k, w in enumerate(words))
    rows = [(1, changed(0)), (2, changed(4)), (3, changed(0).upper()), (4, " ".join(words[:100])), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == [1, 4, 5]


def test_pipeline_near_copies_without_ids(spark):
    """A row without an id goes with the group of a row that has one, and no other row without an id keeps it."""
    import corpus_pipeline as pipeline

    texts = [" ".join(f"{a}{k}" for k in range(30)) for a in "tu"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect()) == [(0, texts[1]), (1, texts[0])]
