"""Each operator against a brute-force version on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontamination
from maskwright.llm.common import Scratch
from maskwright.llm.decontamination import decontaminate
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.language_id import fit, identify
from maskwright.llm.maxent_lm import Tokens, learn, score_texts
from maskwright.llm.mixing import fit_lengths, mix_sources
from maskwright.llm.repeats import remove_repeats
from maskwright.llm.sharding import shard_by_bytes
from maskwright.llm.similar import similar_texts
from maskwright.llm.simhash import fingerprint, near_duplicates
from maskwright.llm.token_files import count_tokens, write_token_files
from maskwright.llm.warc import read_archives, write_archives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, gid int, digit string, bytes string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, ties, copies, near copies, and columns whose names clash with the operators' own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "é", "on", "ß", "X"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, passage, long = text(30), text(40), text(20_000)
    rows = []
    for i in range(160):
        t = hot if i % 3 == 0 else text(rng.randint(0, 60))
        if i % 10 == 1:
            t = t + " " + passage + " " + text(4)
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])))
    rows += [(200, None, "en", "a"), (201, "", None, "b"), (202, " \t\n", "fr", None), (203, long, "en", "a"), (204, long + " end", "en", "b"), (205, long, "en", "c"), (206, "a" * 300, "en", "c"), (207, hot.replace(" ", "\n\n"), "en", "a"), (208, "one", "en", "a"), (209, "  one", "en", "a")]
    return [(i, t, lang, source, len(t or ""), 7, 8, "x", "y") for i, t, lang, source in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_exact_dedup(docs, empty):
    got, groups = by_id(exact_dedup(docs, first_width=4, growth=16, max_width=30_000)), defaultdict(list)
    for i, t, *_ in awkward():
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    for norm, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (3, "b")], "doc_id long, text string")
    got = exact_dedup(rows).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == sorted([(False, 4, True)] + [(False, 4, False)] * 3 + [(True, 1, True), (False, 1, True)])


@pytest.mark.parametrize("batch_bytes", [1 << 23, 3000])
def test_repeats(docs, batch_bytes):
    got, seen = by_id(remove_repeats(docs, batch_bytes=batch_bytes)), set()
    for i, t, *_ in awkward():
        b = (t or "").encode()
        own, gone = {b[p : p + 50] for p in range(len(b) - 49)}, bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= own
        r = got[i]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)), i
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(not gone[s.start - 1] for s in r.spans if s.start)


def test_repeats_of_one_text_of_64_mb(spark):
    """A text far beyond a batch goes through in pieces; a passage of it that an earlier document holds is found across their edges."""
    n, passage = 64 << 20, "".join(chr(97 + (k * k + k // 7) % 26) for k in range(5000))
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1 << 20))
    at = (4 << 20) - 2500  # over the edge of the first piece
    body = "".join(f"{k:08d}{long[k % 977 : k % 977 + 16]}" for k in range(n // 24))
    rows = spark.createDataFrame([(1, passage), (2, body[:at] + passage + body[at:]), (3, passage[:49])], "doc_id long, text string")
    got = by_id(remove_repeats(rows))
    assert [(s.start, s.end) for s in got[2].spans] == [(at, at + 5000)] and got[2].n_bytes == len(body) + 5000
    assert bytes(got[2].kept) == body.encode() and got[1].n_removed == got[3].n_removed == 0


def test_repeats_ids(spark, empty):
    t = "abcdefghij" * 6
    got = remove_repeats(spark.createDataFrame([(None, t), (5, t), (5, t), (6, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (6, 60)]
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [2 << 20, 200])
def test_decontaminate(spark, docs, empty, block):
    texts = {i: t for i, t, *_ in awkward()}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    items = [("q1", " ".join(words(texts[1])[:12])), ("q2", "one"), ("q3", None), ("q4", "--"), ("q5", " ".join(words(texts[203])[100:108]).upper()), ("q6", "one"), ("q7", " ".join(words(texts[203])[104:115]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    listed = [(i, t) for i, t in items if t]
    auto, got = decontamination.build([(k, t.encode()) for k, (_, t) in enumerate(listed)], 8), by_id(decontaminate(docs, bench))
    whole, decontamination._BLOCK = decontamination._BLOCK, block
    pieces = dict(zip(texts, decontamination.find(auto, [(t or "").encode() for t in texts.values()], 8), strict=True))
    decontamination._BLOCK = whole
    grams = [(item, w[k : k + min(8, len(w))]) for item, t in items if (w := words(t)) for k in range(max(1, len(w) - 7))]
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
        r = got[i]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (len(w), len(hit), sorted(found), len(found) >= 2), i
        raw = (t or "").encode()
        assert sum(len(words(raw[s.start : s.end].decode())) for s in r.spans) == len(hit)
        n_words, runs, numbers = pieces[i]
        assert (n_words, [(s, e) for *_, s, e in runs], {listed[k][0] for k in numbers}) == (len(w), [(s.start, s.end) for s in r.spans], found)
    assert decontaminate(empty, bench).count() == 0
    assert {r.n_items for r in decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_decontaminate_by_5_mb_of_items(spark):
    """A large benchmark is still one automaton and one scan."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(20_000)]
    items = [(str(k), " ".join(rng.choices(words, k=400))) for k in range(2200)]
    assert sum(len(t) for _, t in items) > 5 << 20
    rows = [(k, " ".join(rng.choices(words, k=30)) + " " + (" ".join(items[7 * k][1].split()[11 : 11 + k]) if k % 2 else "") + " end") for k in range(1, 40)]
    got = by_id(decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")))
    for k, _ in rows:
        assert (got[k]["items"], got[k].n_hit) == (([str(7 * k)], k) if k % 2 and k >= 8 else ([], 0)), k
    with pytest.raises(ValueError):
        decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), most_item_bytes=1000)


def test_fit_lengths():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(0, 40), rng.randint(1, 8))
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 3)
        take = fit_lengths(lengths, counts, budget, window=64)
        total = sum(a * b for a, b in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and total <= budget
        if len(lengths) > 3 and 1 in lengths:
            assert budget - total <= max(lengths)


def test_mixing(docs, empty):
    got, rows = by_id(mix_sources(docs)), awkward()
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    held = Counter()
    for i, _, _, source, *_ in rows:
        held[source] += size[i]
    order = sorted((s for s in held if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(held.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * held[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * held[s] for s in over}
        open_ -= over
    taken = Counter()
    for i, _, _, source, *_ in rows:
        r = got[i]
        assert (r["size"], r.source_size) == (size[i], held[source]) and r.target == pytest.approx(target[source]) and r.taken in (0, size[i], 2 * size[i])
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in ("é", None))
    assert all(0 <= target[s] - taken[s] + 0.5 <= 20_002 for s in order)  # the other sources are mostly one long document
    again = by_id(mix_sources(docs.repartition(5)))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}
    assert mix_sources(empty).count() == 0


def test_sharding(docs, empty):
    got, rows = by_id(shard_by_bytes(docs, 5)), awkward()
    slots, sizes, largest = defaultdict(list), Counter(), 0
    for i, t, *_ in rows:
        r, b = got[i], (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        largest = max(largest, r["size"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert max(sizes.values()) <= sum(sizes.values()) / 5 + 2 * largest
    assert shard_by_bytes(empty).count() == 0


def test_sharding_over_more_ranges(spark, docs):
    """The number of range partitions changes no row's place."""
    one, many = ({(r.doc_id, r.shard, r.slot) for r in shard_by_bytes(docs.filter("doc_id IS NOT NULL"), 3, range_rows=n).collect()} for n in (2_000_000, 4))
    assert {r[:2] for r in one} == {r[:2] for r in many}


def test_sharding_balance(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = [r["s"] for r in shard_by_bytes(rows, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * max(sum(sizes) // 4000, 66)


def test_sharding_keeps_copies_together(spark):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 600).cast("string")).alias("text"), F.lit("x").alias("_hot"))
    rows = rows.unionByName(spark.createDataFrame([(9_000, "long " * 100, "x")], rows.schema))
    got = shard_by_bytes(rows, 40)
    assert got.count() == 6_001
    assert got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def simhash(t):
    import xxhash

    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprint():
    for _, t, *_ in awkward():
        assert fingerprint(None if t is None else t.encode()) == simhash(t)


def clusters(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in fps}


def test_near_duplicates(docs, empty):
    got = by_id(near_duplicates(docs))
    want = clusters({i: simhash(t) for i, t, *_ in awkward()})
    assert {i: r.component_id for i, r in got.items()} == want
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [4096, 2])
def test_similar_texts(spark, docs, empty, most):
    """Planted near copies on either side of 0.8, chains and awkward rows, against all pairs."""
    rng = random.Random(5)
    texts = {i: t for i, t, *_ in awkward()}
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 200]))]
        for step in range(4):
            texts[1000 + 10 * k + step] = " ".join(words).title() if step % 2 else "  ".join(words)
            for _ in range(rng.randint(1, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
    made = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in texts.items() if i >= 1000], "doc_id long, text string"))
    runs = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").casefold().split()) else frozenset() for i, t in texts.items()}
    root = {i: i for i in runs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(runs):
        for b in runs:
            if b > a and 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(similar_texts(made, most=most))
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in runs}
    assert len({find(i) for i in runs if i >= 1000}) < 160 - 40
    assert similar_texts(empty).count() == 0


def test_vantage_point_trees(spark):
    """Chains and clumps of fingerprints, with trees deep enough that boundaries matter."""
    import numpy as np

    from maskwright.llm.components import components
    from maskwright.llm.simhash import link

    rng, fps = random.Random(9), set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    ids = dict(enumerate(sorted(fps)))
    signed = np.array(list(ids.values()), np.uint64).view(np.int64).tolist()
    keep = Scratch(spark, "test")
    links = keep.write(link(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), keep, leaf_rows=16), "links")
    roots = {r.node: r.root for r in components(links, keep).collect()}
    want = clusters(ids)
    sets = lambda named: {frozenset(k for k in named if named[k] == v) for v in set(named.values())}
    assert sets({i: roots.get(x, x) for i, x in enumerate(signed)}) == sets(want)


def test_components(spark):
    from maskwright.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(40)}, 300: 200, 200: 200}


def test_language_id(docs, empty, spark):
    rng, rows = random.Random(1), []
    parts = {"en": ["the", "er", "ing", "wh"], "fr": ["é", "eau", "que", "ou"], "de": ["sch", "ü", "ung", "ei"]}
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows += [(900, None, "en"), (901, "123 --", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(identify(df, fit(df.filter("doc_id % 2 = 0"))))
    for i, t, lang in rows:
        assert got[i].lang_pred == (lang if i < 900 else "und") and 0 <= got[i].score <= 1 and got[i].rejected == (i >= 900)
    none = fit(empty)
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(empty, none).count() == 0
    with pytest.raises(ValueError, match="most_languages"):
        fit(df, most_languages=2)


def test_language_sample_keeps_rare_labels(spark):
    """A label of one document is learned beside abundant ones, also where its id comes last in the order of the sample."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(["the", "er", "ing"]) for _ in range(3)) for _ in range(6)), f"main{i % 30}") for i in range(1320)]
    last = spark.range(5000, 9000).orderBy(F.xxhash64(F.col("id").cast("string")).desc()).first()["id"]
    model = fit(spark.createDataFrame([*rows, (last, "ouou quai eau", "rare")], "doc_id long, text string, lang string"), sample_rows=620)
    assert len(model.languages) == 31 and "rare" in model.languages


def test_language_rejection(spark):
    """Foreign scripts and gibberish are rejected at any length; clean texts are not, short ones neither."""
    import base64

    rng = random.Random(2)
    parts = {"en": ["the", "er", "ing", "wh", "ou"], "fr": ["é", "eau", "que", "ou", "ai"]}
    clean = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(n))
    noise = lambda first, last, n: " ".join("".join(chr(rng.randint(first, last)) for _ in range(rng.randint(3, 9))) for _ in range(n))
    taught = [(i, clean(lang, 40), lang) for i, lang in enumerate(["en", "fr"] * 100)]
    rows = [(1000 + i, clean(lang, n), False) for i, (lang, n) in enumerate((lang, n) for lang in parts for n in (1, 2, 5, 30, 300, 5000))]
    scripts = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0xE01, 0xE2E), (0xAC00, 0xD7A3), (97, 122)]
    rows += [(2000 + i, noise(a, z, n), True) for i, ((a, z), n) in enumerate((s, n) for s in scripts for n in (30, 300, 5000))]
    rows += [(3000, base64.b64encode(rng.randbytes(1000)).decode(), True), (3001, base64.b64encode(rng.randbytes(100_000)).decode(), True)]
    model = fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    got = by_id(identify(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model))
    assert {i: got[i].rejected for i, *_ in rows} == {i: bad for i, _, bad in rows}


def test_language_model(docs, empty):
    rows = awkward()
    held_out = F.col("doc_id") % 5 == 0
    got = by_id(score_texts(docs, held_out, rounds=4))
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for i, t, *_ in rows}
    c = Counter(x for i, t in tokens.items() if i % 5 for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 0, len(t), sum(x in c for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        assert math.isfinite(r.score) and r.score <= 0
    total = lambda name: sum(r[name] for r in got.values() if not r.held_out)
    assert total("score") > total("base_score")
    assert score_texts(empty, held_out).count() == 0
    unseen = score_texts(docs, F.lit(True), rounds=1).collect()
    assert {r.train_tokens for r in unseen} == {0}


def test_language_model_is_what_its_weights_say(docs):
    """Scores against the formula evaluated symbol by symbol in plain Python; every factor sums to one."""
    held_out = F.col("doc_id") % 5 == 0
    learned, got = learn(docs, held_out, rounds=3), by_id(score_texts(docs, held_out, rounds=3))
    symbols, model = learned.symbols, learned.model
    texts = {i: (t or "").translate(LOWER).encode() for i, t, *_ in awkward()}
    split = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", t), None] for i, t in texts.items()}
    count = Counter(x for i, t in split.items() if i % 5 for x in t)
    members = defaultdict(list)
    for s, c in enumerate(model.symbol_class.tolist()):
        members[c].append(s)
    assert max(map(len, members.values())) <= 1 + math.isqrt(symbols.n) and len(members) > 4

    def softmax(table, rows, columns):
        logits = {c: sum(float(table[r, c]) for r in rows) for c in columns}
        total = sum(math.exp(x) for x in logits.values())
        return {c: math.exp(x) / total for c, x in logits.items()}

    seen = {}

    def chances(second, first):
        if (second, first) not in seen:
            one = lambda *x: [np.array([v], np.int64) for v in x]
            classes = softmax(model.of_class, [int(f[0]) for f in model.class_features(*one(second, first))], members)
            out = {}
            for c, mine in members.items():
                slots = softmax(model.in_class, [int(f[0]) for f in model.symbol_features(*one(c, second, first))], [int(model.slot[s]) for s in mine])
                out.update({s: classes[c] * slots[int(model.slot[s])] for s in mine})
            assert sum(out.values()) == pytest.approx(1, abs=1e-4)
            seen[second, first] = out
        return seen[second, first]

    of, kinds = {}, defaultdict(dict)
    for i, words in split.items():
        tokens = Tokens(pa.table({"text": pa.array([texts[i]], pa.binary()), "held_out": [False]}))
        own = symbols.of(tokens).tolist()
        of[i] = own
        for w, s in zip(words, own, strict=True):
            assert (s == 0) == (w is None)
            if count[w]:
                kinds[s][w] = count[w]
    for s, words in kinds.items():
        if 0 < s <= symbols.n_words:
            assert len(words) == 1
    for i in [0, 1, 2, 5, 10, 11, 200, 206, 207]:
        want, past = 0.0, (0, 0)
        for w, s in zip(split[i], of[i], strict=True):
            share = 1.0 if s <= symbols.n_words else (count[w] + 0.1) / (sum(kinds[s].values()) + 0.1 * (len(kinds[s]) + 1))
            want += math.log10(chances(*past)[s] * share)
            past = (past[1], s)
        assert got[i].score == pytest.approx(want, rel=1e-4, abs=1e-3), i


def test_language_model_learns_order(spark):
    """Word order that unigrams cannot see lifts the score of held-out text, and more so after more rounds."""
    rng = random.Random(4)
    after = {f"w{k}": [f"w{(3 * k + d) % 40}" for d in (1, 2)] for k in range(40)}

    def text():
        out = ["w0"]
        while len(out) < 50:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    rows = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    got = [score_texts(rows, F.col("doc_id") % 10 == 0, rounds=n).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first() for n in (1, 8)]
    assert got[1][0] > got[0][0] and (got[1][0] - got[1][1]) / got[1][2] > 0.5


def test_warc(spark):
    big, small = "é<p>\r\n\r\nWARC/1.1\r\n" * 9000, "x" * 99
    rows = [(1, "http://a/é b", big), (2, "http://a/\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", small), (6, "u", small), (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = write_archives(pages, Scratch(spark, "test").path("warc"), archive_bytes=20_000)
    chunks = read_archives(archives, chunk=1000).collect()
    done = sorted((int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in chunks if r.last)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or "")) if len(b) >= 100 else i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else str(first)))
    assert done == sorted(want) and all(r.intact for r in chunks) and max(len(r.data) for r in chunks) == 1000
    one = sorted((r for r in chunks if r.record_id == "1"), key=lambda r: r.chunk_no)
    seen = hashlib.sha256()
    for r in one:  # the digest is that of the payload so far
        seen.update(r.data)
        assert r.payload_digest == seen.hexdigest()
    assert b"".join(bytes(r.data) for r in one) == big.encode()
    nothing = write_archives(pages.limit(0), Scratch(spark, "test").path("warc"))
    assert nothing.count() == 0 and read_archives(nothing).count() == 0


def test_token_files(spark, docs, empty):
    import base64

    vocabulary = b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256))
    files, roster = write_token_files(docs, Scratch(spark, "test").path("tokens"), vocabulary, r"\s+|\S+", 256)
    for block in (1 << 22, 50_000):
        got = {r.doc_id: r.n_tokens for r in roster.join(count_tokens(files, 256, block_bytes=block), ["path", "ordinal"]).collect()}
        assert got == {i: len((t or "").encode()) for i, t, *_ in awkward()}
    none, nobody = write_token_files(empty, Scratch(spark, "test").path("tokens"), vocabulary, r"\s+|\S+", 256)
    assert count_tokens(none, 256).count() == 0 and nobody.count() == 0


def test_token_scan_of_given_files(spark, tmp_path):
    import numpy as np

    np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").touch()
    np.array([1] * 7, "<u2").tofile(tmp_path / "d.bin")
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in sorted(tmp_path.iterdir())], "path string, n_bytes long")
    for block in (2, 4, 6, 1 << 20):
        got = sorted((r.path[-5], r.ordinal, r.n_tokens, r.ended) for r in count_tokens(files, 9, block_bytes=block).collect())
        assert got == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 1, False), ("b", 0, 0, True), ("d", 0, 7, False)]
