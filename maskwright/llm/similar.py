"""SimHash near-duplicates at a shingle similarity: candidates, each then held to its exact Jaccard similarity.

Candidates are what the vantage-point trees over fingerprints link. Majority fingerprints of texts at similarity 0.8 differ in
about 10 of 64 bits, too many for any radius that a tree can prune, so texts also become candidates where a band of minima
of their shingles agrees; that finds what the fingerprints leave out.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, free_shuffles, small_batches
from .components import components
from .simhash import fingerprint, link

_PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
#: Two texts at similarity s share a band of ``_ROWS`` minima with chance 1 - (1 - s ** _ROWS) ** _BANDS: at 0.8 all but 1.3e-7.
_BANDS, _ROWS = 40, 5
_SEEDS = np.random.default_rng(11).integers(0, 1 << 32, (2, _BANDS * _ROWS), np.uint64).astype(np.uint32) | np.array([[0], [1]], np.uint32)
_ODD = np.random.default_rng(12).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct hashes, in order, of all runs of ``words`` case-folded words; a shorter text, but not none, is one run."""
    import xxhash

    text, at, hashed = text or b"", 0, []
    while at < len(text):
        end = at + _PIECE
        if end < len(text):  # pieces end at white space, so that long texts need not be split whole
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        found = text[at:end].decode("utf-8", "replace").casefold().split()
        hashed.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
        at = end
    word = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    n = max(1, len(word) - words + 1) if len(word) else 0
    code = np.full(n, min(len(word), words), np.uint64)
    for k in range(min(len(word), words)):
        code = (code ^ word[k : k + n]) * _ODD[k % 64]
        code ^= code >> np.uint64(29)
    return np.unique(code * _ODD[63])


def bands(codes: np.ndarray) -> np.ndarray:
    """One key a band; texts without words have none."""
    import xxhash

    if not len(codes):
        return np.zeros(0, np.int64)
    folded, least = (codes >> np.uint64(32)).astype(np.uint32), np.full(_BANDS * _ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(folded), 1024):
        part = folded[at : at + 1024]
        least = np.minimum(least, ((part[None, :] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]).min(axis=1))
    raw, each = least.tobytes(), 4 * _ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * each : (k + 1) * each], k) for k in range(_BANDS)], np.uint64).view(np.int64)


def _linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect all sets of Jaccard similarity ``least`` or more: each reached set against what none has reached yet."""
    sizes, left, links = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            reached = np.zeros(len(left), bool)
            fits = np.flatnonzero((sizes[left] >= least * sizes[x] - 1e-9) & (sizes[x] >= least * sizes[left] - 1e-9))
            for at in range(0, len(fits), 256):
                some = fits[at : at + 256]
                flat = np.concatenate([sets[i] for i in left[some]])
                hit = sets[x][np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[left[some]])[:-1])))
                reached[some] = common >= least * (sizes[x] + sizes[left[some]] - common) - 1e-9
            links += [(x, int(i)) for i in left[reached]]
            queue += left[reached].tolist()
            left = left[~reached]
    return links


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 4, most: int = 4096, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: ``doc_id, text_hash`` (XXH64 of its text), ``component_id``, the smallest id reachable over texts whose sets of ``words``-word shingles have Jaccard similarity ``least`` or more.

    Texts with equal sets meet as one before any search. Others become candidates where their fingerprints are linked within
    ``radius`` bits or a band of minima agrees, and only pairs whose sets, read whole, reach ``least`` are links. A
    bucket of more than ``most`` texts or ``most_bytes`` of shingles is dealt into pieces by hash and searched as pairs of
    pieces, so a worker holds about two pieces and still every pair of a bucket meets. Texts without
    words are equal to each other and similar to nothing else; null ids never name a component unless all its ids are null; a
    very long text is hashed piece by piece, at 8 bytes a word. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "similar")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import xxhash

        for batch in batches:
            same, sizes, keys, fps = [], [], [], []
            for text in batch.column("_text").to_pylist():
                codes = shingles(text, words)
                same.append(xxhash.xxh64_intdigest(codes.tobytes()))
                sizes.append(len(codes))
                keys.append(bands(codes))
                fps.append(fingerprint(text, words))
            same, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, fps))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), same, pa.array(sizes, pa.int64()), fps, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "same", "n", "fp", "keys"])

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array([shingles(t, words).tobytes() for t in batch.column("_text").to_pylist()], pa.binary())], ["same", "codes"])

    def close(group: pd.DataFrame) -> pd.DataFrame:
        names = group["same"].to_numpy()
        links = _linked([np.frombuffer(c, np.uint64) for c in group["codes"]], least)
        return pd.DataFrame({"u": names[[a for a, _ in links]], "v": names[[b for _, b in links]]}, dtype=np.int64)

    own = keep.write(rows.mapInArrow(scan, f"doc_id {id_type}, text_hash long, same long, n long, fp long, keys array<long>"), "own")
    distinct = keep.write(own.groupBy("same").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("reader"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "distinct")
    worded = distinct.filter("n > 0")
    near = components(keep.write(link(worded.select("fp").distinct(), keep, radius), "near"), keep, "near-cc")
    worded = worded.join(near.hint("merge"), F.col("fp") == F.col("node"), "left")
    keys = F.array_append("keys", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")))
    met = keep.write(worded.select("same", "n", F.explode(keys).alias("key")), "met")
    # buckets of the same texts are searched once: most pairs share several bands
    buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("n"), F.sum(F.xxhash64("same").cast("decimal(38,0)")).alias("sign")).filter("of > 1")
    buckets = buckets.groupBy("of", "n", "sign").agg(F.min("key").alias("key"))
    buckets = keep.write(buckets.select("key", F.greatest(F.ceil(F.col("of") / most), F.ceil(8 * F.col("n") / most_bytes)).cast("long").alias("pieces")), "buckets")
    dealt = met.join(buckets.hint("merge"), "key").select("key", "same", "pieces", F.pmod(F.xxhash64("same"), "pieces").alias("piece"))
    dealt = dealt.select("key", "same", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"), "pieces").filter("pieces = 1 OR piece <> other")
    dealt = keep.write(dealt.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("bucket"), "same"), "dealt")
    keep.drop("met", "buckets")
    needed = dealt.select("same").distinct().join(distinct.select("same", "reader").hint("merge"), "same").select("same", F.col("reader.doc_id").alias("reader"), "reader.text_hash")
    texts = rows.join(needed.hint("merge"), rows["doc_id"].eqNullSafe(needed["reader"]) & (rows["text_hash"] == needed["text_hash"])).select("same", "_text")
    sets = keep.write(texts.mapInArrow(read, "same long, codes binary").dropDuplicates(["same"]), "sets")
    links = keep.write(dealt.join(sets.hint("merge"), "same").groupBy("bucket").applyInPandas(close, "u long, v long"), "links")
    keep.drop("dealt", "sets")
    free_shuffles(spark)
    named = distinct.select("same", "least").join(components(links, keep).hint("merge"), F.col("same") == F.col("node"), "left").select("same", "least", F.coalesce("root", "same").alias("root"))
    named = keep.write(named, "named")
    lowest = keep.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    by_set = keep.write(named.join(lowest.hint("merge"), "root").select("same", "component_id"), "by_set")
    return own.select("doc_id", "text_hash", "same").join(by_set.hint("merge"), "same").select("doc_id", "text_hash", "component_id")
