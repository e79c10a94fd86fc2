"""SimHash near-duplicates: exact links within a Hamming radius through vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // blocks`` bits in one of
``blocks`` blocks of bits. So there is one tree a block, over the metric of that block, searched with that smaller radius, which
the triangle inequality prunes far better than the whole radius over all 64 bits.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, small_batches
from .components import components

_PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of all runs of ``words`` words; 0 for a text without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    text, at, carried, ones, n = text or b"", 0, [], np.zeros(64, np.int64), 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):  # pieces end at white space, so that long texts need not be split whole
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        found = carried + text[at:end].lower().split()
        at = end
        if len(found) >= words:
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
            for k in range(0, len(hashed), 8 << 16):
                bits = np.unpackbits(np.frombuffer(hashed[k : k + (8 << 16)], np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashed) // 8
        carried = found[-(words - 1) :] if words > 1 else []
    if not n:
        return int.from_bytes(digest(b" ".join(carried), seed), "big") if carried else 0
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, ``doc_id`` and ``fp``, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))

    def scan(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(made)], [*names, "fp"])

    return rows.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text") + ", fp long")


def _masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _threshold(d: np.ndarray, radius: int) -> tuple[int, int]:
    """The distance that splits best, and the size of its larger side; the right side begins ``radius`` before the left ends."""
    seen = np.bincount(d, minlength=66)
    left = np.cumsum(seen)
    sizes = [(max(int(left[m]), int(len(d) - (left[m - radius] if m >= radius else 0))), m) for m in range(64)]
    size, m = min(sizes)
    return m, size


def grow(sample: np.ndarray, mask: int, radius: int, depth: int, leaves: list[int]) -> tuple | int:
    """A vantage-point tree over a block of bits: (vantage point, threshold, left, right), or the number of a leaf."""
    if depth > 0 and len(sample) > 1:
        best = None
        for point in sample[:: max(1, len(sample) // 8)][:8]:
            d = np.bitwise_count((sample ^ point) & np.uint64(mask)).astype(np.int64)
            m, size = _threshold(d, radius)
            if best is None or size < best[0]:
                best = (size, int(point), m, d)
        size, point, m, d = best
        if size < 0.95 * len(sample):
            return point, m, grow(sample[d <= m], mask, radius, depth - 1, leaves), grow(sample[d > m - radius], mask, radius, depth - 1, leaves)
    leaves.append(len(leaves))
    return leaves[-1]


def route(node: tuple | int, mask: int, radius: int, fps: np.ndarray, into: list) -> None:
    """Deal fingerprints to leaves. What lies within the radius of a boundary goes to both sides, so every close pair meets."""
    if not len(fps):
        return
    if isinstance(node, int):
        into.append((node, fps))
        return
    point, m, left, right = node
    d = np.bitwise_count((fps ^ np.uint64(point)) & np.uint64(mask))
    route(left, mask, radius, fps[d <= m], into)
    route(right, mask, radius, fps[d.astype(np.int64) > m - radius], into)


def _linked(fps: np.ndarray, radius: int, out: list) -> None:
    """Links that connect all distinct fingerprints within the radius: rings around a seed, each against what no ring has reached yet."""
    left = fps
    while len(left) > 1:
        seed, left = left[0], left[1:]
        near = np.bitwise_count(left ^ seed) <= radius
        if not near.any():
            continue
        ring, left = left[near], left[~near]
        out.append((seed, ring))
        while len(ring) and len(left):
            reached = np.zeros(len(left), bool)
            for at in range(0, len(ring), step := max(1, (1 << 20) // len(left))):
                reached |= (np.bitwise_count(ring[at : at + step, None] ^ left[None, :]) <= radius).any(axis=0)
            ring, left = left[reached], left[~reached]
            if len(ring):
                out.append((seed, ring))


def search(fps: np.ndarray, masks: tuple[tuple[int, int], ...], radius: int, out: list, least: int = 768) -> None:
    """Links among distinct fingerprints, first splitting by further vantage points where that helps. masks: bits and the radius they are searched with."""
    if len(fps) > least:
        for mask, r in masks:
            best = None
            for point in fps[:: max(1, len(fps) // 3)][:3]:
                d = np.bitwise_count((fps ^ point) & np.uint64(mask)).astype(np.int64)
                m, size = _threshold(d, r)
                if best is None or size < best[0]:
                    best = (size, m, d)
            size, m, d = best
            if size < 0.9 * len(fps):
                search(fps[d <= m], masks, radius, out, least)
                search(fps[d > m - r], masks, radius, out, least)
                return
    _linked(fps, radius, out)


def link(distinct: DataFrame, keep: Scratch, radius: int = 4, blocks: int = 3, sample_rows: int = 50_000, leaf_rows: int = 4096, most_depth: int = 12) -> DataFrame:
    """``u, v``: links among distinct fingerprints (column ``fp``) whose components are those of all pairs within ``radius`` bits.

    The trees are grown from at most ``sample_rows`` fingerprints, which decides how evenly leaves fill, never what is
    found, and have at most ``2 ** most_depth`` leaves, which bounds what goes to the workers; larger leaves are split further
    where they are searched. A leaf gives at most one link for each fingerprint in it, not its pairs.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = min(most_depth, max(0, math.ceil(math.log2(max(1, n) / leaf_rows))))
    masks, small = _masks(blocks), radius // blocks
    share = min(1.0, sample_rows / max(1, n))
    sample = np.array([r["fp"] for r in distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share * (1 << 20)).limit(sample_rows).collect()] if depth else [], np.int64).view(np.uint64)
    trees, first = [], 0
    for mask in masks:
        leaves: list[int] = []
        trees.append((mask, first, grow(sample, mask, small, depth, leaves)))
        first += len(leaves)
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for mask, offset, tree in shared.value:
                into: list = []
                route(tree, mask, small, fps, into)
                for leaf, got in into:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), leaf + offset, np.int32)), pa.array(got.view(np.int64))], ["leaf", "fp"])

    def close(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaf = int(key[0])
        mask = next(m for m, offset, _ in reversed(shared.value) if leaf >= offset)
        out: list = []
        search(np.unique(group["fp"].to_numpy().view(np.uint64)), ((mask, small), ((1 << 64) - 1, radius)), radius, out)
        if not out:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        return pd.DataFrame({"u": np.concatenate([ring for _, ring in out]).view(np.int64), "v": np.concatenate([np.full(len(ring), seed) for seed, ring in out]).view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInPandas(close, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``; the component is the smallest id reachable over fingerprints within ``radius`` bits.

    A text of fewer than ``words`` words is one shingle; without words, as for null, the fingerprint is 0 and links like
    any other. Copies meet as one fingerprint before any search. Repeated rows stay rows; null ids never name a
    component unless all its ids are null; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession, "simhash")
    own = keep.write(fingerprints(docs, id_col, text_col, words), "own")
    distinct = keep.write(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = keep.write(link(distinct, keep, radius), "links")
    roots = components(links, keep)
    named = keep.write(distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    lowest = keep.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    by_fp = keep.write(named.join(lowest.hint("merge"), "root").select("fp", "component_id"), "by_fp")
    return own.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def as_hex(column: str) -> F.Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
