"""Suffix-array de-duplication: every window of 50 bytes that an earlier document also holds is removed.

Suffixes are ordered through 50 bytes only, by most-significant-digit radix passes; the groups that are still equal then
are exactly the repeated windows. To order them in parallel, windows meet in the bucket of the smallest hashed 24-byte gram
inside them (a property of the window's bytes alone, so equal windows always meet), and runs of neighbouring windows
with the same smallest gram travel as one string. A first round finds the grams that only one document has; windows
around those can't repeat and stay at home.

Texts longer than a batch are cut into pieces that each hold the windows that begin in them, so no worker holds more
than a batch of windows; only their spans and bytes meet again at the end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bucket_count, free_shuffles
from .exchange import answer, ask, deliver, pack, unpack

_GRAM = 24
_PIECE = 1 << 19
_SECTIONS = 16  # of a bucket, by the top bits of a gram's hash: what is sorted at once
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _loads(buf: bytes, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from every offset of ``buf`` on, as a view."""
    return np.ndarray((max(0, len(buf) - 7),), kind, buf, strides=(1,))


class Runs:
    """Runs of neighbouring windows with one smallest gram: ``start``, ``n`` windows, ``bucket`` and ``rest`` (32 bits) of the gram's hash."""

    def __init__(self, buf: bytes, off: np.ndarray, depth: int, buckets: int):
        """buf: documents one after the other; off: where they begin, and the end."""
        self.depth = depth
        total, width = len(buf), depth - _GRAM + 1
        begin = np.maximum(off[:-1], off[1:] - (depth - 1))  # from here to their document's end, starts are too near it
        usable = np.ones(total, bool)
        for a, b in zip(begin.tolist(), off[1:].tolist(), strict=True):
            usable[a:b] = False
        words = _loads(buf + bytes(depth + 8))
        parts = []
        for a in range(0, total, _PIECE):
            b = min(total, a + _PIECE)
            ok = usable[a:b]
            if not ok.any():
                continue
            g = b - a + width - 1
            h = words[a : a + g] * _MIX[0] + words[a + 8 : a + 8 + g] * _MIX[1] + words[a + 16 : a + 16 + g] * _MIX[2]
            h ^= h >> np.uint64(31)
            h *= _MIX[3]
            h ^= h >> np.uint64(29)
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(g, dtype=np.uint64)
            span = 1
            while span * 2 <= width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < width:
                low = np.minimum(low[: b - a], low[width - span : width - span + b - a])
            at = np.flatnonzero(ok)
            gram = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(gram) != 0)
            head = np.flatnonzero(new)
            parts.append((at[head] + a, np.diff(np.append(head, len(at))), h[gram[head]]))
        start, n, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        h = (h ^ (h >> np.uint64(32))) * _MIX[4]
        self.start, self.n = start, n
        self.bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        self.rest = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.code = self.bucket.astype(np.uint64) << np.uint64(32) | self.rest


class Batch:
    """The documents of a packed batch as one buffer; those without an id neither lose bytes nor make others lose any."""

    def __init__(self, docs: pa.Table, depth: int, buckets: int):
        self.depth = depth
        self.ids = docs.column("doc_id").to_pylist()
        texts = docs.column("text").to_pylist()
        self.buf = b"".join(texts)
        self.off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
        runs = Runs(self.buf, self.off, depth, buckets)
        doc = np.searchsorted(self.off, runs.start, side="right") - 1
        known = np.array([i is not None for i in self.ids], bool)
        mine = known[doc] if len(doc) else np.zeros(0, bool)
        self.start, self.n, self.code, self.bucket = runs.start[mine], runs.n[mine], runs.code[mine], runs.bucket[mine]
        self.doc = doc[mine]
        self.id = np.array([0 if i is None else i for i in self.ids], np.int64)[self.doc]
        self.unique, self.which = np.unique(self.code, return_inverse=True)
        bucket = (self.unique >> np.uint64(32)).astype(np.int64)
        self.heads = np.flatnonzero(np.diff(np.append(-1, bucket)))
        self.at = dict(zip(bucket[self.heads].tolist(), zip(self.heads.tolist(), np.append(self.heads[1:], len(bucket)).tolist()), strict=True)) if len(bucket) else {}

    def keys(self):
        """(bucket, the rests of its distinct grams, whether more than one document has each)."""
        if not len(self.unique):
            return
        order = np.argsort(self.which, kind="stable")
        head = np.flatnonzero(np.diff(np.append(-1, self.which[order])))
        ids = self.id[order]
        several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
        rest = (self.unique & np.uint64(0xFFFFFFFF)).astype("<u4")
        for bucket, (a, b) in self.at.items():
            yield bucket, rest[a:b].tobytes() + several[a:b].tobytes()

    def strings(self, shared: dict[int, bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray, list[int]]]:
        """Bucket by bucket: the distinct strings of runs around shared grams by section, (string, run) for each run, and how many strings each section has."""
        wanted = np.zeros(len(self.unique), bool)
        for bucket, bits in shared.items():
            a, b = self.at[bucket]
            wanted[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        runs = np.flatnonzero(wanted[self.which]) if len(self.which) else np.zeros(0, np.int64)
        section = ((self.code[runs] & np.uint64(0xFFFFFFFF)) // np.uint64((1 << 32) // _SECTIONS)).astype(np.int64)
        order = np.argsort(self.bucket[runs] * _SECTIONS + section, kind="stable")
        runs, section = runs[order], section[order]
        head = np.flatnonzero(np.diff(np.append(-1, self.bucket[runs])))
        for a, b in zip(head.tolist(), np.append(head[1:], len(runs)).tolist(), strict=False):  # no head, no bucket
            mine, index, which, parts = runs[a:b], {}, [], [0] * _SECTIONS
            for s, n, part in zip(self.start[mine].tolist(), self.n[mine].tolist(), section[a:b].tolist(), strict=True):
                seen = len(index)
                which.append(index.setdefault(self.buf[s : s + n + self.depth - 1], seen))
                parts[part] += len(index) - seen
            yield int(self.bucket[mine[0]]), list(index), np.stack([np.array(which, np.int64), mine], axis=1), parts


def shared_grams(asked: list[bytes]) -> list[bytes]:
    """For each batch, a bit for each of its grams: whether more than one document has it."""
    sizes = [len(a) // 5 for a in asked]
    rest = np.concatenate([np.frombuffer(a, "<u4", n) for a, n in zip(asked, sizes, strict=True)])
    several = np.concatenate([np.frombuffer(a, bool, n, 4 * n) for a, n in zip(asked, sizes, strict=True)])
    values, which = np.unique(rest, return_inverse=True)
    shared = ((np.bincount(which, minlength=len(values)) > 1) | (np.bincount(which[several], minlength=len(values)) > 0))[which]
    return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]


def equal_groups(buf: bytes, start: np.ndarray, depth: int) -> np.ndarray:
    """Group numbers of the suffixes at ``start``, equal exactly if the first ``depth`` bytes are: MSD radix passes of 8 bytes each."""
    words = _loads(buf, ">u8")
    group = np.zeros(len(start), np.int64)
    alive = np.arange(len(start))
    first = 0
    for at in [*range(0, depth - 8, 8), depth - 8]:  # the last digit may reread bytes that are equal anyway
        digit = words[start[alive] + at].astype(np.uint64)
        order = np.lexsort((digit, group[alive])) if at else np.argsort(digit, kind="stable")
        alive, digit = alive[order], digit[order]
        old = group[alive]
        new = np.ones(len(alive), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (old[1:] != old[:-1])
        group[alive] = first + np.cumsum(new)
        first += len(alive)
        head = np.flatnonzero(new)
        alone = np.diff(np.append(head, len(alive))) == 1
        left = np.ones(len(alive), bool)
        left[head[alone]] = False  # a group of one needs no more passes
        alive = alive[left]
        if not len(alive):
            break
    return group


def _pack_strings(strings: list[bytes], least: np.ndarray, most: np.ndarray, parts: list[int]) -> bytes:
    """Strings by section, with the smallest and the largest id that has each."""
    size = np.array([len(t) for t in strings], "<u2")
    return b"".join([struct.pack("<q", len(strings)), np.array(parts, "<u4").tobytes(), least.astype("<i8").tobytes(), most.astype("<i8").tobytes(), size.tobytes(), *strings])


def _lowest(held: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]], depth: int) -> list[tuple[np.ndarray, ...]]:
    """For each message of a section, (id, string, first window, end) of the runs of windows that a smaller id than the string's largest holds."""
    index: dict[bytes, int] = {}
    lowest: list[int] = []
    mine = []
    for raw, size, least, _, at in held:
        which = np.zeros(len(size), np.int64)
        for j, (length, low) in enumerate(zip(size.tolist(), least.tolist(), strict=True)):
            k = index.setdefault(raw[at : at + length], len(lowest))
            at += length
            if k == len(lowest):
                lowest.append(low)
            elif low < lowest[k]:
                lowest[k] = low
            which[j] = k
        mine.append(which)
    if not lowest:
        return [(np.zeros(0, np.int64),) * 4 for _ in held]
    length = np.array([len(t) for t in index], np.int64)
    n = length - depth + 1
    begin = np.cumsum(length) - length
    own = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    group = equal_groups(b"".join(index), begin[own] + inside, depth)
    low = np.array(lowest, np.int64)
    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.diff(np.append(-1, group[order])))
    best = np.empty(len(own), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(low[own[order]], head), np.diff(np.append(head, len(order))))
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (best[1:] != best[:-1])
    head = np.flatnonzero(new)
    end = inside[np.append(head[1:], len(own)) - 1] + 1
    first, low_of, count = inside[head], best[head], np.bincount(own[head], minlength=len(n))
    place = np.cumsum(count) - count
    out = []
    for which, (_, _, _, most, _) in zip(mine, held, strict=True):
        many = count[which]
        string = np.repeat(np.arange(len(which)), many)
        run = np.repeat(place[which] - (np.cumsum(many) - many), many) + np.arange(len(string))
        hit = low_of[run] < most[string]
        out.append((low_of[run[hit]], string[hit], first[run[hit]], end[run[hit]]))
    return out


def earliest(asked: list[bytes], depth: int) -> list[bytes | None]:
    """For each batch: (id, string, first window, end) for the runs of windows that a document with that smaller id holds; a section is sorted at a time."""
    import zstandard

    opened = []
    for packed in asked:
        raw = zstandard.decompress(packed)
        (n,) = struct.unpack_from("<q", raw)
        at = 8 + 4 * _SECTIONS
        edge = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", _SECTIONS, 8)))).astype(np.int64)
        least, most, size = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n), np.frombuffer(raw, "<u2", n, at + 16 * n)
        begin = at + 18 * n + np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        opened.append((raw, edge, least, most, size, begin[edge].tolist()))
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in asked]
    for part in range(_SECTIONS):
        held = [(raw, size[e[part] : e[part + 1]], least[e[part] : e[part + 1]], most[e[part] : e[part + 1]], at[part]) for raw, e, least, most, size, at in opened]
        for out, (low, string, first, end), (_, e, *_) in zip(found, _lowest(held, depth), opened, strict=True):
            if len(low):
                out.append((low, string + e[part], first, end))
    made: list[bytes | None] = []
    for out in found:
        low, string, first, end = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        made.append(struct.pack("<q", len(low)) + low.astype("<i8").tobytes() + string.astype("<u4").tobytes() + first.astype("<u2").tobytes() + end.astype("<u2").tobytes() if len(low) else None)
    return made


def covered(batch: Batch, shared: dict[int, bytes], found: dict[int, bytes]) -> np.ndarray:
    """Which bytes of a batch lie in a window that an earlier document holds."""
    begins, ends = [], []
    for bucket, _, pairs, _ in batch.strings({b: shared[b] for b in found}):
        payload = found[bucket]
        (n,) = struct.unpack_from("<q", payload)
        low = np.frombuffer(payload, "<i8", n, 8)
        string = np.frombuffer(payload, "<u4", n, 8 + 8 * n).astype(np.int64)
        first, end = np.frombuffer(payload, "<u2", 2 * n, 8 + 12 * n).reshape(2, n).astype(np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        count = np.bincount(pairs[:, 0], minlength=int(string.max()) + 1)
        place = np.cumsum(count) - count
        many = count[string]
        which = np.repeat(np.arange(n), many)
        run = pairs[np.repeat(place[string] - (np.cumsum(many) - many), many) + np.arange(len(which)), 1]
        later = low[which] < batch.id[run]
        run, which = run[later], which[later]
        begins.append(batch.start[run] + first[which])
        ends.append(batch.start[run] + end[which] + batch.depth - 1)
    gone = np.zeros(len(batch.buf) + 1, np.int8)
    if begins:
        begin, end = np.concatenate(begins), np.concatenate(ends)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > end[:-1]
        head = np.flatnonzero(new)
        gone[begin[head]] = 1
        gone[end[np.append(head[1:], len(end)) - 1]] = -1  # merged runs never touch, so no place is set twice
        np.cumsum(gone, out=gone)
    return gone[:-1].view(bool)


def _spans(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


_CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rejoin(group: pd.DataFrame) -> pd.DataFrame:
    """A document of its pieces: their spans united over the places where they overlap, and what is left of the text."""
    group = group.sort_values("at")
    text = b"".join(bytes(p)[:n] for p, n in zip(group["piece"], group["own"], strict=True))
    gone = np.zeros(len(text), bool)
    for at, spans in zip(group["at"], group["spans"], strict=True):
        for span in spans:
            gone[at + span["start"] : at + span["end"]] = True
    spans = [{"start": a, "end": b} for a, b in _spans(gone)]
    return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].astype("Int64"), "n_bytes": [len(text)], "n_removed": [int(gone.sum())], "spans": [spans], "kept": [np.frombuffer(text, np.uint8)[~gone].tobytes()]})


def remove_repeats(docs: DataFrame, depth: int = 50, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans, kept``.

    Texts are UTF-8 bytes, null counts as empty. A byte is removed if it lies in a string of ``depth`` bytes (32 at
    least) that also starts in a document with a smaller id; all strings are judged on the input and none crosses documents. ``spans`` are
    the maximal removed runs as byte offsets, ``kept`` the other bytes (which need not be valid UTF-8). Equal ids are not smaller
    than each other; a row with a null id loses nothing and takes nothing. An empty table gives no rows.

    A worker holds one batch of ``batch_bytes`` at a time, at about 14 bytes of memory for each. A longer text is cut into
    pieces of half a batch, which overlap by a window; only when its parts are joined at the end does one worker hold it
    whole, at about four bytes for each. Columns beside id and text are ignored, whatever their names.
    """
    if depth < 32:
        raise ValueError("depth is 32 bytes at least")
    spark = docs.sparkSession
    keep = Scratch(spark, "repeats")
    half = batch_bytes // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    long = F.octet_length("text") > batch_bytes
    whole = pack(rows.filter(~long), keep, batch_bytes)
    at = F.explode(F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(half)))
    pieces = rows.filter(long).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text", at.alias("at"))
    pieces = pieces.select("doc_id", "row", "at", F.substring("text", F.col("at") + 1, F.lit(half + depth - 1)).alias("text"))
    pieces = pack(pieces, keep, batch_bytes, "pieces").withColumn("batch", F.col("batch") + (1 << 60))
    n_pieces = pieces.count()
    packed = whole.unionByName(pieces) if n_pieces else whole
    buckets = bucket_count(spark, whole.count() + n_pieces, 4)

    def grams(table: pa.Table, _: dict):
        yield from Batch(table, depth, buckets).keys()

    def strings(table: pa.Table, shared: dict):
        import zstandard

        batch, squeeze = Batch(table, depth, buckets), zstandard.ZstdCompressor(level=3)
        for bucket, texts, pairs, parts in batch.strings(shared):
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            head = np.flatnonzero(np.diff(np.append(-1, pairs[:, 0])))
            ids = batch.id[pairs[:, 1]]
            yield bucket, squeeze.compress(_pack_strings(texts, np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head), parts))

    def judged(rows):
        """Each batch with the bytes of it that go."""
        for i in range(len(rows)):
            table = unpack(rows.column("docs")[i].as_py())
            batch = Batch(table, depth, buckets)
            shared, found = ({a["bucket"]: a["payload"] for a in rows.column(c)[i].as_py() or ()} for c in ("answers", "found"))
            yield table, batch, covered(batch, shared, found)

    def cut(batches):
        for rows in batches:
            for table, batch, gone in judged(rows):
                n_bytes, n_removed, spans, kept = [], [], [], []
                data = np.frombuffer(batch.buf, np.uint8)
                for a, b in zip(batch.off[:-1].tolist(), batch.off[1:].tolist(), strict=True):
                    own = gone[a:b]
                    n_bytes.append(b - a)
                    n_removed.append(removed := int(np.count_nonzero(own)))
                    spans.append([{"start": s, "end": e} for s, e in _spans(own)] if removed else [])
                    kept.append(data[a:b][~own].tobytes() if removed else batch.buf[a:b])
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    def cut_pieces(batches):
        for rows in batches:
            for table, batch, gone in judged(rows):
                spans = [[{"start": s, "end": e} for s, e in _spans(gone[a:b])] for a, b in zip(batch.off[:-1].tolist(), batch.off[1:].tolist(), strict=True)]
                own = np.minimum(np.diff(batch.off), half)
                yield pa.RecordBatch.from_arrays(
                    [*(table.column(c).combine_chunks() for c in ("doc_id", "row", "at")), pa.array(own, pa.int64()), pa.array(spans, _SPAN), table.column("text").combine_chunks()],
                    ["doc_id", "row", "at", "own", "spans", "piece"],
                )

    shared = keep.write(answer(ask(packed, grams), shared_grams), "shared")
    free_shuffles(spark)
    found = keep.write(answer(ask(deliver(packed, shared), strings), lambda asked: earliest(asked, depth)), "found")
    free_shuffles(spark)
    done = lambda batches: deliver(deliver(batches, shared), found, "found")
    out = done(whole).mapInArrow(cut, _CUT)
    if n_pieces:
        parts = done(pieces).mapInArrow(cut_pieces, "doc_id long, row long, at int, own long, spans array<struct<start:long,end:long>>, piece binary")
        out = out.unionByName(parts.groupBy("row").applyInPandas(_rejoin, _CUT))
    return out
