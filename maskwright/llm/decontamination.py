"""Benchmark decontamination: one Aho-Corasick automaton of normalised item windows, each text scanned once.

The automaton reads words, not bytes, and lies in flat arrays that are built once and sent once: about 20 bytes a node, with at
most ``n`` nodes for each word of the benchmark. A batch of texts is one sequence of words with a stop between
documents, cut into lanes that all take a step at a time; a lane begins ``n - 1`` words early, so none misses a match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches
from .words import word_edges, word_hashes

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = 2 << 20  # bytes of text whose words are held at once


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word of a text, as offsets in its bytes."""
    folded = text.translate(_FOLD) + bytes(8)
    start, end = word_edges(np.frombuffer(folded, np.uint8)[: len(text)] == 32)
    return start, end, word_hashes(folded, start, end - start)


@dataclass(frozen=True)
class Automaton:
    """States are nodes of the trie of all windows, 0 the root; words are numbers from 1 on, 0 is any word that no window has."""

    vocabulary: np.ndarray  # hashes, sorted: the word after the k-th is number k + 1
    root: np.ndarray  # word -> node
    edges: np.ndarray  # node << 32 | word, sorted, of all other nodes
    child: np.ndarray
    fail: np.ndarray
    window: np.ndarray  # node -> number of the window that ends there, or -1
    shorter: np.ndarray  # node -> the longest proper suffix that is a window, or 0
    length: np.ndarray  # window -> words
    first: np.ndarray  # window -> where its items begin in ``items``
    items: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out, state = self.root[word], state.copy()
        live = np.flatnonzero((state > 0) & (word > 0))
        while len(live) and len(self.edges):
            key = state[live].astype(np.uint64) << np.uint64(32) | word[live].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[live[hit]] = self.child[at[hit]]
            live = live[~hit]
            state[live] = self.fail[state[live]]
            live = live[state[live] > 0]
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def scan(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, window) of every occurrence in a sequence of word numbers."""
        if not len(self.length) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(64, int(len(words) ** 0.5))
        lanes = -(-len(words) // width)
        padded = np.zeros(n - 1 + lanes * width, np.int32)
        padded[n - 1 : n - 1 + len(words)] = words
        steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width + n - 1)[::width].T)
        state, places, nodes = np.zeros(lanes, np.int32), [], []
        for t in range(len(steps)):
            state = self.step(state, steps[t])
            if t >= n - 1 and state.any():  # what ends earlier is the lane before's
                reached = np.flatnonzero((self.window[state] >= 0) | (self.shorter[state] > 0))
                places.append(reached * width + t - (n - 1))
                nodes.append(state[reached])
        place, node = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (places, nodes))
        out_place, out_window = [], []
        while len(node):
            own = self.window[node] >= 0
            out_place.append(place[own])
            out_window.append(self.window[node[own]])
            node = self.shorter[node]
            place, node = place[node > 0], node[node > 0]
        return (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_place, out_window))


def build(items: list[tuple[int, bytes | None]], n: int) -> Automaton:
    """The automaton of all runs of ``n`` words of (item number, text); an item of fewer, but not none, is one run."""
    hashed = [(item, words_of(text)[2]) for item, text in items if text]
    vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
    rows, owner = [np.zeros((0, n), np.int32)], [np.zeros(0, np.int64)]
    for item, h in hashed:
        if len(h):
            number = np.zeros(max(n, len(h)), np.int32)
            number[: len(h)] = np.searchsorted(vocabulary, h) + 1
            rows.append(np.lib.stride_tricks.sliding_window_view(number, n))
            owner.append(np.full(len(rows[-1]), item, np.int64))
    windows, owner = np.concatenate(rows), np.concatenate(owner)
    node, size = np.zeros(len(windows), np.int64), 1
    root, edges, child, parent, last = np.zeros(len(vocabulary) + 1, np.int32), [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int32)]
    levels = [0, 1]
    for depth in range(n):
        live = np.flatnonzero(windows[:, depth] > 0)
        keys, which = np.unique(node[live].astype(np.uint64) << np.uint64(32) | windows[live, depth].astype(np.uint64), return_inverse=True)
        made = np.arange(size, size + len(keys))
        node[live] = made[which]
        word = (keys & np.uint64(0xFFFFFFFF)).astype(np.int32)
        if depth:
            edges.append(keys)
            child.append(made.astype(np.int32))
        else:
            root[word] = made
        parent.append((keys >> np.uint64(32)).astype(np.int64))
        last.append(word)
        size += len(keys)
        levels.append(size)
    parent, last = np.concatenate(parent), np.concatenate(last)
    ends, which = np.unique(node, return_inverse=True)
    window, shorter, fail = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    window[ends] = np.arange(len(ends))
    length = np.zeros(len(ends), np.int64)
    length[which] = (windows > 0).sum(axis=1)
    pairs = np.unique(np.stack([which.astype(np.int64), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(len(ends) + 1))
    auto = Automaton(vocabulary, root, np.concatenate(edges) if edges else np.zeros(0, np.uint64), np.concatenate(child) if child else np.zeros(0, np.int32), fail, window, shorter, length, first, pairs[:, 1])
    for a, b in zip(levels[2:], levels[3:], strict=False):  # a level's failures lead to levels that are done
        fail[a:b] = auto.step(fail[parent[a:b]], last[a:b])
        shorter[a:b] = np.where(window[fail[a:b]] >= 0, fail[a:b], shorter[fail[a:b]])
    return auto


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of (first word, word after the last, byte offsets of both ends), touching ones as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, s, e in sorted(set(runs)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], e)
        else:
            out.append((a, b, s, e))
    return out


def _blocks(texts: list[bytes], n: int):
    """Blocks of about ``_BLOCK`` bytes: (document, offset of its first byte, bytes). A longer text goes in pieces, each from ``n - 1`` words before its own."""
    block, size = [], 0
    for doc, text in enumerate(texts):
        at, left = 0, True
        while left:
            end, back, left = len(text), len(text), len(text) - at > _BLOCK
            most = _BLOCK
            while left:  # a piece ends at a word's end and holds more words than it shares with the next
                gaps = np.flatnonzero(np.frombuffer(text[at : at + most].translate(_FOLD), np.uint8) == 32)
                if len(gaps):
                    start = words_of(text[at : at + int(gaps[-1])])[0]
                    if len(start) >= n:
                        end = at + int(gaps[-1])
                        back = at + int(start[len(start) - (n - 1)]) if n > 1 else end
                        break
                left = at + most < len(text)
                most *= 2
            if block and size + end - at > _BLOCK:
                yield block
                block, size = [], 0
            block.append((doc, at, text[at:end]))
            size += end - at
            at = back
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(auto: Automaton, texts: list[bytes], n: int) -> list[tuple[int, list[tuple[int, int, int, int]], set[int]]]:
    """For each text the number of its words, its merged hit runs and the numbers of its items."""
    n_words, runs, items, reached = [0] * len(texts), {}, {}, [0] * len(texts)
    for block in _blocks(texts, n):
        joined = b" ".join(t for _, _, t in block)
        start, end, hashes = words_of(joined)
        begin = np.cumsum([0] + [len(t) + 1 for _, _, t in block])
        edge = np.searchsorted(start, begin)  # the first word of each part
        own = np.repeat(np.arange(len(block)), np.diff(edge))
        words = np.zeros(len(start) + len(block), np.int32)
        words[np.arange(len(start)) + own] = auto.numbers(hashes)  # a stop after each part
        base = []
        for part, (doc, at, text) in enumerate(block):
            mine = start[edge[part] : edge[part + 1]] - begin[part] + at
            fresh = int(np.searchsorted(mine, reached[doc]))  # the words before were in the piece before
            base.append(n_words[doc] - fresh)
            n_words[doc] += len(mine) - fresh
            reached[doc] = at + len(text)
        place, window = auto.scan(words, n)
        if len(place):
            part = np.searchsorted(edge[:-1] + np.arange(len(block)), place, side="right") - 1
            last = place - part
            head = last - auto.length[window] + 1
            local = edge[:-1][part]
            for p, a, b, k, s, e in zip(part.tolist(), (head - local).tolist(), (last - local).tolist(), window.tolist(), start[head].tolist(), end[last].tolist(), strict=True):
                doc, at, _ = block[p]
                shift = at - int(begin[p])
                runs.setdefault(doc, []).append((base[p] + a, base[p] + b + 1, s + shift, e + shift))
                items.setdefault(doc, set()).update(auto.items[auto.first[k] : auto.first[k + 1]].tolist())
    return [(n_words[d], _merged(runs.get(d, [])), items.get(d, set())) for d in range(len(texts))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), most_item_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated`` after the ``carry`` columns.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z, told apart by 64-bit hashes. A word is hit if it lies in an
    occurrence of ``n`` consecutive words of an item, or of a shorter item whole. ``items`` are the ids, as strings, of items with
    occurring windows (a null id names none), ``spans`` the maximal hit runs as byte offsets in the original UTF-8; a document is
    contaminated by two items or more. Null and empty texts have no words; items without words match nothing; equal items
    all count. An empty benchmark hits nothing, an empty table gives no rows; a very long text is read 2 MB at a time. ``carry`` columns must not bear
    the name of a result column.

    One automaton serves a benchmark of any size up to ``most_item_bytes``; it takes about 30 bytes of a worker's memory for each byte of
    item text (0.5 GB at the bound), so a larger benchmark is refused rather than scanned in part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")).filter("octet_length(text) > 0")
    held = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    if held > most_item_bytes:
        raise ValueError(f"the benchmark holds {held} bytes of text, more than most_item_bytes={most_item_bytes}: raise it if the workers have 30 times that")
    listed = [(r["item"], bytes(r["text"])) for r in items.collect()]
    names = [item for item, _ in listed]
    shared = spark.sparkContext.broadcast((build([(k, text) for k, (_, text) in enumerate(listed)], n), names))
    rows = docs.select(*carry, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))

    def scan(batches):
        auto, named = shared.value
        for batch in batches:
            found = find(auto, batch.column("_text").to_pylist(), n)
            kept = [c for c in batch.schema.names if c != "_text"]
            listed = [sorted({named[k] for k in items if named[k] is not None}) for _, _, items in found]
            made = {
                "n_words": pa.array([f[0] for f in found], pa.int64()), "n_hit": pa.array([sum(b - a for a, b, _, _ in f[1]) for f in found], pa.int64()),
                "items": pa.array(listed, pa.list_(pa.string())), "spans": pa.array([[{"start": s, "end": e} for _, _, s, e in f[1]] for f in found], _SPANS),
            }
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + list(made.values()), kept + list(made))

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "_text") + "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    n_items = F.size("items").cast("long")
    return rows.mapInArrow(scan, out).select(*carry, "doc_id", "n_words", "n_hit", n_items.alias("n_items"), "items", "spans", (n_items >= 2).alias("contaminated"))
