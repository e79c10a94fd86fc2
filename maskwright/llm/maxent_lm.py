"""Language-model scoring with a hashed maximum-entropy model.

A text's log10 probability is the sum over its tokens of log P(class | history) + log P(symbol | class, history) + log P(token |
symbol). The first two are softmaxes over hashed features of the two symbols before: the n-grams of them, the skip over the
nearer one, and the same of their classes. A frequent word is a symbol, any other token has the symbol of how it ends
and is told apart from those that end alike by its smoothed share, with one slot for all unseen ones; so all factors sum to one.

Symbols, classes and features are the corpus's own: the number of symbols grows with the cube root of the training text, classes gather
symbols with like neighbours, about the square root of them in each. Every training document counts: token counts are exact, and the gradient of every
round is that of the whole training corpus, because all tokens with the same symbols before them share one row of statistics.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bucket_count, free_shuffles
from .exchange import answer, ask, deliver, pack, unpack
from .words import word_edges, word_hashes

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_STOPS = np.array([chr(c) in ".,;:!?" for c in range(256)])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_END = np.uint64(0x5EED0F0E11D0C5ED)  # stands for the end token among hashes of tokens
_SMOOTH = 0.1
_FLUSH = 3 << 20  # cells that a task gathers before it passes them on
_CHUNKS = 16


class Tokens:
    """The tokens of a batch, one end after each document's words: ``hash``, ``ending`` and ``doc``."""

    def __init__(self, docs: pa.Table):
        texts = docs.column("text").to_pylist()
        n = len(texts)
        buf = b" ".join(texts).translate(_LOWER) + bytes(8)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        text = np.frombuffer(buf, np.uint8)[: len(buf) - 8]
        start, end = word_edges(_BLANK[text])
        own = np.searchsorted(begin, start, side="right") - 1
        last = np.maximum(end - 1 - _STOPS[text[end - 1]], start)  # a stop is no part of the ending
        words = np.bincount(own, minlength=n)
        total = len(start) + n
        at, stop = np.arange(len(start)) + own, np.cumsum(words) + np.arange(n)
        self.n_docs, self.count = n, words + 1
        self.hash = np.empty(total, np.uint64)
        self.hash[at], self.hash[stop] = word_hashes(buf, start, end - start), _END
        self.ending = np.zeros(total, np.uint16)
        self.ending[at] = text[np.maximum(last - 1, start)].astype(np.uint16) << 8 | text[last]
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.count)
        self.train = ~docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool) if n else np.zeros(0, bool)

    def distinct(self, buckets: int):
        """The distinct tokens by bucket, where each token stands among them, and where each bucket begins."""
        values, first, which = np.unique(self.hash, return_index=True, return_inverse=True)
        bucket = (values >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bucket = bucket[order].astype(np.int64)
        head = np.flatnonzero(np.diff(np.append(-1, bucket)))
        return values[order], self.ending[first[order]], rank[which], list(zip(bucket[head].tolist(), head.tolist(), np.append(head[1:], len(bucket)).tolist(), strict=True))


def _count_tokens(asked: list[bytes]) -> tuple[list[bytes], tuple]:
    """Each batch's tokens with their training counts summed over all batches; the tokens, counts and endings of the bucket."""
    sizes = [len(a) // 14 for a in asked]
    values, counts, endings = (np.concatenate([np.frombuffer(a, kind, n, at * n) for a, n in zip(asked, sizes, strict=True)]) for kind, at in (("<u8", 0), ("<u4", 8), ("<u2", 12)))
    unique, first, which = np.unique(values, return_index=True, return_inverse=True)
    summed = np.bincount(which, weights=counts, minlength=len(unique)).astype(np.int64)
    return [x.astype("<i8").tobytes() for x in np.split(summed[which], np.cumsum(sizes)[:-1])], (unique, summed, endings[first].astype(np.int64))


@dataclass(frozen=True)
class Symbols:
    """Which symbol a token has, and how many training tokens and distinct ones share a symbol. 0 is the end, then come words, then endings, the last for all others."""

    words: np.ndarray  # hashes, sorted
    word_symbol: np.ndarray
    ending_symbol: np.ndarray  # by ending
    n_words: int
    held: np.ndarray
    distinct: np.ndarray

    @property
    def n(self) -> int:
        return len(self.held)

    def of(self, tokens: Tokens) -> np.ndarray:
        out = self.ending_symbol[tokens.ending]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, tokens.hash), len(self.words) - 1)
            out = np.where(self.words[at] == tokens.hash, self.word_symbol[at], out)
        return np.where(tokens.hash == _END, 0, out)

    def share(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(token | symbol) of tokens with these training counts."""
        shared = np.log10(count + _SMOOTH) - np.log10(self.held + _SMOOTH * (self.distinct + 1))[symbol]
        return np.where(symbol > self.n_words, shared, 0.0)


def history(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second and the first symbol before each token; before a document stand ends."""
    first, second = np.zeros_like(symbol), np.zeros_like(symbol)
    first[1:], second[2:] = symbol[:-1], symbol[:-2]
    second[first == 0] = 0
    return second, first


def _log_softmax(weights: np.ndarray, features: list[np.ndarray], valid: np.ndarray | None = None) -> np.ndarray:
    logits = weights[features[0]].copy()
    for f in features[1:]:
        logits += weights[f]
    if valid is not None:
        logits[~valid] = -1e30
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _chunks(at: np.ndarray, n: int, step: int = 1 << 14):
    """(a, b, where ``at`` lies in [a, b)) for consecutive ranges of n numbers."""
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.append(np.arange(0, n, step), n)).tolist()
    for k, a in enumerate(range(0, n, step)):
        yield a, min(n, a + step), order[edge[k] : edge[k + 1]]


@dataclass(frozen=True)
class MaxentModel:
    """Both softmaxes over symbols. Rows of the weight tables are hashed features; the first rows of a table are biases."""

    symbol_class: np.ndarray
    slot: np.ndarray  # a symbol's place in its class
    valid: np.ndarray  # (class, slot): whether there is such a symbol
    of_class: np.ndarray  # (rows, classes)
    in_class: np.ndarray  # (rows, slots)

    def _hashed(self, kind: int, value: np.ndarray, first: int) -> np.ndarray:
        h = (value.astype(np.uint64) + np.uint64(kind << 56)) * _MIX[0]
        h = (h ^ (h >> np.uint64(31))) * _MIX[1]
        return (h >> np.uint64(33)).astype(np.int64) % (len(self.of_class) - first) + first

    def class_features(self, second: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Rows for a history: bias, bigram, skip, trigram, and two with classes for symbols."""
        n, c2, c1 = len(self.symbol_class), self.symbol_class[second], self.symbol_class[first]
        named = [first, second, second * n + first, c2 * n + first, c2 * n + c1]
        return [np.zeros_like(first)] + [self._hashed(kind, value, 1) for kind, value in enumerate(named, 1)]

    def symbol_features(self, own: np.ndarray, second: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Rows for a history and the class ``own`` of what follows: bias, bigram, skip, trigram, and the bigram of classes."""
        n, k = len(self.symbol_class), len(self.valid)
        named = [own * n + first, own * n + second, (own * n + second) * n + first, own * n + self.symbol_class[first]]
        return [own] + [self._hashed(kind, value, k) for kind, value in enumerate(named, 11)]

    def log10(self, second: np.ndarray, first: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 P(symbol | history), only over the distinct histories that occur, some at a time."""
        n, k, own = len(self.symbol_class), len(self.valid), self.symbol_class[symbol]
        out = np.empty(len(symbol))
        code = second * n + first
        context, at = np.unique(code, return_inverse=True)
        for a, b, mine in _chunks(at, len(context)):
            out[mine] = _log_softmax(self.of_class, self.class_features(context[a:b] // n, context[a:b] % n))[at[mine] - a, own[mine]]
        pair, at = np.unique(code * k + own, return_inverse=True)
        for a, b, mine in _chunks(at, len(pair)):
            c, h = pair[a:b] % k, pair[a:b] // k
            out[mine] += _log_softmax(self.in_class, self.symbol_features(c, h // n, h % n), self.valid[c])[at[mine] - a, self.slot[symbol[mine]]]
        return out / np.log(10)


def _pack_cells(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells and their counts, small on the wire."""
    import zstandard

    return zstandard.compress(struct.pack("<q", len(cells)) + np.diff(cells, prepend=0).astype("<u8").tobytes() + counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8").tobytes(), 1)


def _unpack_cells(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(payload)
    (n,) = struct.unpack_from("<q", raw)
    kind = "<u4" if len(raw) == 8 + 12 * n else "<u8"
    return np.cumsum(np.frombuffer(raw, "<u8", n, 8).astype(np.int64)), np.frombuffer(raw, kind, n, 8 + 8 * n).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, which = np.unique(cells, return_inverse=True)
    return unique, np.bincount(which, weights=counts, minlength=len(unique)).astype(np.int64)


def _statistics(packed: DataFrame, symbols: Symbols, keep: Scratch, blocks: int) -> DataFrame:
    """``block, payload``: counts of (two symbols before, symbol) over all training tokens; a block holds all that follows its histories.

    A task passes on what it has summed whenever that is ``_FLUSH`` cells; a block then sums what the tasks passed on.
    """
    shared, n = packed.sparkSession.sparkContext.broadcast(symbols), symbols.n

    def passed(parts):
        cells, counts = _summed(parts)
        block = cells // n % blocks
        order = np.argsort(block, kind="stable")
        cells, counts, block = cells[order], counts[order], block[order]
        head = np.flatnonzero(np.diff(np.append(-1, block)))
        made = [(int(block[a]), _pack_cells(cells[a:b], counts[a:b])) for a, b in zip(head.tolist(), np.append(head[1:], len(block)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["block", "payload"])

    def gather(batches):
        parts, size = [], 0
        for rows in batches:
            for docs in rows.column("docs").to_pylist():
                tokens = Tokens(unpack(docs))
                of = shared.value.of(tokens)
                second, first = history(of)
                cells, counts = np.unique(((second * n + first) * n + of)[tokens.train[tokens.doc]], return_counts=True)
                if len(cells):
                    parts.append((cells, counts))
                    size += len(cells)
                if size > _FLUSH:
                    yield passed(parts)
                    parts, size = [], 0
        if parts:
            yield passed(parts)

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "payload": [_pack_cells(*_summed([_unpack_cells(p) for p in group["payload"]]))]})

    return keep.write(packed.select("docs").mapInArrow(gather, "block int, payload binary").groupBy("block").applyInPandas(total, "block int, payload binary"), "cells")


def _gathered(cells: DataFrame, n: int, width: int = 64) -> np.ndarray:
    """Of each symbol how often it follows and precedes symbols, those hashed into ``width`` places a side."""

    def sides(batches):
        out = np.zeros((n, 2 * width))
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                at, counts = _unpack_cells(payload)
                first, symbol = at // n % n, at % n
                out += np.bincount(symbol * 2 * width + first % width, counts, n * 2 * width).reshape(n, -1)
                out += np.bincount(first * 2 * width + width + symbol % width, counts, n * 2 * width).reshape(n, -1)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], ["payload"])

    total = np.zeros((n, 2 * width))
    for row in cells.mapInArrow(sides, "payload binary").collect():  # one fixed table a task
        total += np.frombuffer(row["payload"], "<f8").reshape(n, -1)
    return total


def classes_of(sides: np.ndarray, most: int) -> np.ndarray:
    """Classes of at most ``most`` symbols with like neighbours: halved along the direction in which they differ most, without chance."""
    half = sides.shape[1] // 2
    like = np.concatenate([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1e-9)) for x in (sides[:, :half], sides[:, half:])], axis=1)
    out, todo, made = np.zeros(len(sides), np.int64), [np.arange(len(sides))], 0
    while todo:
        mine = todo.pop()
        if len(mine) <= most:
            out[mine], made = made, made + 1
            continue
        around = like[mine] - like[mine].mean(axis=0)
        axis = np.linalg.eigh(around.T @ around)[1][:, -1]
        order = mine[np.argsort(np.round(around @ (axis * np.sign(axis[np.argmax(np.abs(axis))])), 9), kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


def _sweep(cells: DataFrame, model: MaxentModel, first: bool) -> dict[int, np.ndarray]:
    """One pass over all statistics: the likelihood of both factors (0), and the features' expected and, the first time, observed counts by chunk of their tables.

    Tasks sum over their blocks, then chunks over tasks; what reaches the driver is one table of each, whatever the corpus.
    """
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def add(table: np.ndarray, features: list[np.ndarray], values: np.ndarray) -> None:
        for f in features:
            order = np.argsort(f, kind="stable")
            head = np.flatnonzero(np.diff(np.append(-1, f[order])))
            table[f[order][head]] += np.add.reduceat(values[order], head)

    def observe(table: np.ndarray, features: list[np.ndarray], which: np.ndarray, column: np.ndarray, counts: np.ndarray) -> None:
        for f in features:
            cell, at = np.unique(f[which] * table.shape[1] + column, return_inverse=True)
            table.reshape(-1)[cell] += np.bincount(at, counts)

    def sweep(batches):
        m = shared.value
        n, k, s = len(m.symbol_class), *m.valid.shape
        expected = [np.zeros(t.shape, np.float32) for t in (m.of_class, m.in_class)]
        seen = [np.zeros(t.shape, np.float32) for t in (m.of_class, m.in_class)] if first else []
        likelihood = np.zeros(2)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                at, counts = _unpack_cells(payload)
                symbol, code = at % n, at // n
                own = m.symbol_class[symbol]
                for f, width, names, columns in ((0, k, code, own), (1, s, code * k + own, m.slot[symbol])):
                    unique, which = np.unique(names, return_inverse=True)
                    for a, b, mine in _chunks(which, len(unique)):
                        name, place = unique[a:b], which[mine] - a
                        if f:
                            h, c = name // k, name % k
                            features, valid = m.symbol_features(c, h // n, h % n), m.valid[c]
                        else:
                            features, valid = m.class_features(name // n, name % n), None
                        likely = _log_softmax(m.in_class if f else m.of_class, features, valid)
                        likelihood[f] += float((likely[place, columns[mine]] * counts[mine]).sum())
                        likely = np.exp(likely) * np.bincount(place, counts[mine], b - a).astype(np.float32)[:, None]
                        add(expected[f], features, likely)
                        if first:
                            observe(seen[f], features, place, columns[mine], counts[mine])
        parts = [(0, likelihood.astype("<f8").tobytes())]
        for kind, tables in enumerate((expected, seen)):
            for f, table in enumerate(tables):
                parts += [(1 + (2 * kind + f) * _CHUNKS + c, piece.astype("<f4").tobytes()) for c, piece in enumerate(np.array_split(table, _CHUNKS))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["part", "payload"])

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind = "<f4" if key[0] else "<f8"
        out = sum(np.frombuffer(p, kind).astype(np.float64) for p in group["payload"])
        return pd.DataFrame({"part": [key[0]], "payload": [out.astype(kind).tobytes()]})

    rows = cells.mapInArrow(sweep, "part int, payload binary").groupBy("part").applyInPandas(total, "part int, payload binary").collect()
    shared.destroy()
    return {r["part"]: np.frombuffer(bytes(r["payload"]), "<f4" if r["part"] else "<f8").astype(np.float64) for r in rows}


class _Climb:
    """Diagonally scaled gradient steps on the penalised likelihood of one weight table; a step that lowered it is taken back and tried at half its length."""

    def __init__(self, weights: np.ndarray, biases: int, ridge: float):
        self.kept = self.weights = weights
        self.biases, self.ridge = biases, ridge
        self.best, self.length, self.step = -np.inf, 0.3, np.zeros_like(weights)

    def move(self, seen: np.ndarray, expected: np.ndarray, likelihood: float) -> None:
        free = self.weights[self.biases :]
        likelihood -= self.ridge / 2 * float(np.square(free, dtype=np.float64).sum())
        if likelihood >= self.best:
            self.best, self.kept, self.length = likelihood, self.weights, min(1.0, self.length * 1.3)
            step = seen - expected
            step[self.biases :] -= self.ridge * free
            self.step = np.clip(step / (np.maximum(expected, 0.2 * seen) + self.ridge), -2, 2)
        else:
            self.length /= 2
        self.weights = (self.kept + self.length * self.step).astype(np.float32)


def train(cells: DataFrame, symbols: Symbols, most_rows: int, rounds: int, ridge: float, tasks: int) -> MaxentModel:
    """Both softmaxes by ``rounds`` of gradient steps over all statistics, from the shares of classes and of symbols in them."""
    n = symbols.n
    cells = cells.coalesce(tasks)
    own = classes_of(_gathered(cells, n), max(2, math.isqrt(n - 1) + 1))
    k = int(own.max()) + 1
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=k)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    valid = np.arange(count.max())[None, :] < count[:, None]
    rows = min(most_rows, max(1 << 12, 1 << (16 * n).bit_length()))
    held = symbols.held + 0.5
    total = np.bincount(own, held, k)
    of_class, in_class = np.zeros((rows, k), np.float32), np.zeros((rows, count.max()), np.float32)
    of_class[0] = np.log(total / total.sum())
    in_class[own, slot] = np.log(held / total[own])
    model = MaxentModel(own, slot, valid, of_class, in_class)
    if not symbols.held.any():
        return model
    climbs, seen = (_Climb(of_class, 1, ridge), _Climb(in_class, k, ridge)), []
    for step in range(rounds):
        got = _sweep(cells, model, not step)
        table = lambda kind, f: np.concatenate([got[1 + (2 * kind + f) * _CHUNKS + c] for c in range(_CHUNKS)]).reshape((of_class, in_class)[f].shape)  # noqa: B023, E731
        seen = seen or [table(1, 0), table(1, 1)]
        for f, climb in enumerate(climbs):
            climb.move(seen[f], table(0, f), float(got[0][f]))
        model = replace(model, of_class=climbs[0].weights, in_class=climbs[1].weights)
        if step % 4 == 3:
            free_shuffles(cells.sparkSession)
    return replace(model, of_class=climbs[0].kept, in_class=climbs[1].kept)


@dataclass(frozen=True)
class Learned:
    """A fitted model with the corpus it came from: packed documents and the training count of each of their tokens."""

    packed: DataFrame
    counts: DataFrame
    buckets: int
    symbols: Symbols
    model: MaxentModel
    total: int
    distinct: int


def learn(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1 << 12, most_rows: int = 1 << 18, rounds: int = 8, ridge: float = 1.0, batch_bytes: int = 8 << 20) -> Learned:
    """Count and fit; see ``score_texts``."""
    spark = docs.sparkSession
    keep = Scratch(spark, "lm")
    packed = pack(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")), keep, batch_bytes)
    n_batches, n_bytes = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = bucket_count(spark, n_batches, 4)
    most = min(most_words, max(64, 1 << max(0, round(math.log2(max(1.0, n_bytes / 6)) / 3))))  # the cube root of about as many words

    def tokens_of(table: pa.Table, _: dict):
        tokens = Tokens(table)
        values, endings, which, heads = tokens.distinct(buckets)
        counts = np.bincount(which[tokens.train[tokens.doc]], minlength=len(values))
        for bucket, a, b in heads:
            yield bucket, values[a:b].astype("<u8").tobytes() + counts[a:b].astype("<u4").tobytes() + endings[a:b].astype("<u2").tobytes()

    asked = keep.write(ask(packed.drop("size"), tokens_of), "asked")
    counts = keep.write(answer(asked, lambda questions: _count_tokens(questions)[0]), "counts")

    def summary(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: the words that can be among the most frequent, and counts by ending; at most one row an ending."""
        unique, summed, endings = _count_tokens(group["payload"].tolist())[1]
        known = summed > 0
        unique, summed, endings = unique[known], summed[known], endings[known]
        top = np.argsort(-summed, kind="stable")[: most + 1]
        kinds = np.unique(endings)
        where = np.searchsorted(kinds, endings)
        return pd.concat([
            pd.DataFrame({"token": unique[top].view(np.int64), "ending": endings[top], "n": summed[top], "v": 1}),
            pd.DataFrame({"token": pd.array([None] * len(kinds), "Int64"), "ending": kinds, "n": np.bincount(where, weights=summed, minlength=len(kinds)).astype(np.int64), "v": np.bincount(where, minlength=len(kinds))}),
        ])

    told = keep.write(asked.groupBy("bucket").applyInPandas(summary, "token long, ending int, n long, v long"), "told")
    keep.drop("asked")
    free_shuffles(spark)
    endings = [tuple(r) for r in told.filter("token IS NULL").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy(F.desc("n"), "ending").collect()]  # two bytes: 65,536 at most
    frequent = [tuple(r) for r in told.filter("token IS NOT NULL").select("token", "ending", "n").orderBy(F.desc("n"), "token").limit(most + 1).collect()]
    end = int(_END.astype(np.int64))
    of_end = told.filter(F.col("token") == end).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    total, distinct = sum(e[1] for e in endings), sum(e[2] for e in endings)
    frequent = [f for f in frequent if f[0] != end][:most]
    n_words, n_endings = len(frequent), most
    n = 1 + n_words + n_endings
    held, kinds, ending_symbol = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(1 << 16, n - 1, np.int64)
    rest = {e: [n_, v] for e, n_, v in endings}
    if of_end:
        rest[0] = [rest[0][0] - of_end, rest[0][1] - 1]
        held[0], kinds[0] = of_end, 1
    for k, (_, e, n_) in enumerate(frequent, 1):
        held[k], kinds[k] = n_, 1
        rest[e] = [rest[e][0] - n_, rest[e][1] - 1]
    for k, e in enumerate(sorted(rest, key=lambda e: (-rest[e][0], e))[: n_endings - 1], 1 + n_words):
        ending_symbol[e] = k
    for e, (n_, v) in rest.items():
        held[ending_symbol[e]] += n_
        kinds[ending_symbol[e]] += v
    order = np.argsort(np.array([f[0] for f in frequent], np.int64).view(np.uint64))
    symbols = Symbols(np.array([f[0] for f in frequent], np.int64).view(np.uint64)[order], np.arange(1, n_words + 1)[order], ending_symbol, n_words, held, kinds)
    cells = _statistics(packed, symbols, keep, buckets)
    model = train(cells, symbols, most_rows, rounds, ridge, max(8, buckets // 8))
    free_shuffles(spark)
    return Learned(packed.drop("size"), counts, buckets, symbols, model, total, distinct)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", **fitted) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    held_out: a boolean column; rows where it is true, or null, teach nothing. Tokens are runs of what is not ASCII white
    space, lower-cased A-Z, and one end, told apart by 64-bit hashes. ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's. A null
    or empty text is one end. Without training rows every token is unseen. Repeated rows count each time; an empty table
    gives no rows. Other columns are ignored, whatever their names. A worker holds a batch of ``batch_bytes`` of text, or one longer text, at about 25 bytes of memory for each.

    ``fitted`` goes to ``learn``: ``most_words`` and ``most_rows`` bound the words that are symbols and the rows of the weight tables, and so
    what a worker holds of the model; under those bounds words grow with the cube root of the text, rows with the symbols.
    """
    learned = learn(docs, held_out, id_col, text_col, **fitted)
    total, distinct, buckets = learned.total, learned.distinct, learned.buckets
    shared = docs.sparkSession.sparkContext.broadcast((learned.symbols, learned.model))

    def score(batches):
        symbols, model = shared.value
        whole = np.log10(total + _SMOOTH * (distinct + 1))
        for rows in batches:
            for i in range(len(rows)):
                table = unpack(rows.column("docs")[i].as_py())
                tokens = Tokens(table)
                values, _, which, heads = tokens.distinct(buckets)
                got = {a["bucket"]: a["payload"] for a in rows.column("answers")[i].as_py() or ()}
                count = np.zeros(len(values), np.int64)
                for bucket, a, b in heads:
                    count[a:b] = np.frombuffer(got[bucket], "<i8")
                count = count[which]
                of = symbols.of(tokens)
                n = tokens.n_docs
                likely = model.log10(*history(of), of) + symbols.share(of, count)
                summed = [np.bincount(tokens.doc, weights=x, minlength=n) for x in (count > 0, np.log10(count + _SMOOTH) - whole, likely)]
                yield pa.RecordBatch.from_arrays(
                    [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(tokens.count.astype(np.int64)), pa.array(summed[0].astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(summed[1]), pa.array(summed[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return deliver(learned.packed, learned.counts).mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
