"""Language identification: nearest of several centroids per language over normalised TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, small_batches

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are counted at once; longer texts are counted piece by piece.
_PIECE = 1 << 20
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _codes(text: bytes):
    """24-bit hashes of the 2-, 3- and 4-byte grams of the letters of a text, piece by piece: n and codes."""
    folded = np.frombuffer(b" " + text.translate(_LOWER) + b" ", np.uint8)
    for at in range(0, len(folded), _PIECE):
        b = folded[at : at + _PIECE + 3].astype(np.uint64)
        gram = b[:-1] << np.uint64(8) | b[1:]
        blank = gram == np.uint64(0x2020)
        for n in (2, 3, 4):
            if n > 2:
                gram = gram[:-1] << np.uint64(8) | b[n - 1 :]
                blank = blank[:-1] | ((b[n - 2 : -1] == 32) & (b[n - 1 :] == 32))
            own = min(len(gram), _PIECE)  # grams that begin in this piece
            code = (gram[:own][~blank[:own]] + np.uint64(n)) * _SEEDS[0]
            code = (code ^ (code >> np.uint64(29))) * _SEEDS[1]
            yield n, (code >> np.uint64(40)).astype(np.int64)


def gram_counts(text: bytes, dims: int, wide: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the grams of a text, sparse: slots and counts. ``wide`` gets the codes of the 4-byte grams of each piece with their counts."""
    total = np.zeros(dims, np.int64)
    for n, code in _codes(text):
        total += np.bincount(code % dims, minlength=dims)
        if n == 4 and wide is not None:
            wide.append(np.unique(code, return_counts=True))
    slots = np.flatnonzero(total)
    return slots, total[slots]


def _share(wide: list, known: np.ndarray) -> tuple[int, int]:
    """Of the 4-byte grams of a text, how many are known, and how many there are."""
    return sum(int(n[(known[c >> 3] >> (c & 7)) & 1 == 1].sum()) for c, n in wide), sum(int(n.sum()) for _, n in wide)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of unit length, their languages, and the weight of every slot; a bit for each 4-byte gram that labelled rows share, and the
    least share of such grams by language. Its size depends on ``dims`` and the languages alone."""

    languages: tuple[str, ...]
    centroids: np.ndarray  # (clusters, dims)
    owner: np.ndarray  # cluster -> language
    idf: np.ndarray
    least: float
    known: np.ndarray | None = None  # 2 ** 24 bits
    cutoff: np.ndarray | None = None  # language -> share

    def nearest(self, text: bytes) -> tuple[str, float, bool]:
        """The language of the nearest centroid, its cosine and whether it is rejected; ``und`` and 0 without a common gram."""
        wide: list = []
        slots, counts = gram_counts(text, len(self.idf), wide)
        vector = np.sqrt(counts) * self.idf[slots]
        norm = float(np.sqrt((vector * vector).sum()))
        if not norm or not self.languages:
            return "und", 0.0, True
        near = self.centroids[:, slots] @ (vector / norm)
        best = int(np.argmax(near))
        score = min(1.0, max(0.0, float(near[best])))
        return self.languages[self.owner[best]], score, score < self.least or self._foreign(wide, int(self.owner[best]))

    def _foreign(self, wide: list, language: int) -> bool:
        """Whether the known share of a text is under the cutoff by more than three deviations of a text of its length."""
        if self.known is None:
            return False
        (hits, n), p = _share(wide, self.known), float(self.cutoff[language])
        return hits < p * n - 3 * np.sqrt(n * p * (1 - p))


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts, without chance."""
    centres = [vectors.mean(0)]
    far = vectors @ centres[0]
    centres = [vectors[int(np.argmax(far))]]
    while len(centres) < min(k, len(vectors)):
        near = np.max(vectors @ np.stack(centres).T, axis=1)
        centres.append(vectors[int(np.argsort(near, kind="stable")[len(near) // 10])])  # far, but no outlier
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].mean(0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _familiar(chosen: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """The bits of the 4-byte grams that two sample rows hold, and by language half the median share of held rows among the grams of the rest."""

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in ("code", "rest")], ["code", "rest"])

    def bits(codes: np.ndarray) -> np.ndarray:
        one = np.zeros(1 << 24, np.uint8)
        one[codes] = 1
        return np.packbits(one, bitorder="little")

    counted = chosen.select("held", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(1)).alias("rest")).filter("n > 1").select("code", "rest")
    got = counted.mapInArrow(packed, "code binary, rest binary").collect()
    code, rest = (np.frombuffer(b"".join(bytes(r[c]) for r in got), np.int64) for c in ("code", "rest"))
    shared = chosen.sparkSession.sparkContext.broadcast(bits(code[rest > 1]))

    def shares(batches):
        for batch in batches:
            found = [_share([(np.array(c, np.int64), np.array(n, np.int64))], shared.value) for c, n in zip(batch.column("codes").to_pylist(), batch.column("often").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([h / n if n else None for h, n in found], pa.float64())], ["label", "share"])

    medians = chosen.filter("held").select("label", "codes", "often").mapInArrow(shares, "label string, share double").groupBy("label").agg(F.median("share").alias("share")).filter("share IS NOT NULL").collect()
    return bits(code), {r["label"]: r["share"] / 2 for r in medians}


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", dims: int = 4096, clusters: int = 3, sample_rows: int = 4000, least: float = 0.1, most_languages: int = 1000) -> LanguageModel:
    """Fit from rows with a text and a label.

    Document frequencies, and so the weights of all grams, come from all labelled rows: every task sums what it reads. The
    centroids are clustered on a sample of labelled rows, of at most ``sample_rows`` (the smallest seeded hashes of their ids,
    each language its own share, so that no other label takes a rare one's rows); that bounds what the driver holds to ``sample_rows`` sparse vectors and three centroids a label. More than ``most_languages``
    different labels are refused with a ValueError, since a label left out could never be predicted. Rows without text or label teach nothing.
    ``least`` is the cosine under which a text is rejected as in none of the languages. That cosine grows with the length of any text, so
    there is a second test: the share of 4-byte grams (hashed into 2 ** 24 slots) that two rows of the sample hold. Its cutoff, by language, is half
    the median share of every second sample row among the grams of the others; a language without such rows has none.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).cast("binary").alias("text"))
    per_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(per_label) > most_languages:
        raise ValueError(f"more than {most_languages} labels in {label_col}; raise most_languages")
    if not per_label:
        return LanguageModel((), np.zeros((0, dims), np.float32), np.zeros(0, np.int64), np.zeros(dims), least)

    def document_frequencies(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[gram_counts(text, dims)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "df"])

    summed = rows.select("text").mapInArrow(document_frequencies, "n long, df array<long>").select("n", F.posexplode("df").alias("slot", "df")).groupBy("slot").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).orderBy("slot").collect()
    idf = np.log((1.0 + summed[0]["n"]) / (1.0 + np.array([r["df"] for r in summed]))) + 1.0

    each = max(1, sample_rows // len(per_label))
    seeded = F.xxhash64("id", F.lit(41))
    share = F.create_map(*[x for k, n in per_label.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * each / n)))])[F.col("label")]
    drawn = rows.filter(F.pmod(seeded, F.lit(1_000_003)) < share * 1_000_003)

    def vectors(batches):
        for batch in batches:
            wide: list[list] = [[] for _ in range(len(batch))]
            made = [gram_counts(t, dims, w) for t, w in zip(batch.column("text").to_pylist(), wide, strict=True)]
            codes = [np.unique(np.concatenate([c for c, _ in w])) if w else np.zeros(0, np.int64) for w in wide]
            often = [np.bincount(np.searchsorted(c, np.concatenate([x for x, _ in w])), np.concatenate([n for _, n in w]), len(c)) if len(c) else c for c, w in zip(codes, wide, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"), pa.array([s.astype("<u2").tobytes() for s, _ in made], pa.binary()), pa.array([np.sqrt(c).astype("<f4").tobytes() for _, c in made], pa.binary()), batch.column("id").cast(pa.string()),
                    pa.array(codes, pa.list_(pa.int64())), pa.array([n.astype(np.int64) for n in often], pa.list_(pa.int64())),
                ],
                ["label", "slots", "tf", "id", "codes", "often"],
            )

    keep = Scratch(spark, "language-sample")
    chosen = drawn.mapInArrow(vectors, "label string, slots binary, tf binary, id string, codes array<long>, often array<long>").filter(F.length("slots") > 0)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "slots"))  # of about 1.1 * each rows a label
    chosen = keep.write(chosen.withColumn("place", place).filter(F.col("place") <= each).drop("place"), "rows").withColumn("held", F.pmod(F.xxhash64("id", F.lit(43)), F.lit(2)) == 1)
    known, cutoff = _familiar(chosen)
    sample: dict[str, list] = {k: [] for k in per_label}
    for row in chosen.select("label", "slots", "tf", "id").orderBy(F.xxhash64("id")).toLocalIterator():
        sample[row["label"]].append((bytes(row["slots"]), bytes(row["tf"])))
    centres, owner, languages = [], [], sorted(k for k, v in sample.items() if v)
    for n, language in enumerate(languages):
        dense = np.zeros((len(sample[language]), dims), np.float32)  # one language at a time
        for i, (slots, tf) in enumerate(sample.pop(language)):
            slots = np.frombuffer(slots, "<u2")
            dense[i, slots] = np.frombuffer(tf, "<f4") * idf[slots]
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        found = _cluster(dense, clusters)
        centres.append(found)
        owner += [n] * len(found)
    keep.drop()
    return LanguageModel(tuple(languages), np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, dims), np.float32), np.array(owner, np.int64), idf, least, known, np.array([cutoff.get(k, 0.0) for k in languages]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs``, by default all, with ``lang_pred, score, rejected`` (names a table may not already have).

    ``lang_pred`` is the language of the nearest centroid, ``score`` its cosine; a null text or one without a letter is
    ``und`` with score 0. ``rejected`` marks those, texts whose best cosine is under the model's ``least`` and texts of too few known grams. The
    label, the source and the id are never looked at; whole texts are, empty or very long ones too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kept = docs.columns if carry is None else list(carry)
    rows = docs.select(*kept, F.when(letters, F.col(text_col).cast("binary")).alias("_bytes"))

    def predict(batches):
        model = shared.value
        for batch in batches:
            found = [("und", 0.0, True) if t is None else model.nearest(t) for t in batch.column("_bytes").to_pylist()]
            names = [n for n in batch.schema.names if n != "_bytes"]
            made = {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()), "rejected": pa.array([bool(f[2]) for f in found], pa.bool_())}
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(made.values()), names + list(made))

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    out = StructType(list(docs.select(*kept).schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return rows.mapInArrow(predict, out)
