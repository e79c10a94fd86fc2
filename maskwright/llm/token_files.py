"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but little-endian 16- or 32-bit token ids, with an end-of-document id after each document. Blocks of fixed
size are searched for that id in parallel; a prefix scan over the blocks of a file stitches the documents that cross them.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, small_batches
from .files import make_folder, open_fs

_MADE: dict = {}


def _encoding(vocabulary: bytes, pattern: str):
    """The tokenizer of a rank file; made once a worker process."""
    key = hash((vocabulary, pattern))
    if key not in _MADE:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _MADE[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]


def write_token_files(docs: DataFrame, folder: str, vocabulary: bytes, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", kind: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Tokenise all texts into flat files below ``folder``, one a task.

    Returns the files, ``path, n_bytes``, and the roster, ``path, ordinal, doc_id``: which document a file holds where. A null text
    is a document without tokens. The files of attempts that did not end are in neither table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "tokens")
    make_folder(folder)
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([separator], kind).tobytes()

    def write(batches):
        encoding, where, out, ordinal, size = _encoding(shared.value, pattern), None, None, 0, 0
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if out is None and len(batch):
                where, base = open_fs(folder)
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            for text in batch.column("text"):
                data = np.asarray(encoding.encode_ordinary(text.as_py()), kind).tobytes() + end
                out.write(data)
                size += len(data)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id"), pa.array([None] * n, pa.int64())], ["path", "ordinal", "doc_id", "n_bytes"])
            ordinal += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([None], pa.int64()), pa.nulls(1, batch.column("doc_id").type), pa.array([size], pa.int64())], ["path", "ordinal", "doc_id", "n_bytes"])

    kind_of = rows.schema["doc_id"].dataType.simpleString()
    both = keep.write(rows.mapInArrow(write, f"path string, ordinal long, doc_id {kind_of}, n_bytes long"), "roster")
    return both.filter("n_bytes IS NOT NULL").select("path", "n_bytes"), both.filter("ordinal IS NOT NULL").select("path", "ordinal", "doc_id")


def count_tokens(files: DataFrame, separator: int, kind: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """``path, ordinal, n_tokens, ended`` for every document of the files (columns ``path, n_bytes``).

    Tokens after the last separator are a document that has not ended; an empty file has none. ``block_bytes`` must be a multiple of
    a token's size. A block gives the places of its separators; sums over the blocks before give the first place and document
    number of a block, and a running maximum gives the last separator before it, so a document may span any number of blocks.
    """
    width = np.dtype(kind).itemsize
    if block_bytes % width:
        raise ValueError("a block is a whole number of tokens")
    spark = files.sparkSession
    keep = Scratch(spark, "scan")
    blocks = files.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block"))
    total = int(files.agg(F.coalesce(F.sum(F.ceil(F.col("n_bytes") / block_bytes)), F.lit(0))).first()[0])
    n = max(1, min(total, int(spark.conf.get("spark.sql.shuffle.partitions"))), total // 32)  # tasks, of 32 blocks each if there are many

    def scan(batches):
        for batch in batches:
            for uri, size, block in zip(batch.column("path").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("block").to_pylist(), strict=True):
                where, path = open_fs(uri)
                with where.open_input_file(path) as file:
                    data = file.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                tokens = np.frombuffer(data, kind, len(data) // width)
                places = np.flatnonzero(tokens == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([places], pa.list_(pa.int32()))], ["path", "block", "n", "places"])

    found = keep.write(blocks.repartition(n, "path", "block").mapInArrow(scan, "path string, block long, n long, places array<int>"), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = found.select("path", "block", "n", F.size("places").cast("long").alias("k"), F.try_element_at("places", F.lit(-1)).alias("last"))
    sums = sums.withColumns({"start": F.coalesce(F.sum("n").over(before), none), "ordinal": F.coalesce(F.sum("k").over(before), none)})
    sums = sums.withColumn("previous", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1).cast("long")))
    ended = found.select("path", "block", "places").join(sums.hint("merge"), ["path", "block"]).select("path", "ordinal", F.posexplode(F.transform("places", lambda p, i: F.when(i == 0, F.col("start") + p - F.col("previous") - 1).otherwise(p - F.get("places", i - 1) - 1))).alias("i", "n_tokens"))
    ended = ended.select("path", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("n_tokens").cast("long"), F.lit(True).alias("ended"))
    whole = sums.groupBy("path").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.max(F.col("start") + F.col("last")), F.lit(-1).cast("long")).alias("last"))
    rest = whole.select("path", F.col("k").alias("ordinal"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.unionByName(rest)
