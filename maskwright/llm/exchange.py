"""Ask and answer between batches of documents and buckets of keys.

Documents are packed once into batches of bounded bytes, one row each, in a written table. A batch asks each bucket once
about its distinct keys, packed as arrays; a bucket answers each batch in the order of its question. A key that
a third of all documents share is thus one entry a batch, never a group of documents, and nothing leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, small_batches


def pack(rows: DataFrame, keep: Scratch, batch_bytes: int = 8 << 20, name: str = "packed") -> DataFrame:
    """``batch, docs, size``: the rows in Arrow batches of about ``batch_bytes``; a larger row is a batch of its own."""
    small_batches(rows.sparkSession)

    def packed(batches):
        first, seq, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def flush():
            nonlocal seq, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_table(table)
            row = pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size], pa.int64())], ["batch", "docs", "size"])
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type))
            begin = 0
            for i, more in enumerate((sizes + 16).tolist()):
                if size and size + more > batch_bytes:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    begin = i
                    yield flush()
                size += more
            if len(batch) > begin:
                held.append(batch.slice(begin))
        if held:
            yield flush()

    return keep.write(rows.mapInArrow(packed, "batch long, docs binary, size long"), name)


def unpack(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(docs)).read_all()


def ask(packed: DataFrame, question: Callable[[pa.Table, dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``bucket, batch, payload``: what each batch asks. question: (documents, answers so far by bucket) -> (bucket, payload)."""
    packed = packed.drop("size")
    known = "answers" in packed.columns

    def asked(batches):
        for batch in batches:
            for i in range(len(batch)):
                got = {a["bucket"]: a["payload"] for a in batch.column("answers")[i].as_py() or ()} if known else {}
                made = list(question(unpack(batch.column("docs")[i].as_py()), got))
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m[0] for m in made], pa.int32()), pa.array([batch.column("batch")[i].as_py()] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary())],
                        ["bucket", "batch", "payload"],
                    )

    return packed.mapInArrow(asked, "bucket int, batch long, payload binary")


def answer(asked: DataFrame, serve: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """``bucket, batch, payload``: each bucket's answers, one or none to each question."""

    def served(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(payload=serve(group["payload"].tolist()))
        return group[group["payload"].notna()]

    return asked.groupBy("bucket").applyInPandas(served, "bucket int, batch long, payload binary")


def deliver(packed: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """The batches with their answers in a further column, an array of (bucket, payload)."""
    mine = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
    return packed.join(mine.hint("merge"), "batch", "left")
