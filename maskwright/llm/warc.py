"""WARC archives as a chunked record table.

Reading gives a row for each chunk of a record, under the record's identifier and the chunk's number, with the digest of
the payload up to there, so no payload is ever held whole. Writing streams payloads through a compressor in the same
chunks. Of records with equal payloads, one is a response and the others revisit it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, small_batches
from .files import make_folder, open_fs

CHUNK = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SALTS = 16


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def write_record(put, record_id: str, url: str, date: str, payload, digest: str, refers_to: str | None) -> None:
    """One record as a gzip member of its own; put takes bytes. payload: a buffer, of a revisit only its length is written."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = 0 if refers_to is not None else len(payload)
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{quote(record_id, safe='')}>"),
        ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~") or "urn:none:"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>"), ("WARC-Profile", _PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + block)),
    ]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    put(member.compress(_header(lines, "WARC/1.1") + http))
    view = memoryview(payload)
    for at in range(0, block, CHUNK):
        put(member.compress(view[at : at + CHUNK]))
    put(member.compress(b"\r\n\r\n"))
    put(member.flush())


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row below ``folder`` and return the archives as ``path, n_records, n_bytes``.

    The payload is the html in UTF-8, null is empty. Of records with equal payloads of ``least`` bytes or more the one with the
    smallest id is the response; other ids revisit it. Rows that repeat the smallest id, and those with a null id, are responses too. Each task writes
    archives of its own, of about ``archive_bytes`` each, under names that no other attempt uses; only those of the attempt that
    ended are in the returned table.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "warc")
    make_folder(folder)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.cast("binary").alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    size = F.octet_length("html")
    groups = rows.filter(size >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = keep.write(groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")), "groups")  # a hot payload is met by its rows in as many places
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(groups.hint("merge"), ["digest", "salt"], "left")
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", F.when((size >= least) & (F.col("id") != F.col("first")), F.col("first").cast("string")).alias("refers_to"))

    def write(batches):
        where, base = open_fs(folder)
        out, done, name = None, [], ""

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        n = size = 0
        for batch in batches:
            for record, url, html, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, n, size = f"part-{TaskContext.get().partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)

                def put(data: bytes) -> None:
                    nonlocal size
                    out.write(data)
                    size += len(data)

                write_record(put, record.as_py() or "", url.as_py(), date, html.as_buffer(), digest.as_py(), refers.as_py())
                n += 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return keep.write(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


def _read_header(stream) -> dict[str, str]:
    lines = {}
    while (line := stream.readline(1 << 20)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        lines[name.strip().lower()] = value.strip()
    return lines


def _page(urn: str | None) -> str | None:
    return unquote(urn.strip("<>").removeprefix("urn:page:")) if urn else None


def records(stream, chunk: int = CHUNK):
    """Chunk rows of a stream of WARC records. A record without payload is one empty chunk."""
    while first := stream.readline(1 << 16):
        if not first.startswith(b"WARC/"):
            if first.strip():
                raise ValueError("not a WARC record")
            continue
        head = _read_header(stream)
        left, length, kind = int(head["content-length"]), None, head.get("warc-type", "")
        if head.get("content-type", "").startswith("application/http"):
            block = _Counted(stream, left)
            block.readline(1 << 16)  # the status
            stated = _read_header(block).get("content-length", "")
            left, length = block.left, int(stated) if stated.isdigit() else None
        digest, seen, number = hashlib.sha256(), 0, 0
        row = {"record_id": _page(head.get("warc-record-id")), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to"))}
        stated = (head.get("warc-payload-digest") or "").removeprefix("sha256:")
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("a record ends early")
            left -= len(data)
            digest.update(data)
            seen += len(data)
            last = not left
            whole = kind == "revisit"  # its payload is that of the record it refers to
            now = stated if whole else digest.hexdigest()
            yield row | {"chunk_no": number, "last": last, "data": data, "payload_bytes": length or 0 if whole else seen, "payload_digest": now, "intact": not last or not stated or stated == now}
            number += 1
            if last:
                break


class _Counted:
    """Lines of a stream, no further than ``left`` bytes."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def readline(self, most: int) -> bytes:
        line = self.stream.readline(min(most, self.left)) if self.left else b""
        self.left -= len(line)
        return line


_ROW = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def read_archives(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives (column ``path``), compressed or not.

    ``record_id, chunk_no`` name a chunk; ``payload_bytes`` and ``payload_digest`` are those of the payload through that chunk,
    so the row with ``last`` has those of the whole. A revisit is one empty chunk with the length and digest its record states.
    ``intact`` is false where a whole payload does not have the digest stated for it. Archives are read one a task, a batch of rows never
    holds more than about 4 MB; a damaged archive fails the task.
    """
    n = max(1, archives.count())

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                where, path = open_fs(uri)
                with where.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if uri.endswith(".gz") else raw
                    rows, size = [], 0
                    for row in records(stream, chunk):
                        rows.append(row)
                        size += len(row["data"]) + 300
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)

    return archives.select("path").repartition(n).mapInArrow(read, "record_id string, chunk_no long, last boolean, record_type string, target_uri string, refers_to string, data binary, payload_bytes long, payload_digest string, intact boolean")
