"""WARC archives as a chunked record table.

``chunked`` turns payloads into rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, ``write`` streams them into
one gzip member per record, and ``read`` streams archives back into such rows.  Each row carries the SHA-1 of the payload so
far and the number of bytes so far, so nothing needs a whole record: the last row of a record has its digest and length.

Archives go through Arrow's file systems into the shared folder, under a name of their own per attempt.  The written
manifest lists the files of the attempts that counted; a lost executor's task writes new files, and only listed ones are read.
A null payload is empty; a null url leaves out the target; a null id gives a record without number.  Rows that repeat
the smallest id of a payload are responses all.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from gzip import GzipFile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from auditlake.operators.shuffle import shared_folder, stage

CHUNK = 1 << 20
FILE_BYTES = 1 << 30  # uncompressed bytes after which a task begins another archive
LEVEL = 3  # of gzip: two thirds of the time of the usual 6 for archives 3 % larger
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABLE = (
    "page_id long, chunk long, n_bytes long, digest_so_far string, last boolean, record_type string, refers_to long, payload_digest string, payload_bytes long, data binary"
)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload bytes, digest and, for a revisit, the page it refers to.

    Only narrow rows are grouped; the payloads are shuffled once, by page id.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload"))
    narrow = pages.select("page_id", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes")).distinct()
    lead = narrow.groupBy("sha1").agg(F.min("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    later = narrow.join(lead, "sha1").where((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("lead")) & F.col("lead").isNotNull())
    later = later.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), F.col("lead").alias("refers_to"))
    return pages.join(later, pages.page_id.eqNullSafe(later._page) & (pages.sha1 == later._sha1), "left").drop("_page", "_sha1")


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of ``payload``, in order; an empty payload, and that of a revisit, is one empty chunk."""
    size = F.octet_length("payload")
    sized = records.withColumn("payload_bytes", size.cast("long")).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    count = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int")
    rows = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("data", F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk))).withColumn("chunks", count).drop("payload")


def _head(page_id, url, sha1: str, size: int, refers_to) -> bytes:
    """The WARC header and the HTTP header of a record."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = len(http) + (size if refers_to is None else 0)
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out = member = None
        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk", "chunks", "data")]
            for i in range(batch.num_rows):
                page_id, url, sha1, size, refers_to, chunk, chunks, data = (c[i].as_py() for c in columns)
                if chunk == 0:
                    if out is None or held >= file_bytes:
                        if out is not None:
                            out.close()
                        files.append((f"{root}/{uuid.uuid4().hex}.warc.gz", 0))
                        out, held = store.open_output_stream(files[-1][0], compression=None), 0
                    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    files[-1] = (files[-1][0], files[-1][1] + 1)
                    out.write(member.compress(_head(page_id, url, sha1, size, refers_to)))
                out.write(member.compress(data))
                held += len(data)
                if chunk + 1 == chunks:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files]), pa.array([n for _, n in files], pa.int64())], names=["path", "records"])

    return run


def write(chunks: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives and returns their stored manifest: ``path, records``."""
    folder = folder or f"{shared_folder(chunks.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return stage(chunks.mapInArrow(_write(folder, file_bytes), "path string, records long"), "manifest").withColumn("folder", F.lit(folder))


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunk table of one uncompressed archive."""
    while (line := stream.readline()):
        if not line.strip():
            continue
        head = _fields(stream)
        block = int(head["content-length"])
        status = stream.readline()
        begun = len(status)
        http: dict[str, str] = {}
        while True:
            line = stream.readline()
            begun += len(line)
            if not line.strip():
                break
            name, _, value = line.decode().partition(":")
            http[name.strip().lower()] = value.strip()
        left, digest, total, number = block - begun, hashlib.sha1(), 0, 0
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        kind, page_id, refers_to = head["warc-type"], _number(head["warc-record-id"]), _number(head.get("warc-refers-to"))
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise EOFError(f"record {page_id} ends early")
            left -= len(data)
            total += len(data)
            digest.update(data)
            so_far = base64.b32encode(digest.copy().digest()).decode()
            yield page_id, number, total, so_far, left == 0, kind, refers_to, stated, int(http["content-length"]), data
            number += 1
            if not left:
                break


def _read(folder: str, with_data: bool, chunk: int):
    names = [c.split()[0] for c in _TABLE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for listed in batches:
            for path in listed.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    for row in records(io.BufferedReader(GzipFile(fileobj=raw)), chunk):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += len(row[-1])
                        if held >= 8 * CHUNK or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives of ``manifest``: one task per archive."""
    first = manifest.select("folder").first()
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_read(first["folder"] if first else "file:///", with_data, chunk), _TABLE)
