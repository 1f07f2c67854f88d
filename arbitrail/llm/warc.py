"""WARC archives written in shards that come out the same however often and wherever the job runs.

1. Digests, without payloads: equal payloads of at least ``revisit_bytes`` have the smallest page id as response, the
   others become revisits of it.
2. Keys are cut into chunks by the running total of payload bytes in key order, so chunks don't depend on the number of
   tasks. A chunk is what one task writes.
3. Each record is built and compressed (a gzip member of its own) where its page lies; records, no longer payloads, are
   shuffled to their chunk and sorted by key.
4. A chunk's task writes files one after another and begins a new one when the compressed size is reached. A file is
   written under a temporary name and then renamed; a repeated task writes the same bytes again. A manifest of all files,
   itself written last, is what readers go by, so half-written or stray files are never read.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbitrail.llm.common import attach, map_batches, numbered_runs, stored
from arbitrail.session import shared_dir

REVISIT_BYTES = 100
CHUNK_BYTES = 64 << 20  # of payload, what one task writes
FILE_BYTES = 16 << 20  # of compressed records; a file ends with the record that reaches it
READ_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of revisits by equal payload in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal bytes for equal data."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed. A revisit has no block, only what it refers to and the size of the payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha256:{hashlib.sha256(b'').hexdigest() if revisit else digest}", f"Content-Length: {len(block)}"]
    return member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse_records(data: bytes):
    """(headers, block) of each record of a file; one member is unpacked at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("a WARC record is cut off")
            parts.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)  # of the last piece, so never more than a piece is copied
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = body[: int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"a damaged WARC record: {fields.get('WARC-Record-ID')}")
        yield fields, block


def revisits(pages: DataFrame) -> DataFrame:
    """(digest, first) of payloads that more than one page id has. Only digests are grouped, added up before the shuffle."""
    groups = pages.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nameless"))
    return groups.where("first is not null and (first <> last or nameless > 0)").select("digest", "first")


def chunk_starts(sizes: DataFrame, chunk_bytes: int) -> list[int]:
    """Page ids at which a new chunk begins, from the running total of bytes over (page_id, size) in key order.

    One number for each chunk, so bounded by the bytes of all payloads over ``chunk_bytes``.
    """
    ranged = numbered_runs(sizes.groupBy("page_id").agg(F.sum("size").alias("size")), ["page_id"], "chunks")
    totals = ranged.groupBy("run").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("run", before.alias("before")))
    so_far = Window.partitionBy("run").orderBy(F.col("page_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, "run").select("page_id", F.floor((F.col("before") + F.coalesce(F.sum("size").over(so_far), F.lit(0))) / chunk_bytes).alias("chunk"))
    return [r[0] for r in placed.where("page_id is not null").groupBy("chunk").agg(F.min("page_id").alias("start")).orderBy("start").select("start").collect()][1:]


def file_system(folder: str):
    """(pyarrow file system, path) of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write_chunks(folder: str, file_bytes: int):
    def run(batches):
        system, base = file_system(folder)
        chunk, number, held, size, count = None, 0, [], 0, 0

        def commit():
            nonlocal number, held, size, count
            name = f"chunk-{chunk:08d}-{number:05d}.warc.gz"
            temporary = posixpath.join(base, f"_temporary-{uuid.uuid4().hex}-{name}")
            digest = hashlib.sha256()
            with system.open_output_stream(temporary, compression=None) as out:
                for data in held:
                    out.write(data)
                    digest.update(data)
            system.move(temporary, posixpath.join(base, name))
            row = (name, chunk, number, count, size, digest.hexdigest())
            number, held, size, count = number + 1, [], 0, 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["file", "chunk", "number", "records", "bytes", "sha256"],
            )

        for batch in batches:
            for its_chunk, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if its_chunk != chunk:
                    if held:
                        yield commit()
                    chunk, number = its_chunk, 0
                held.append(record)
                size += len(record)
                count += 1
                if size >= file_bytes:
                    yield commit()
        if held:
            yield commit()

    return run


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Writes all pages as WARC files into ``folder``, which executors must share, and returns the manifest.

    (file, chunk, number, records, bytes, sha256), also written as ``folder``/manifest. A null html has an empty payload, a
    null url no target, a null page id comes first. Rows of one page id and payload are written as often as they occur; if
    that id is the response, each of them is. Other columns aren't read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    facts = stored(rows.select("page_id", "digest", F.length("payload").cast("long").alias("size")), "digests")
    starts = spark.sparkContext.broadcast(np.array(chunk_starts(facts, chunk_bytes), np.int64))
    firsts = stored(revisits(facts), "revisits")
    rows = attach(rows, firsts, ["digest"], F.lit(80)).select("page_id", "url", "payload", "digest", "first")

    def build(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            records, chunks = [], []
            for page, link, data, digest, first in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                refers = first if first is not None and page != first and len(data) >= REVISIT_BYTES else None
                records.append(build_record(page, link, data, digest, refers))
                chunks.append(0 if page is None else int(np.searchsorted(starts.value, page, "right")))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), part.column(0), part.column(3), pa.array(records, pa.binary())], ["chunk", "page_id", "digest", "record"])

    records = map_batches(rows, build, "chunk long, page_id long, digest string, record binary")
    sorted_records = records.repartition(F.col("chunk")).sortWithinPartitions("chunk", F.col("page_id").asc_nulls_first(), "digest", "record")
    manifest = sorted_records.select("chunk", "record").mapInArrow(_write_chunks(folder, file_bytes), "file string, chunk long, number long, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the files in the manifest.

    Files, their records and payloads are checked against their digests. Spark reads the files, so the folder may be
    anywhere Spark reaches; a file is as large as the writer lets it be. The payload of a revisit is null.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "sha256", "records")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chunk-*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = files.join(manifest, "file")

    def work(batch):
        for at in range(batch.num_rows):
            data, digest, records = batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError("a WARC file differs from its manifest")
            out: list[tuple] = []
            n = 0
            for fields, block in parse_records(data):
                n += 1
                payload = block if fields["WARC-Type"] == "response" else None
                known = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if payload is not None and fields["WARC-Block-Digest"] != fields["WARC-Payload-Digest"]:
                    raise ValueError("a payload differs from its digest")
                page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                out.append((page and int(page), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), known, fields["WARC-Type"], refers and int(refers), payload))
                if len(out) == 500:
                    yield _rows(out)
                    out = []
            if n != records:
                raise ValueError("a WARC file has other records than its manifest says")
            if out:
                yield _rows(out)

    return listed.select("content", "sha256", "records").mapInArrow(
        lambda batches: (x for b in batches for x in work(b)),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into a new folder of the shared ones and reads them back, without the payloads."""
    folder = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
