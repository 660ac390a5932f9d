"""WARC archives: writing pages and reading them back as a chunked record table.

`write_warc` writes one record for each page into gzip-per-record WARC/1.1 files,
one run of files for each Spark task, and returns a manifest (path, records,
bytes). Only files in the manifest count, so a file left by a lost or repeated
task is never read. `read_warc` streams the files and returns one row for each
chunk of a payload: record id, chunk number, the bytes, and the length and SHA-1
of the payload so far. A payload is hashed and handed on chunk by chunk, so no
record is ever held whole by the reader; the last chunk's row carries the digest of
the full payload, which is compared with the record's own header.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the
largest page_id is a response and the others are revisit records, which carry the
response's HTTP header (and so its Content-Length) but no payload.

Scale: equal payloads are found through a grouped maximum over (digest,
page_id) with map-side partial aggregation; payload bytes are not shuffled when
the table of repeated digests is counted small, and otherwise joined by digest
with splittable skew. Archive files are rolled at FILE_BYTES.

Edge cases: a null html is an empty payload; empty and small payloads are
responses. A null url is written as about:blank. Rows that repeat a page_id and
payload which is the largest of its group are all responses. A null page_id never
refers and is never referred to. An empty table gives an empty manifest and table.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm.common import bounded_batches, shared_folder, small, stash

MIN_REVISIT = 1000
CHUNK = 1 << 20
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:framelark:page:"

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "record_id string, page_id long, record_type string, target_uri string, refers_to long, "
    "chunk_no int, data binary, payload_bytes long, payload_sha1 string, last boolean"
)


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record_parts(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None):
    """Byte pieces of one record; the payload is passed on in chunks, not copied into one buffer."""
    sha = hashlib.sha1()
    for i in range(0, len(payload), CHUNK):
        sha.update(payload[i : i + CHUNK])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(http) + (0 if revisit else len(payload))}")
    yield ("\r\n".join(head) + "\r\n\r\n").encode()
    yield http
    if not revisit:
        for i in range(0, len(payload), CHUNK):
            yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def _writer(folder: str, level: int):
    def write(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        run = f"{context.partitionId():06d}-{uuid.uuid4().hex[:12]}"  # a name that no other attempt has
        out, path, records, size, files = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            pages, urls, refers = batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["refers_to"].to_pylist()
            payloads = batch["payload"]
            for k in range(batch.num_rows):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((path, records, size))
                    path, records, size = f"{folder}/part-{run}-{files:04d}.warc.gz", 0, 0
                    files += 1
                    out = store.open_output_stream(pafs.FileSystem.from_uri(path)[1], compression=None)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in record_parts(pages[k], urls[k], memoryview(payloads[k].as_buffer()), refers[k]):
                    data = pack.compress(piece)
                    size += len(data)
                    out.write(data)
                data = pack.flush()
                size += len(data)
                out.write(data)
                records += 1
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _, _ in done], pa.string()), pa.array([r for _, r, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return write


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary) and refers_to (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    large = F.octet_length("payload") >= least
    keyed = rows.where(large & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("_digest"))
    repeated = stash(keyed.groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    # payloads without a partner get keys that spread: only large ones can match
    digest = F.when(large & F.col("page_id").isNotNull(), F.sha1("payload")).otherwise(F.concat_ws("-", F.lit("none"), F.col("page_id")))
    joined = rows.withColumn("_digest", digest).join(small(repeated), "_digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, least: int = MIN_REVISIT, level: int = 3) -> DataFrame:
    """Write the pages (page_id, url, html) as WARC files below `folder`; the manifest of the files."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return stash(with_revisits(pages, least).mapInArrow(_writer(folder, level), MANIFEST))


class _Stream:
    """Bytes of a gzip-per-record file, as a stream of bounded pieces."""

    def __init__(self, source):
        self.source, self.held, self.left = source, b"", b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        """Get at most CHUNK more bytes; False at the end."""
        while True:
            if self.unpack.eof:
                self.left = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            raw = self.unpack.unconsumed_tail or self.left or self.source.read(CHUNK // 4)
            self.left = b""
            if not raw:
                return False
            got = self.unpack.decompress(raw, CHUNK)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before `mark`, which is skipped; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("an archive ends within a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def pieces(self, n: int):
        """The next n bytes in pieces of at most CHUNK."""
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends within a record")
            piece, self.held = self.held[: min(n, CHUNK)], self.held[min(n, CHUNK) :]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(URN)
    return int(number) if number.lstrip("-").isdigit() else None


def chunk_rows(source, keep_data: bool):
    """Tuples of CHUNKS for each record of one open archive."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        left = int(f["content-length"])
        http = stream.until(b"\r\n\r\n")
        if http is None:
            raise ValueError("a record has no HTTP header")
        left -= len(http) + 4
        kind, full = f["warc-type"], int(_fields(http)["content-length"])
        hexed = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        same = (f["warc-record-id"], _page(f["warc-record-id"]), kind, f.get("warc-target-uri"), _page(f.get("warc-refers-to")))
        if kind == "revisit":
            yield (*same, 0, None, full, hexed, True)
        else:
            sha, size, number = hashlib.sha1(), 0, 0
            if not left:
                yield (*same, 0, b"" if keep_data else None, 0, sha.hexdigest(), True)
            for piece in stream.pieces(left):
                sha.update(piece)
                size += len(piece)
                yield (*same, number, piece if keep_data else None, size, sha.hexdigest(), size == left)
                number += 1
            if sha.hexdigest() != hexed or size != full:
                raise ValueError(f"the payload of {same[0]} differs from its digest")
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError("a record has no end mark")


def _reader(keep_data: bool):
    def read(batches):
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()),
             ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("last", pa.bool_())]
        )

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for files in batches:
            for path in files["path"].to_pylist():
                rows, held = [], 0
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as source:
                    for row in chunk_rows(source, keep_data):
                        rows.append(row)
                        held += 200 + len(row[6] or b"")
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def read_warc(spark: SparkSession, manifest: DataFrame, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest; one task reads one file or more."""
    bounded_batches(spark)
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_reader(keep_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record, from the row of its last chunk."""
    return chunks.where("last").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM k
"""
