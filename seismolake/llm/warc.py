"""WARC archives: a writer with payload deduplication, and a splittable reader of gzip members.

Writer: every task writes whole files of gzip members, one record each, into a shared folder, and returns a manifest of the
files it finished. A task that is lost leaves a file that no manifest names, so its retry does no harm.

Reader: files are cut into byte ranges. A task looks for gzip magic in its range, takes a place for a record if what follows
inflates to a WARC header, and owns the records that start inside its range, however far they reach. So each record is read
once, whatever the cuts.

The writer decides revisits by digest and length. The table of digests that several pages have is broadcast where it is small, so pages aren't shuffled at all; else pages are joined by digest,
and digests of very many pages are split over several tasks. The reader has as many tasks as the bytes need.

A page of any length is one record; other columns are dropped. Nulls: a null payload is empty, a null url is an empty target; a null id stays null. Repeated ids give repeated records: all
rows that hold the largest id of equal payloads are responses. An empty table gives no records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh_dir, lean, split_join, table

LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 128 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
LEVEL = 3
#: Bytes of archives that a reading task takes, about.
TASK_BYTES = 64 << 20
#: More digests of several pages than this are joined by a shuffle, in which digests of very many pages are split.
BROADCAST_DIGESTS = 200_000
MAGIC = b"\x1f\x8b\x08"
NEWLINE = b"\r\n"


def open_store(uri: str):
    """pyarrow's file system of a URI, and the path in it; works in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if refers_to is not None else head + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + NEWLINE * 2 + block + NEWLINE * 2


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files into folder; the manifest: path, bytes, records."""

    def store(batches):
        files, path = None, f"{folder}/part-{uuid.uuid4().hex}"
        held, written, records, number = None, 0, 0, 0
        for batch in batches:
            for page_id, url, text, digest, size, refers_to in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, digest, size, refers_to = (x.as_py() for x in (page_id, url, digest, size, refers_to))
                if held is None:
                    files, at = open_store(f"{path}-{number:04d}.warc.gz")
                    held = files.open_output_stream(at, compression=None)
                payload = b"" if refers_to is not None else (text.as_py() or "").encode()
                data = gzip_member(record(page_id, url, payload, digest, size, refers_to))
                held.write(data)
                written, records = written + len(data), records + 1
                if written >= FILE_BYTES:
                    held.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{path}-{number:04d}.warc.gz"], "bytes": [written], "records": [records]})
                    held, written, records, number = None, 0, 0, number + 1
        if held is not None:
            held.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}-{number:04d}.warc.gz"], "bytes": [written], "records": [records]})

    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    copies = pages.filter(F.col("size") >= LEAST_REVISIT_BYTES).groupBy(F.col("digest").alias("same_digest"), F.col("size").alias("same_size"))
    copies = checkpoint(copies.agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"))
    # a SHA-1 digest and a length as one key
    copies, key = copies.withColumn("same", F.concat_ws(":", "same_digest", "same_size")).drop("same_digest", "same_size"), F.concat_ws(":", "digest", "size")
    if copies.count() <= BROADCAST_DIGESTS:
        joined = pages.join(F.broadcast(copies), key == F.col("same"), "left")
    else:
        joined = split_join(pages.withColumn("key", key), copies, "key", "same", "n", "page_id", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # what the record of a revisit doesn't hold isn't handed to Python
    text = F.when(refers_to.isNull(), F.col("html"))
    files, at = open_store(folder)
    files.create_dir(at, recursive=True)
    manifest = f"{folder}/_manifest.parquet"
    joined.select("page_id", "url", text.alias("html"), "digest", "size", refers_to.alias("refers_to")).mapInArrow(lean(store), "path string, bytes long, records long").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


class Window:
    """A file's bytes from some place on, read as far as they are asked for."""

    def __init__(self, source, at: int):
        self.source, self.at, self.data = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        got = self.source.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def inflate(window: Window) -> tuple[bytes, int] | None:
    """The record whose member starts the window and the member's length; None if it isn't a WARC record."""
    unpack, parts, fed, seen = zlib.decompressobj(31), [], 0, b""
    try:
        while not unpack.eof:
            if fed >= len(window.data) and not window.more():
                return None
            take = window.data[fed : fed + (64 << 10)]
            parts.append(unpack.decompress(take))
            fed += len(take)
            if len(seen) < 7:
                seen += parts[-1][:7]
                if not b"WARC/1.".startswith(seen[:7]) and not seen.startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    return (b"".join(parts), fed - len(unpack.unused_data)) if seen.startswith(b"WARC/1.") else None


def records_in(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header and block of the records that start in [start, end)."""
    window = Window(source, start)
    while window.at < end:
        place = window.data.find(MAGIC)
        if place < 0:
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.drop(place)
        if window.at >= end:
            return
        got = inflate(window)
        if got is None:
            window.drop(1)
            continue
        data, length = got
        head, _, block = data.partition(NEWLINE * 2)
        lines = [x.partition(": ") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
        fields = {k.lower(): v for k, _, v in lines}
        yield window.at, fields, block[: int(fields.get("content-length", 0))]
        window.drop(length)


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of WARC files (path, bytes): path, offset, warc_type, record_id, target_uri, refers_to, payload_digest, http_length, payload."""
    names = ["path", "offset", "warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "http_length", "payload"]

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, at = open_store(path)
                with store.open_input_file(at) as source:
                    rows, held = [], 0
                    for place, fields, block in records_in(source, start, min(start + split_bytes, size)):
                        http, _, payload = block.partition(NEWLINE * 2)
                        length = next((int(x.split(b":")[1]) for x in http.split(NEWLINE) if x.lower().startswith(b"content-length:")), None)
                        rows.append((path, place, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), length, payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    n_files, n_bytes = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_splits = n_files + n_bytes // split_bytes
    n_tasks = min(n_splits, max(4 * files.sparkSession.sparkContext.defaultParallelism, n_bytes // TASK_BYTES))
    splits = splits.repartition(max(1, n_tasks), "path", "start")
    return splits.mapInArrow(lean(run), "path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    found = read(files)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    whole = F.col("warc_type") == "response"
    return found.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~whole, page("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
