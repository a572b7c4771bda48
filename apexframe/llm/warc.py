"""WARC archives: a writer, and a splittable reader.

Every record is a gzip member of its own. A reading task takes a byte range of a
file, scans it for the gzip magic number, decodes a candidate member's first
bytes to see whether a WARC header stands there, and reads the records that
start inside its range, also where they end behind it. The magic number may
occur inside compressed data; such candidates fail the test, and the reader never
needs an index.

Of pages with equal payloads the one with the largest id is written as a
response; the others are revisits that refer to it and carry no payload.

A null payload is empty. Pages with a null id are left out of the archive, and
repeated rows are repeated records. Empty tables give no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.session import stage

# Fixed values of the WARC 1.1 and gzip formats.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPLIT = 8 << 20
PROBE = 1 << 12
READ = 1 << 18
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, path string, offset long"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, for local, HDFS and object-store addresses."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int) -> str:
    return f"<urn:page:{page}>"


def record(page: int, url: str, payload: bytes, refers_to: int | None, day: str = "2024-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One gzip member with a response record, or a revisit record without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {day}",
        # A target may hold no line breaks; they are escaped as in addresses.
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http + payload if refers_to is None else http
    head = VERSION + "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with the id of the response that each one revisits, null for responses.

    Only ids and hashes are grouped; counts and maxima are formed before the
    shuffle. Pages that share their payload join the staged list of shared
    payloads, a join that Spark can split at a hot payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.where("page_id IS NOT NULL").select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    size = F.octet_length("html")
    keys = own.where(size >= least_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("key"))
    shared = stage(keys.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    keyed = own.withColumn("key", F.when(size >= least_bytes, F.sha1(F.encode("html", "UTF-8"))))
    joined = keyed.join(shared, "key", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write page_id, url, html and refers_to as one archive file a partition.

    A file is written under a name of its attempt and then renamed, so a task
    that runs again after a lost executor replaces the file. Returns path, bytes
    and number of records of each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        trial = f"{name}.{context.taskAttemptId()}.tmp"
        out, n, size = None, 0, 0
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(trial)
                member = record(page, url, html.encode(), refers, level=level)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(trial, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long")


def splits(spark: SparkSession, folder: str, size: int = SPLIT, written: int | None = None) -> DataFrame:
    """Byte ranges of all archive files of a folder: path, start, end.

    The driver lists the files; the ranges are cut on the executors. ``written`` is
    how many bytes there have to be: a folder that workers wrote and the driver
    doesn't see, or not all of it, is an error.
    """
    store, base = open_store(folder)
    files = [f for f in store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if f.path.endswith((".warc.gz", ".warc"))]
    rows = [(f.path, f.size) for f in files if f.size]
    if written is not None and written != sum(s for _, s in rows):
        raise RuntimeError(f"{folder}: {written} bytes were written, {sum(s for _, s in rows)} are there; is it a folder that all machines share?")
    listed = spark.createDataFrame(rows, "path string, size long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))
    ranges = listed.select("path", "size", F.explode(starts).alias("start"))
    pieces = max(1, sum(-(-s // size) for _, s in rows))
    return ranges.select("path", "start", F.least(F.col("start") + size, "size").alias("end")).repartition(min(pieces, 10_000), "path", "start")


def _header(data: bytes) -> dict[str, str] | None:
    """Fields of the WARC header at the start of the data, or None."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, _ = data.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member with a WARC header starts here, as far as the data shows."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(file: pa.NativeFile, offset: int) -> tuple[bytes, int] | None:
    """Content of the gzip member at the offset and the offset behind it; None if it is none."""
    file.seek(offset)
    unpacker, out, read = zlib.decompressobj(31), [], 0
    try:
        while not unpacker.eof:
            data = file.read(READ)
            if not data:
                return None
            read += len(data)
            out.append(unpacker.decompress(data))
    except zlib.error:
        return None
    return b"".join(out), offset + read - len(unpacker.unused_data)


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of the records that start in [start, end)."""
    store, place = open_store(path)
    with store.open_input_file(place) as file:
        total = file.size()
        at = start
        while at < end:
            # Find the next candidate; the magic number may straddle two reads.
            file.seek(at)
            window = file.read(min(READ, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += found
            if at >= end:
                break
            file.seek(at)
            if not _starts_record(file.read(min(PROBE, total - at))):
                at += 1
                continue
            # From a true record on, members follow one another.
            while at < end:
                content = _member(file, at)
                fields = _header(content[0]) if content else None
                if fields is None:
                    at += 1  # damaged: look for the next candidate
                    break
                body = content[0].partition(b"\r\n\r\n")[2]
                yield at, fields, body[: int(fields["content-length"])]
                at = content[1]


def read(spark: SparkSession, folder: str, split: int = SPLIT, written: int | None = None) -> DataFrame:
    """Records of all archives of a folder, which has to hold ``written`` bytes if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for part in batch.to_pylist():
                for offset, fields, block in records_in(part["path"], part["start"], part["end"]):
                    rows.append(_row(part["path"], offset, fields, block))
                    held += len(block)
                    if held >= 1 << 22:
                        yield _record_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _record_batch(rows)

    return splits(spark, folder, split, written).mapInArrow(run, RECORD)


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _row(path: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    size = len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if revisit:  # the payload isn't here: its size stands in the HTTP header
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    elif digest != digest_of(payload):
        raise ValueError(f"payload of the record at {offset} of {path} doesn't have its digest")
    url = fields.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": _page(fields.get("warc-record-id")), "url": url, "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload.decode("utf-8", "replace"), "path": path, "offset": offset}


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("path", pa.string()), ("offset", pa.int64())])


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
