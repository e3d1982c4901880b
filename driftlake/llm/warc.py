"""WARC archives: a writer that records equal payloads once, and a splittable reader.

The writer gives each record its own gzip member. The reader deals out byte ranges of the archives; a task scans its
range for the gzip magic number, takes a place as a member only if a WARC header can be decoded from it, and owns the
records that start inside its range; it reads on past the range's end until its last record is whole.

A null payload is an empty one; a null page_id is kept and written as an empty one, never as the response of others;
repeated rows give repeated records; a payload of any length is one record, which its task holds whole; an empty table
gives no archive and no row; further columns of the input are not read. A member that begins like a record but is broken,
cut off or shorter than it says raises DamagedArchive, unless `read_archives` is told to skip such ones.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import shared_folder, table, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 18
FILE_BYTES = 64 << 20


class DamagedArchive(ValueError):
    """A record that cannot be read whole."""


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def classified(pages: DataFrame, id_col: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """pages with the columns _payload, _digest, _type and _refers_to.

    Of rows with equal payloads of at least least_bytes bytes that with the largest id is a response and the others
    revisit it. The largest id of each digest is found with partial sums; the join back is one whose skewed keys Spark
    splits."""
    hashed = pages.withColumn("_payload", F.coalesce(payload.cast("binary"), F.lit(b""))).withColumn("_key", F.sha2("_payload", 256))
    last = hashed.groupBy("_key").agg(F.max(id_col).alias("_last"))
    out = hashed.join(last.hint("merge"), "_key")
    revisit = (F.octet_length("_payload") >= least_bytes) & (F.col(id_col) < F.col("_last"))
    return out.withColumn("_refers_to", F.when(revisit, F.col("_last"))).withColumn("_type", F.when(revisit, "revisit").otherwise("response"))


def record(kind: str, page_id: str, url: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record in a gzip member of its own. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packed.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes one record per row to archives in the folder; returns (path, bytes) of the archives.

    A task writes to names of its own attempt, so a repeated task never meets its predecessor's files; only the files
    in the returned table count."""
    rows = classified(pages, id_col, F.col(payload_col), least_bytes)
    rows = rows.select(F.col("_type"), F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col("_refers_to").cast("string"), F.col("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, parts, out, path, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, "", 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                kind, page_id, url, refers_to, payload = values
                if out is None:
                    path, size = f"{name}-{parts}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    parts += 1
                packed = record(kind, page_id if page_id is not None else "", url, refers_to, payload)
                out.write(packed)
                size += len(packed)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return written(rows.mapInArrow(run, "path string, bytes long"), "archives")


def header_at(read, place: int) -> dict[str, str] | None:
    """The WARC header, of any length, of the gzip member at a place; None if there is no such member."""
    unpack, got, at, end, chunk = zlib.decompressobj(31), bytearray(), place, -1, b""
    while end < 0:
        if not chunk:
            chunk = read(at, 4096)
            at += len(chunk)
        known = max(0, len(got) - 3)
        try:
            # little at a time, so that damage behind the header does not hide it
            more = unpack.decompress(chunk, 1024)
        except zlib.error:
            return None
        if not chunk and not more:
            return None
        got += more
        chunk = unpack.unconsumed_tail
        end = got.find(b"\r\n\r\n", known)
        if not got.startswith(b"WARC/"[: len(got)]) or unpack.eof and end < 0:
            return None
    lines = got[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"version": lines[0]}


def records_in(f, begin: int, end: int, size: int, skip_damaged: bool = False) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records that start in [begin, end) of an open archive of `size` bytes."""
    window, base = b"", -1

    def read(at: int, n: int) -> bytes:
        nonlocal window, base
        if base < 0 or at < base or at + n > base + len(window) and base + len(window) < size:
            f.seek(at)
            window, base = f.read(max(n, READ_BYTES)), at
        return window[at - base : at - base + n]

    at = begin
    while at < end:
        chunk = read(at, READ_BYTES)
        hit = chunk[: end - at + len(MAGIC) - 1].find(MAGIC)
        if hit < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += hit
        header = header_at(read, at) if at < end else None
        if header is None:
            at += 1
            continue
        unpack, body, here = zlib.decompressobj(31), io.BytesIO(), at
        fault = None
        try:
            while not unpack.eof:
                chunk = read(here, READ_BYTES)
                if not chunk:
                    fault = "is cut off"
                    break
                here += len(chunk)
                body.write(unpack.decompress(chunk))
        except zlib.error as e:
            fault = f"is broken ({e})"
        raw = body.getvalue()
        start = raw.find(b"\r\n\r\n") + 4
        length = int(header.get("content-length", max(0, len(raw) - start)))
        if fault is None and len(raw) - start < length:
            fault = f"holds {len(raw) - start} of {length} bytes"
        if fault is not None:
            if not skip_damaged:
                raise DamagedArchive(f"the record at byte {at} {fault}")
            at += 1
            continue
        yield at, header, raw[start : start + length]
        at = here - len(unpack.unused_data)


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True, skip_damaged: bool = False) -> DataFrame:
    """(path, place, record_type, record_id, url, digest, refers_to, payload_bytes, payload) of all records of archives.

    files: (path, bytes). payload_bytes is the length of the full payload, a revisit's too; its payload is null."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("begin"))
    ranges = ranges.repartition(F.col("path"), F.col("begin"))
    schema = "path string, place long, record_type string, record_id string, url string, digest string, refers_to string, payload_bytes long, payload_sha1 string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    for place, header, block in records_in(f, begin, min(begin + range_bytes, size), size, skip_damaged):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = header.get("warc-type")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        rows.append((path, place, kind, _bare(header.get("warc-record-id")), header.get("warc-target-uri"), (header.get("warc-payload-digest") or "").partition(":")[2], _bare(header.get("warc-refers-to")), length, payload_digest(payload) if kind == "response" else None, *([payload if kind == "response" else None] * payloads)))
                        held += len(payload)
                        if held >= 4 << 20:
                            yield _batch(rows, names, payloads)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, payloads)

    return ranges.mapInArrow(run, schema)


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>").rpartition(":")[2]


def _batch(rows: list[tuple], names: list[str], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *[pa.binary()] * payloads]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    read = read_archives(files, payloads=False)
    # a response's digest is that of the bytes read back; a revisit has none of its own
    return read.select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", F.coalesce("payload_sha1", "digest").alias("payload_digest"), "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )
