"""WARC archives: one gzip member per record, written by Spark tasks and read back sequentially.

Archives lie under a folder that all executors share (any URI that ``pyarrow.fs`` opens). Each task
attempt writes files of its own; the manifest holds those of the attempts that count, so a lost
executor leaves unlisted files behind but never a half-written listed one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precolens.llm.common import ready, slices
from precolens.session import durable, scratch_path

# Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
ROLL_BYTES = 1 << 30
READ_BYTES = 1 << 18

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, digest_ok boolean, payload binary"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()),
        ("payload", pa.binary()),
    ]
)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to: the records to write.

    Of equal payloads of at least ``REVISIT_BYTES``, the largest page_id is stored and the others
    refer to it. A null payload is empty. Rows that repeat the stored page_id are stored, too, and so
    are copies that have no page_id at all to refer to. An empty table gives no records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # Partial counts meet per payload; only payloads that repeat are looked up. They are written, so
    # that both sides of the join are plain shuffles, of which a hot payload's can be split.
    kept = durable(
        rows.where(large)
        .groupBy("same")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    return rows.join(kept, "same", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to"),
    )


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        escaped = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {escaped}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the planned records below ``folder``; the manifest (path, records, bytes), kept durably."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        done, out, size, count, path = [], None, 0, 0, ""

        def close():
            if out is not None:
                out.close()
                done.append((path, count, size))

        for batch in slices(batches, 2):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ROLL_BYTES:
                    close()
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out, size, count = store.open_output_stream(path, compression=None), 0, 0
                member = gzip.compress(record(*row), 6, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
        close()
        scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
        if folder.startswith("file:"):
            scheme = "file://"
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([scheme + p for p, _, _ in done], pa.string()),
                "records": pa.array([n for _, n, _ in done], pa.int64()),
                "bytes": pa.array([s for _, _, s in done], pa.int64()),
            }
        )

    columns = ("page_id", "url", "payload", "digest", "refers_to")
    return durable(ready(records).select(*columns).mapInArrow(write, MANIFEST))


class WarcError(ValueError):
    """An archive that breaks the framing: a cut member, a wrong length, a missing header."""


def read_records(stream, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open archive, one after the other, in bounded reads."""
    rest, number = b"", 0
    while rest or (rest := stream.read(READ_BYTES)):
        member, data = zlib.decompressobj(31), bytearray()
        head, start, need = None, 0, 0
        while True:
            try:
                data += member.decompress(rest)
            except zlib.error as e:
                raise WarcError(f"{name}: record {number}: {e}") from e
            rest = member.unused_data
            if head is None and (end := data.find(b"\r\n\r\n")) >= 0:
                head = _headers(bytes(data[:end]), f"{name}: record {number}")
                start = end + 4
                need = start + int(head["content-length"])
            if head is not None and len(data) > need + 4:
                raise WarcError(f"{name}: record {number} is longer than its length")
            if member.eof:
                break
            rest = stream.read(READ_BYTES)
            if not rest:
                raise WarcError(f"{name}: record {number} is cut")
        if head is None or data[need:] != b"\r\n\r\n":
            raise WarcError(f"{name}: record {number} does not have its length")
        yield head, bytes(data[start:need])
        number += 1


def _headers(head: bytes, where: str) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise WarcError(f"{where} starts with {first[:20]!r}")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    if not found.get("content-length", "").isdigit():
        raise WarcError(f"{where} has no length")
    return found


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parsed(head: dict[str, str], block: bytes) -> tuple:
    """The row of a record; ``digest_ok`` is false if the block or the payload breaks its digest."""
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    ok = _base32(hashlib.sha1(block).hexdigest()) == head["warc-block-digest"].removeprefix("sha1:")
    payload = None
    if head["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        ok = ok and hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(head["x-payload-length"])
    url = head.get("warc-target-uri")
    return (
        _number(head["warc-record-id"]),
        None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        head["warc-type"],
        _number(head.get("warc-refers-to")),
        int(head["x-payload-length"]),
        digest,
        ok,
        payload,
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives listed in ``manifest`` (column path), as ``RECORD``.

    One task reads an archive from its start to its end. A record whose bytes break a digest comes
    with ``digest_ok`` false; broken framing raises ``WarcError``. No archives give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for head, block in read_records(stream, path):
                        rows.append(parsed(head, block))
                        size += len(block)
                        if size >= 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return ready(paths).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back, as ``RECORD``."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(plan_records(pages), folder))
