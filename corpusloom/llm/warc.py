"""WARC archives: one gzip member per record, written to and read from shared storage.

Writing: of records with equal payloads (equal SHA-1 and length) of at least ``min_bytes``, the one with the
smallest id becomes a ``response`` and the others ``revisit`` records that name it; smaller payloads are always
responses. Payloads are hashed once to a narrow table of ids and digests, from which the list of revisits is made; the payloads
are then dealt once, by id, to as many tasks as their size asks for. A task writes archives of about ROLL bytes under names
of its own attempt, so a task that runs again after a lost executor can't meet a half-written file; the driver gets one
line per archive.

Reading: each archive is inflated incrementally, in pieces of ``CHUNK`` bytes, member by member; a record is its
header block and exactly Content-Length bytes, and block and payload digests are verified. A broken archive, record
or digest raises ValueError.

Nulls: a null payload is empty, a null URL is written as ``urn:page:ID``; a null id counts as larger than all others and is
written as ``none`` (copies without any id are responses each). Repeated ids are all written; ties in the least id are rows of
equal id, each of which is a response. A payload of any length is compressed and inflated as one member, in memory. An empty table
writes no archive and reads as no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, lean, materialise, parts_for, small_batches

CHUNK = 1 << 16
LEVEL = 4
#: Bytes of an archive after which the next one begins.
ROLL = 256 << 20
_NONE = "none"
_DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_origins(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the id of the response that a row revisits, else null."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    digest = F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload").cast("string"))
    id_key, no_id = F.coalesce("page_id", F.lit(0)).alias("id_key"), F.col("page_id").isNull().alias("no_id")
    # Ids and digests only: what revisits what is then a list of ids.
    names = materialise(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", digest.alias("digest")), "warc-digests")
    copies = names.groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null").select("digest", "origin")
    revisits = names.join(copies, "digest").where("not page_id <=> origin").select(id_key, no_id, "digest", F.col("origin").alias("refers_to")).distinct()
    n, key = parts_for(pages.select(page_id, url, html)), ["id_key", "no_id", "digest"]
    keyed = rows.select("*", id_key, no_id, digest.alias("digest"))
    return keyed.repartition(n, *key).join(revisits.repartition(n, *key), key, "left").select("page_id", "url", "payload", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit has the HTTP headers only."""
    page_id = _NONE if page_id is None else page_id
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {''.join((url or f'urn:page:{page_id}').split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, to: str, *, level: int = LEVEL, roll: int = ROLL) -> list[str]:
    """Write the rows of with_origins as archives under the folder ``to``; their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        out, done, n = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                if out is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, wbits=31)
                out.write(packer.compress(record(page_id, url, payload, refers_to)) + packer.flush())
                n += 1
                if out.tell() >= roll:
                    out.close()
                    out = None
                    done.append((path, n))
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "n"])

    with small_batches(rows.sparkSession):
        made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(lean(run), "path string, n long").collect()
    return sorted(r["path"] for r in made)


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a binary stream, inflated piece by piece."""
    inflater, parts, rest = None, [], b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            break
        if inflater is None:
            inflater = zlib.decompressobj(wbits=31)
        try:
            parts.append(inflater.decompress(data))
        except zlib.error as e:
            raise ValueError(f"broken gzip member: {e}") from e
        if inflater.eof:
            rest = inflater.unused_data
            yield b"".join(parts)
            inflater, parts = None, []
    if inflater is not None:
        raise ValueError("the archive ends inside a gzip member")


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(member: bytes) -> dict:
    """The record of a member: checked framing and digests."""
    head, gap, body = member.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    length = int(fields["content-length"])
    block, tail = body[:length], body[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(_headers(http)[1]["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError("payload digest or length differs")
    to = fields.get("warc-refers-to")
    return {
        "page_id": None if (name := fields["warc-record-id"].strip("<>").rpartition(":")[2]) == _NONE else int(name),
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": int(to.strip("<>").rpartition(":")[2]) if to else None,
    }


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
])


def read(spark: SparkSession, paths: list[str], base: str, *, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``paths`` in the file system of the URI ``base``, an archive to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(base)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member) | ({} if payloads else {"payload": None}))
                        held += len(member)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    kind = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return files.mapInArrow(lean(run), kind)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write pages as archives in the shared folder and read them back, without payloads."""
    to = fresh_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(with_origins(pages, **options), to), to, payloads=False)
