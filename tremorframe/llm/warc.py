"""Operator 2: WARC archives, from monolithic gzip to one member per record.

``write_archives`` lets every task write its records as files that are one gzip
stream each. ``normalise`` inflates such a file once, front to back, writes each
record as a gzip member of its own into a new file, and puts an index beside it
(offset and length of each member, id, type, digest). ``read_records`` reads
single members by that index.

Files go through ``pyarrow.fs``, so the folder may be any store it knows. A task
writes under a name of its own and returns it; the manifest keeps what finished
tasks returned, so a repeated task leaves an unused file and no double record.
Inflating holds one record at a time.

Which record is the response is decided on the payload digest, aggregated in the
map tasks first, so a payload with many copies meets in no single task.

Defined cases: a null html is an empty payload and takes part in deduplication
like any other; null ids are written as an empty target and come back as null,
and rows with null ids lose to any number as response; repeated rows are separate
records, and all that carry the largest id are responses; payloads that only
rows without id have are responses each; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tremorframe.session import scratch_path, stage_table

FILE_BYTES = 16 << 20
READ = 1 << 20
GZIP = 31  # zlib's window bits for a gzip member
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
INDEX = "path string, offset long, length long, record_id string, record_type string, payload_digest string"
RECORDS = (
    "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
    "record_id string, uri string, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict, payload: bytes) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if row["revisit"] else payload)
    uri = "".join(c for c in row["url"] or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: <{row['record_id']}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["revisit"]:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['response']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` with ``response``, the largest page_id of the same payload, and ``revisit``.

    Only payloads that occur more than once reach the join; their table is
    written first, so that Spark knows its size and can split a hot digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    shared = keyed.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    shared = stage_table(shared.filter("n > 1").drop("n"), "warc-shared")
    told = keyed.join(shared, "digest", "left")
    return told.select(
        "page_id", "url", "payload", "response",
        (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"),
    )


def write_archives(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, revisit, response`` rows; returns the manifest of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base)
        out, packer, path, size, count = None, None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                    packer, size, count = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                row["record_id"] = f"urn:uuid:{uuid.uuid4()}"
                data = record_bytes(row, row["payload"])
                out.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.write(packer.flush())
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            names=["path", "records"],
        )

    return pages.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "revisit", "response").mapInArrow(
        write, MANIFEST
    )


def inflate(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip file, in pieces; members may follow one another."""
    unpacker = zlib.decompressobj(GZIP)
    while data := stream.read(READ):
        while data:
            yield unpacker.decompress(data, 4 * READ)
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data = unpacker.unused_data
                unpacker = zlib.decompressobj(GZIP)
    yield unpacker.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes of each record."""
    buffer, need, head_end, fields = bytearray(), None, 0, {}
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                head_end = buffer.find(b"\r\n\r\n")
                if head_end < 0:
                    break
                fields = parse_head(bytes(buffer[:head_end]))
                need = head_end + 4 + int(fields["content-length"]) + 4
            if len(buffer) < need:
                break
            yield fields, bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """One member per record for every file of the manifest, with a sidecar index; returns the index."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, rows, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", [], 0
                with (
                    store.open_input_stream(source, compression=None) as src,
                    store.open_output_stream(path, compression=None) as out,
                ):
                    for fields, raw in split_records(inflate(src)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        rows.append(
                            {
                                "path": path, "offset": offset, "length": len(member),
                                "record_id": fields["warc-record-id"].strip("<>"),
                                "record_type": fields["warc-type"],
                                "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                            }
                        )
                        offset += len(member)
                with store.open_output_stream(path + ".idx", compression=None) as sidecar:
                    sidecar.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                    ("record_type", pa.string()), ("payload_digest", pa.string()),
                ]))

    return manifest.select("path").mapInArrow(rewrite, INDEX)


def read_records(index: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The records the index names, each read by its own member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        path, file = None, None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = entry["path"], store.open_input_file(entry["path"])
                file.seek(entry["offset"])
                raw = zlib.decompress(file.read(entry["length"]), GZIP)
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = parse_head(head)
                block = rest[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                length = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                if not revisit and (len(payload) != length or payload_digest(payload) != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its header")
                rows.append(
                    {
                        "page_id": fields["warc-page-id"] or None,
                        "payload_bytes": length,
                        "payload_digest": digest,
                        "record_type": fields["warc-type"],
                        "refers_to": fields["warc-refers-to"].strip("<>").removeprefix("urn:page:") if revisit else None,
                        "record_id": fields["warc-record-id"].strip("<>"),
                        "uri": fields["warc-target-uri"],
                        "payload": payload if payloads and not revisit else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_to", pa.string()), ("record_id", pa.string()),
                ("uri", pa.string()), ("payload", pa.binary()),
            ]))

    return index.select("path", "offset", "length").mapInArrow(read, RECORDS)


def spread(table: DataFrame, *order: str) -> DataFrame:
    """A table of files with about one file a task, in the order of ``order``."""
    files = table.select("path").distinct().count()
    return table.repartition(max(files, 1), "path").sortWithinPartitions("path", *order)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages as monolithic archives, normalise them, and read every record back."""
    root = scratch_path(pages.sparkSession, "warc")
    manifest = stage_table(write_archives(decide(pages), f"{root}/raw"), "warc-manifest")
    index = stage_table(normalise(spread(manifest), f"{root}/members"), "warc-index")
    return read_records(spread(index, "offset"), f"{root}/members")
