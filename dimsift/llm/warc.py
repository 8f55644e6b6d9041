"""Web archives of Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Writing: rows with equal payloads keep one ``response`` record, the others become ``revisit`` records
that name it. Every task writes its own archives straight into a folder all executors reach, each with
a dictionary trained on its first records; names hold the attempt, and only the archives named by
successful attempts are read back, so a lost task leaves nothing behind that counts.

Reading: the dictionary is loaded from the leading frame, one frame is decoded at a time, and version,
header fields, lengths and digests of every record are checked; a bad archive is an error that says where.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialize, shared_folder

ARCHIVE_BYTES = 32 << 20  # an archive is closed when it has grown beyond this
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 256, 2 << 20  # that a dictionary is trained on
READ_BYTES = 64 << 10
OUT_ROWS, OUT_BYTES = 2000, 8 << 20  # of one batch of records read
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

_record_id = re.compile(r"<urn:page:(.*)>")
_plain_number = re.compile(r"[0-9]+")


class BadArchive(ValueError):
    """An archive that breaks the format."""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def name_of(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> str | None:
    found = _record_id.fullmatch(name)
    if not found:
        raise BadArchive(f"record id {name!r}")
    return found[1] or None


def record(page_id: object, url: str | None, payload: bytes, digest: bytes, refers_to: object, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP header, which has the length of the payload, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name_of(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if revisit:
        fields += [("WARC-Refers-To", name_of(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; too few of them to train on are a dictionary as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive, the dictionary first; ends with the records or beyond ``ARCHIVE_BYTES``."""
    samples, size = [], 0
    for r in records:
        samples.append(r)
        size += len(r)
        if len(samples) == SAMPLE_RECORDS or size > SAMPLE_BYTES:
            break
    if not samples:
        return
    dictionary = train(samples)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    yield struct.pack("<II", SKIPPABLE, len(stored)) + stored
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    written = 0
    for some in (samples, records):
        for r in some:
            frame = compressor.compress(r)
            written += len(frame)
            yield frame
            if some is records and written > ARCHIVE_BYTES:
                return


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, sha1, refers_to, revisit`` as archives; ``path, records, bytes`` of each, stored.

    Null html is an empty payload, a null url leaves its field out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        count = 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    for r in some.to_pylist():
                        count += 1
                        yield record(r["page_id"], r["url"], (r["html"] or "").encode(), r["sha1"], r["refers_to"], r["revisit"])

        source, number, before = records(), 0, 0
        while True:
            parts = frames(source)
            first = next(parts, None)
            if first is None:
                return
            name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            size = len(first)
            with store.open_output_stream(f"{root}/{name.rsplit("/", 1)[1]}", compression=None) as out:
                out.write(first)
                for part in parts:
                    out.write(part)
                    size += len(part)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([count - before], pa.int64()), "bytes": pa.array([size], pa.int64())})
            number, before = number + 1, count

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def decode(content: bytes, where: str = "") -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    at, end = 0, len(content)
    view = memoryview(content)
    dictionary = None
    if end >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        at = 8 + size
        if at > end:
            raise BadArchive(f"{where}: the dictionary frame is cut short")
        stored = bytes(view[8:at])
        if stored[:4] == FRAME:
            stored = zstandard.ZstdDecompressor().decompress(stored)
        dictionary = zstandard.ZstdCompressionDict(stored)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < end:
        begin, parts = at, []
        one = decompressor.decompressobj()
        try:
            while not one.eof and at < end:
                parts.append(one.decompress(view[at : at + READ_BYTES]))
                at = min(end, at + READ_BYTES)
        except zstandard.ZstdError as error:
            raise BadArchive(f"{where} at byte {begin}: {error}") from None
        if not one.eof:
            raise BadArchive(f"{where} at byte {begin}: the last frame is cut short")
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record whose frame holds just this record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive("no record header of the right version")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name in fields:
            raise BadArchive(f"header line {line!r}")
        fields[name] = value.strip()
    missing = [n for n in NEEDED if n not in fields]
    if missing or not _plain_number.fullmatch(fields.get("Content-Length", "")):
        raise BadArchive(f"header without {missing or 'a content length'}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"{len(rest) - 4} bytes where the header says {size}")
    return fields, rest[:size]


def read_record(data: bytes) -> dict:
    """What a record says of its page, digest and lengths checked."""
    fields, block = parse(data)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        raise BadArchive(f"record of type {kind!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if not gap or length is None or not length.isdigit():
        raise BadArchive("block without an HTTP header and length")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(length) or base32(hashlib.sha1(payload).digest()) != digest):
        raise BadArchive("payload that differs from its length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields or len(digest) != 32):
        raise BadArchive("revisit with a payload, or without a digest or what it refers to")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None, "payload_bytes": int(length), "payload_digest": digest,
        "record_type": kind, "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def read_archives(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]`` of all records; ids as text."""
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    schema += ", payload binary" if payload else ""
    names = [c.split()[0] for c in schema.split(", ")]
    if not paths:
        return spark.createDataFrame([], schema)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for number, data in enumerate(decode(content.as_buffer().to_pybytes(), path.as_py())):
                    try:
                        rows.append(read_record(data))
                    except (BadArchive, UnicodeDecodeError) as error:
                        raise BadArchive(f"{path.as_py()}, record {number}: {error}") from None
                    size += len(data) * payload
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, refers_to, revisit``: the largest page id of equal payloads is the original.

    Payloads under ``min_bytes`` are all originals. Rows that repeat the largest id are originals too; a
    row without an id is one only where no row of its payload has an id.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("_size", F.octet_length("html"))
    # digests only; a payload of one page needs no row
    groups = rows.groupBy("sha1", "_size").agg(F.max("page_id").alias("_original"), F.count("*").alias("_pages"))
    repeated = materialize(groups.where("_pages > 1").drop("_pages"), "originals").withColumn("_repeated", F.lit(True))
    # where those are few, pages stay where they are; else Spark may split the pages of one payload over tasks
    rows = rows.join(broadcast_if_small(repeated), ["sha1", "_size"], "left")
    revisit = F.col("_repeated").isNotNull() & (F.col("_size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_original"))
    return rows.select(
        "page_id", "url", "html", "sha1", F.when(revisit, F.col("_original")).alias("refers_to"), revisit.alias("revisit")
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Write ``page_id, url, html`` as archives and read them back; page ids have their own type again.

    Nulls: an empty payload, a missing url, a page without an id. An empty table writes no archive and
    gives no rows; repeated rows have a record each; a payload of any length is one record.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(with_originals(pages, min_bytes), folder)
    # one name per archive, as in the file list that any read keeps on the driver
    back = read_archives(spark, [r["path"] for r in archives.select("path").collect()], payload)
    kind = pages.schema["page_id"].dataType
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
