"""Token ids of documents in files of patched frame-of-reference blocks.

Ids are stored end to end, in the order of the documents, in blocks of 128. A block has its smallest id, a
width, the low ``width`` bits of every id less the smallest, and a list of exceptions: the place and the
high bits of those that need more. The width is what a percentile of the block's ids needs, so a few rare ids do
not widen all others. Behind the blocks are an index of where each begins, and of where each document
begins, so any stretch of ids is read from the blocks it touches alone.

    "PFR1" | blocks | block starts (u64) | document starts (u64) | key lengths (i32, -1: none) | keys (UTF-8)
    | ids, documents, data bytes (u64 each) | CRC-32 of all before | "PFR1"
    block: smallest (u32) | width (u8) | exceptions (u8) | low bits | places (u8 each) | high bits (u32 each)

Numbers are little-endian. The last block is filled up with its smallest id; the count of ids tells how many are real.

Documents are dealt to tasks by ranges of their keys, and every task encodes its texts and writes its own
files. Names hold the attempt; the list of the files that count, with where each begins, is a table beside them,
written when all tasks are done, so a lost task leaves nothing behind that counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, new_folder
from . import arrow
from .tokenizer_file import TokenizerFile
from .warc import file_system
from .word_bpe import word_coder

BLOCK = 128
PERCENTILE = 90
FILE_IDS = 4 << 20  # a file is closed when it has so many ids; a document is never parted
END_ID = 1
MAGIC = b"PFR1"
TAIL = struct.Struct("<QQQI4s")
SUFFIX = ".pfr"
FILES = "file string, part int, number int, ids long, documents long"


class BadFile(ValueError):
    """A file that breaks the format."""


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of rows of ``BLOCK`` values, as rows of bytes."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    low = np.ascontiguousarray((values & np.uint64((1 << width) - 1)).T)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= low[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= low[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8)


def unpack_low(rows: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(rows.view("<u8").T).astype(np.uint64, copy=False)
    out = np.empty((BLOCK, len(rows)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).T


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ids below 2^32 end to end, and where each begins."""
    many = -(-len(ids) // BLOCK)
    values = np.zeros(many * BLOCK, np.uint64)
    values[: len(ids)] = ids
    if many:
        values[len(ids) :] = values[(many - 1) * BLOCK : len(ids)].min()
    values = values.reshape(many, BLOCK)
    least = values.min(axis=1, initial=np.uint64(1 << 32))
    values -= least[:, None]
    at = -(-BLOCK * percentile // 100) - 1
    width = bits_of(np.partition(values, at, axis=1)[:, at])
    odd_row, odd_place = np.nonzero(values >> width.astype(np.uint64)[:, None])
    odd = np.bincount(odd_row, minlength=many)
    starts = np.concatenate(([0], np.cumsum(6 + BLOCK // 8 * width + 5 * odd))).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((many, 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(many, 4)
    head[:, 4], head[:, 5] = width, odd
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        out[starts[some, None] + 6 + np.arange(BLOCK // 8 * w)] = pack_low(values[some], w)
    nth = np.arange(len(odd_row)) - (np.cumsum(odd) - odd)[odd_row]
    lists = starts[odd_row] + 6 + BLOCK // 8 * width[odd_row]
    out[lists + nth] = odd_place
    high = (values[odd_row, odd_place] >> width[odd_row].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(lists + odd[odd_row] + 4 * nth)[:, None] + np.arange(4)] = high
    return out.tobytes(), starts


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``starts``."""
    many = len(starts)
    head = data[starts[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.uint64)
    width, odd = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    if many and width.max() > 32:
        raise BadFile("a width beyond 32 bits")
    values = np.zeros((many, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        values[some] = unpack_low(data[starts[some, None] + 6 + np.arange(BLOCK // 8 * w)], w)
    row = np.repeat(np.arange(many), odd)
    nth = np.arange(len(row)) - (np.cumsum(odd) - odd)[row]
    lists = starts[row] + 6 + BLOCK // 8 * width[row]
    high = np.ascontiguousarray(data[(lists + odd[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.uint64)
    values[row, data[lists + nth]] |= high << width[row].astype(np.uint64)
    return (values + least[:, None]).astype(np.uint32).ravel()


def file_of(keys: list[str | None], documents: list[bytes], percentile: int = PERCENTILE) -> bytes:
    """A file of documents, whose ids are four bytes each."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    blocks, starts = encode_blocks(ids, percentile)
    texts = [None if k is None else k.encode() for k in keys]
    body = b"".join([
        MAGIC, blocks, starts[:-1].astype("<u8").tobytes(),
        np.cumsum([0, *(len(d) // 4 for d in documents)]).astype("<u8").tobytes(),
        np.array([-1 if t is None else len(t) for t in texts], "<i4").tobytes(), *(t or b"" for t in texts),
    ])
    tail = struct.pack("<QQQ", len(ids), len(keys), len(blocks))
    return body + tail + struct.pack("<I4s", zlib.crc32(tail, zlib.crc32(body)), MAGIC)


class IdFile:
    """A file read: keys, where each document begins, and any stretch of ids."""

    def __init__(self, content: bytes, where: str = ""):
        if len(content) < len(MAGIC) + TAIL.size or content[:4] != MAGIC or content[-4:] != MAGIC:
            raise BadFile(f"{where}: not such a file")
        self.ids, many, size, crc, _ = TAIL.unpack_from(content, len(content) - TAIL.size)
        if zlib.crc32(memoryview(content)[:-8]) != crc:
            raise BadFile(f"{where}: damaged")
        blocks = -(-self.ids // BLOCK)
        at = len(MAGIC) + size
        self.data = np.frombuffer(content, np.uint8, size, len(MAGIC))
        self.block_starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
        self.starts = np.frombuffer(content, "<u8", many + 1, at + 8 * blocks).astype(np.int64)
        at += 8 * (blocks + many + 1)
        lengths = np.frombuffer(content, "<i4", many, at)
        ends = at + 4 * many + np.cumsum(np.maximum(lengths, 0))
        self.keys = [None if n < 0 else content[e - n : e].decode() for n, e in zip(lengths.tolist(), ends.tolist())]
        if self.starts[-1] != self.ids:
            raise BadFile(f"{where}: documents that do not add up")

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end``, from the blocks they are in."""
        if not 0 <= first <= end <= self.ids:
            raise IndexError(f"{first} to {end} of {self.ids} ids")
        block = first // BLOCK
        ids = decode_blocks(self.data, self.block_starts[block : -(-end // BLOCK)])
        return ids[first - block * BLOCK : end - block * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


def write_ids(df: DataFrame, file: TokenizerFile, folder: str | None = None, end_id: int = END_ID,
              percentile: int = PERCENTILE, key: str = "doc_id", text: str = "text") -> str:
    """Encode the texts and write their ids, each with the end id behind it, by ascending key; the folder.

    A null text is the end id alone. Rows without a key come first. Rows that repeat a key are each
    written, in the order of a hash of their texts. An empty table writes no file, only an empty list of files.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "ids")
    end = end_id.to_bytes(4, "little")
    rows = arrow.text_only(df, key, text)
    # the last two part a key that many rows repeat
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"_hash": order[1], "_row": order[2]})
    rows = rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    store, root = file_system(f"{folder}/data")
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = word_coder(file), TaskContext.get()
        store, root = file_system(f"{folder}/data")
        keys: list[str | None] = []
        documents: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, documents, size, number
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}{SUFFIX}"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(file_of(keys, documents, percentile))
            columns = [[name], *(pa.array([x], t) for x, t in ((task.partitionId(), pa.int32()), (number, pa.int32()), (size, pa.int64()), (len(keys), pa.int64())))]
            keys, documents, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["file", "part", "number", "ids", "documents"])

        for batch in batches:
            for part in arrow.text_chunks(batch):
                for k, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = coder.encode(t or "") + end
                    keys.append(k)
                    documents.append(ids)
                    size += len(ids) // 4
                    if size >= FILE_IDS:
                        yield close()
        if keys:
            yield close()

    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    named.mapInArrow(run, FILES).write.parquet(f"{folder}/files")
    return folder


def _read(spark: SparkSession, folder: str, rows_of: Callable[[IdFile], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows with ``doc_id, start`` and more of every file that counts; starts count from the first file."""
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    # one row per file of millions of ids
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before"))
    contents = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(f"{folder}/data").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                for rows in rows_of(IdFile(content.as_buffer().to_pybytes(), path)):
                    names = pa.array([path.rsplit("/", 1)[1]] * rows.num_rows, pa.string())
                    yield rows.append_column("file", names)

    found = contents.mapInArrow(run, f"{schema}, file string")
    # files of attempts that were lost are not in the list
    return found.join(broadcast_if_small(starts), "file").withColumn("start", F.col("start") + F.col("_before")).drop("file", "_before")


def _by_document(file: IdFile, of_ids: Callable[[np.ndarray], object], kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """One row per document, read a stretch of documents at a time."""
    at, many = 0, len(file.keys)
    while at < many:
        end = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + (1 << 20), side="right")) - 1)
        ids, bounds = file.read(int(file.starts[at]), int(file.starts[end])), file.starts[at : end + 1] - file.starts[at]
        values = [of_ids(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(file.keys[at:end], pa.string()), pa.array(file.starts[at:end]), pa.array(np.diff(bounds)), pa.array(values, kind)],
            ["doc_id", "start", "n_tokens", name],
        )
        at = end


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the files; keys as text."""
    return _read(
        spark, folder, lambda f: _by_document(f, lambda ids: ids.astype(np.int64), pa.list_(pa.int64()), "ids"),
        "doc_id string, start long, n_tokens long, ids array<long>",
    )


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in the files; keys as text."""
    return _read(
        spark, folder, lambda f: _by_document(f, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32"),
        "doc_id string, start long, n_tokens long, ids_crc32 long",
    )
