"""Token counts through a stored cache of digests: only texts never seen are encoded.

The cache is a Parquet table ``tokenizer, digest, n_tokens`` in a folder all executors reach. A text
is looked up by the digest of its normalised content and by the digest of the tokenizer file, so
another tokenizer never sees the counts of this one.

Normalisation only folds what the tokenizer folds anyway: canonical composition, white space of the
ASCII kind to one space, ASCII letters to lower case. Special strings are cut out first, since the
tokenizer looks for them in raw text. Texts with equal digests therefore have equal counts.

Nulls: a null text counts as empty. Repeated rows and copies are encoded once and each get a row.
An empty table gives no rows and appends nothing. Very long texts are digested and encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_folder
from . import arrow
from .tokenizer_file import TokenizerFile, special_strings
from .word_bpe import word_coder

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
TOKEN_LIMIT = 2048

_white = re.compile(rb"[\t\n\v\f\r ]+")


def new_cache(spark: SparkSession) -> str:
    """Path of an empty cache in the shared folder."""
    path = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return path


def content_digest(text: str, split_special: re.Pattern | None) -> bytes:
    """SHA-256 of the normalised text; special strings and the parts between them are told apart by length."""
    digest = hashlib.sha256()
    for part in split_special.split(text) if split_special else (text,):
        plain = _white.sub(b" ", unicodedata.normalize("NFC", part).encode()).lower()
        if split_special and split_special.fullmatch(part):
            plain = b"\x00" + part.encode()
        digest.update(len(plain).to_bytes(8, "little"))
        digest.update(plain)
    return digest.digest()


def special_pattern(file: TokenizerFile) -> re.Pattern | None:
    special = special_strings(file.spec())
    return re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None


def with_digest(df: DataFrame, file: TokenizerFile) -> DataFrame:
    """``doc_id, _hash, n_bytes, digest`` of ``doc_id, text, _hash``."""
    pattern = special_pattern(file)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        digests = pa.array([content_digest(t, pattern) for t in texts], pa.binary())
        size = pa.array([len(t.encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["_hash"], size, digests], ["doc_id", "_hash", "n_bytes", "digest"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return arrow.map_batches(df, step, f"doc_id {kind}, _hash long, n_bytes long, digest binary")


def count_tokens(
    df: DataFrame, file: TokenizerFile, cache: str, key: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; counts new to ``cache`` are appended to it.

    One row stands for all with its digest: the texts meet the list of those rows in one shuffle, which is
    the only one that moves text. They meet on the key and a hash of the raw text, so rows that share a key
    do not meet all digests of that key; the digest is compared as well.
    """
    spark = df.sparkSession
    rows = arrow.text_only(df, key, text).withColumn("_hash", F.xxhash64("text"))
    # stored: read for the misses and again for the answer, a few bytes per row
    digests = materialize(with_digest(rows, file), "digests")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == file.version)
    misses = (
        digests.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "_hash")).alias("_first"))
        .join(known.select("digest"), "digest", "left_anti")
    )
    to_find = misses.select(F.col("_first.doc_id").alias("_id"), F.col("_first._hash").alias("_text"), F.col("digest").alias("_wanted"))
    # a null key is a key too
    same = rows["doc_id"].eqNullSafe(to_find["_id"]) & (rows["_hash"] == to_find["_text"])
    found = rows.join(to_find.hint("shuffle_hash"), same)
    pattern = special_pattern(file)

    def encode_wanted(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c = word_coder(file)
        out: dict[bytes, int] = {}
        for t, wanted in zip(batch["text"].to_pylist(), batch["_wanted"].to_pylist()):
            if wanted not in out and content_digest(t or "", pattern) == wanted:
                out[wanted] = len(c.encode(t or "")) // 4
        return pa.RecordBatch.from_arrays(
            [pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.int64())], ["digest", "n_tokens"]
        )

    fresh = arrow.map_batches(found.select("text", "_wanted"), encode_wanted, "digest binary, n_tokens long").dropDuplicates(["digest"])
    fresh.select(F.lit(file.version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # two jobs that append at once may store a digest twice, always with the same count
    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == file.version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
