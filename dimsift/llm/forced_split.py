"""Byte-level BPE, encoded in independent fragments between certain cuts, and decoded again.

Two adjacent bytes that no vocabulary token contains side by side can never end up in one token:
every text position between such a pair is a cut. The merges left and right of a cut do not see
each other, so fragments are encoded on their own, each distinct one once per task, and their ids
are put end to end. A cut also has to leave the split into words alone that runs before the merges.
It does where the left character is no white space, and no apostrophe (of "'s" and the like) is
within two characters on the left or one on the right: a run of one class that is cut there goes on
as a run of the same class, and everything behind starts at the same place.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrow
from .tokenizer_file import TokenizerFile, special_strings
from .word_bpe import Lately, byte_letters, plain_classes, spelled

CACHE_FRAGMENTS = 300_000  # fragments in each of the two tables that a task remembers
CACHED_BYTES = 64  # longer fragments are encoded without being remembered
# first bytes of multi-byte characters that may be white space: U+0085, U+00A0; then U+1680, U+20xx, U+3000
SPACE_LEAD_2, SPACE_LEAD_3 = 0xC2, (0xE19A, 0xE280, 0xE281, 0xE380)
APOSTROPHE = 0x27


class ForcedSplitCoder:
    """Encoder and decoder of one byte-level BPE file; equal to the library on every text."""

    def __init__(self, file: TokenizerFile):
        spec = file.spec()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer")
        self.special = special_strings(spec)
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(letter[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.may_join = np.zeros(65536, bool)
        for token in self.bytes_of.values():
            for a, b in pairwise(token):
                self.may_join[a << 8 | b] = True
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.tokenizer = file.open()
        self.cache = Lately(CACHE_FRAGMENTS)
        letters, numbers = plain_classes()
        self.one_word = re.compile(f" ?(?:[{letters}]+|[{numbers}]+)")
        self.split_special = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in self.special) + b")")

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where a fragment begins, other than the first byte."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        wide = data.astype(np.uint16)
        pair = wide[:-1] << 8 | wide[1:]  # pair[i] is before place i + 1
        cut = ~self.may_join[pair] & (data[1:] & 0xC0 != 0x80) & ~arrow._is_gap[data[:-1]]
        cut &= (data[:-1] < 0x1C) | (data[:-1] > 0x1F)  # some libraries count these as white space
        quote = data == APOSTROPHE
        cut &= ~(quote[:-1] | quote[1:])
        cut[1:] &= ~quote[:-2]
        cut[1:] &= data[:-2] != SPACE_LEAD_2
        for lead in SPACE_LEAD_3:
            cut[2:] &= pair[:-2] != lead
        return np.flatnonzero(cut) + 1

    def encode_text(self, text: bytes) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(text) if self.special else (text,):
            if part.decode() in self.special:
                out.append(self.special[part.decode()])
            elif part:
                places = self.cuts(np.frombuffer(part, np.uint8)).tolist()
                ids = self.ids_of([part[a:b] for a, b in pairwise((0, *places, len(part)))])
                for piece in ids:
                    out += piece
        return out

    def ids_of(self, fragments: list[bytes]) -> list[list[int]]:
        found = list(map(self.cache.new.get, fragments))
        if None not in found:
            return found
        fresh = self.encode_new(self.cache.unknown({f for f, ids in zip(fragments, found) if ids is None}))
        known = self.cache.new
        found = [(fresh[f] if f in fresh else known[f]) if ids is None else ids for f, ids in zip(fragments, found)]
        self.cache.add(fresh, CACHED_BYTES)
        return found

    def encode_new(self, fragments: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of fragments by the library; one that is a single word goes straight to the merges."""
        merge, space, out, others = self.tokenizer.model.tokenize, spelled(" "), {}, []
        for f in fragments:
            text = f.decode()
            if self.one_word.fullmatch(text):
                out[f] = [t.id for t in merge(text.replace(" ", space) if text.isascii() else spelled(text))]
            else:
                others.append(f)
        done = self.tokenizer.encode_batch_fast([f.decode() for f in others], add_special_tokens=False)
        out.update((f, e.ids) for f, e in zip(others, done))
        return out

    def decode_ids(self, ids: list[int]) -> bytes:
        """UTF-8 of the text the library decodes to, special tokens kept; ids unknown to it are left out."""
        table = self.bytes_of
        raw = b"".join([table.get(i, b"") for i in ids])
        return raw.decode("utf-8", errors="replace").encode()


def texts_of(column: pa.Array) -> list[bytes]:
    data, bounds = arrow.text_bytes(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in pairwise(bounds.tolist())]


_coders: dict[str, ForcedSplitCoder] = {}


def coder(file: TokenizerFile) -> ForcedSplitCoder:
    if file.version not in _coders:
        _coders[file.version] = ForcedSplitCoder(file)
    return _coders[file.version]


def encode(df: DataFrame, file: TokenizerFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``. A null text counts as empty and has no ids; null and repeated keys are kept as they are."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [coder(file).encode_text(t) for t in texts_of(batch["text"])]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = arrow.text_only(df, key, text)
    return arrow.map_batches(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, file: TokenizerFile, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``. Null ids give an empty text; null entries and ids outside the vocabulary are left out."""

    def run(batches):
        for batch in batches:
            texts = [coder(file).decode_ids(x or ()).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.selectExpr(f"`{key}` AS doc_id", f"`{ids}` AS ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, file: TokenizerFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, and the ids decoded, in one pass over the texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, counts, ids_digest, text_digest = coder(file), [], [], []
        for t in texts_of(batch["text"]):
            ids = c.encode_text(t)
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_digest.append(hashlib.sha256(c.decode_ids(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = arrow.text_only(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow.map_batches(rows, step, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
