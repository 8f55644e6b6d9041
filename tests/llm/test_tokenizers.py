"""Encoders against the library, the digest cache, and packing."""

import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dimsift.llm import forced_split, packing, token_cache, word_bpe
from dimsift.llm.queries import QUERIES
from dimsift.llm.tokenizer_file import default_path

from ..conftest import DATA
from .conftest import ODD

PARTS = (
    "a", "S", "'", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "\x1c", "\x00", "é", "É",
    "漢字", "🙂", "é", "9", "²", "½", ".", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "ß", "İ", "Σ",
    "ل", "Ⅷ", "ab", "'re", "''", "x'", "--", "_", "ŉ", "Ɓ", "ª", "Word", "Thinkable",
)
TEXTS = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30)


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(default_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(text=TEXTS)
def test_byte_coder(byte_file, libraries, text):
    lib, coder = libraries["byte_bpe_50k.json"], forced_split.coder(byte_file)
    ids = library_ids(lib, text)
    assert coder.encode_text(text.encode()) == ids
    assert coder.decode_ids(ids) == lib.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=1500, deadline=None)
@given(text=TEXTS)
def test_word_coder(word_file, libraries, text):
    assert word_bpe.word_coder(word_file).encode(text) == word_bpe.pack(library_ids(libraries["word_bpe_49k.json"], text))


def test_special_strings_are_looked_for_apart(word_file, libraries):
    """The search for unusual characters has one class to test, not a choice at every character."""
    coder = word_bpe.WordCoder(word_file)
    assert "|" not in coder.unusual.pattern and coder.special
    for s in coder.special:
        for text in (s, f"plain words {s}", f"{s} plain", f"a{s}b, again {s}{s}", s[:-1], s.upper()):
            assert coder.encode(text) == word_bpe.pack(library_ids(libraries["word_bpe_49k.json"], text))


def test_every_plain_character(word_file, libraries):
    for i in range(word_bpe.PLAIN_END + 64):
        text = f"a{chr(i)}B {chr(i)}{chr(i)} x"
        assert word_bpe.word_coder(word_file).encode(text) == word_bpe.pack(library_ids(libraries["word_bpe_49k.json"], text))


def test_a_full_cache_changes_nothing(byte_file, word_file, libraries, monkeypatch):
    monkeypatch.setattr(forced_split, "CACHE_FRAGMENTS", 3)
    monkeypatch.setattr(word_bpe, "CACHE_PARTS", 3)
    text = "one two three four five one two six seven one"
    assert forced_split.ForcedSplitCoder(byte_file).encode_text(text.encode()) == library_ids(libraries["byte_bpe_50k.json"], text)
    assert word_bpe.WordCoder(word_file).encode(text) == word_bpe.pack(library_ids(libraries["word_bpe_49k.json"], text))


def test_cuts_are_where_no_token_spans(byte_file):
    import numpy as np

    coder = forced_split.coder(byte_file)
    cuts = coder.cuts(np.frombuffer(b"Some words, it's  a test", np.uint8)).tolist()
    assert cuts and 4 in cuts and 14 not in cuts and 15 not in cuts


def test_ids_unknown_to_the_vocabulary(byte_file, spark):
    rows = spark.createDataFrame([(1, [50256, 999999, 64, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert dict(forced_split.decode(rows, byte_file).collect()) == {1: "<|endoftext|>a", 2: "", 3: ""}


def test_encode_then_decode(byte_file, frame, libraries):
    rows = [*ODD, (7, "Word " * 50_000), (8, "é" * 30_000)]
    encoded = forced_split.encode(frame(rows), byte_file)
    assert sorted(map(str, encoded.collect())) == sorted(
        str(type(r)(doc_id=i, ids=library_ids(libraries["byte_bpe_50k.json"], t))) for (i, t), r in zip(rows, encoded.collect())
    )
    back = [tuple(r) for r in forced_split.decode(encoded, byte_file).collect()]
    assert sorted(back, key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert forced_split.encode(frame([]), byte_file).collect() == []


def test_byte_query(spark, libraries):
    lib = libraries["byte_bpe_50k.json"]
    found = {r["doc_id"]: r for r in QUERIES["op2_forced_boundary_bpe"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids, got = library_ids(lib, r["text"]), found.pop(r["doc_id"])
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not found


def test_count_query(spark, libraries):
    found = {r["doc_id"]: r for r in QUERIES["op9_token_counts"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n = len(library_ids(libraries["word_bpe_49k.json"], r["text"]))
        got = found.pop(r["doc_id"])
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len(r["text"].encode()), n, n > 2048)
    assert not found


def test_cache_is_used_and_grows(spark, frame, word_file, byte_file):
    cache = token_cache.new_cache(spark)
    first = [(1, "One  two"), (2, "one two"), (3, "three"), (3, "other text"), (None, "three"), *ODD]
    counted = token_cache.count_tokens(frame(first), word_file, cache).collect()
    assert len(counted) == len(first)
    stored = spark.read.parquet(cache)
    rows = stored.count()
    assert rows == stored.select("digest").distinct().count()
    token_cache.count_tokens(frame(first), word_file, cache).collect()
    assert spark.read.parquet(cache).count() == rows
    # a count in the cache is believed, so it was not encoded again
    stored = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    stored.withColumn("tokenizer", F.lit(byte_file.version)).write.mode("append").parquet(cache)
    assert all(r["n_tokens"] != 77 for r in token_cache.count_tokens(frame(first), word_file, cache).collect())
    assert token_cache.count_tokens(frame([]), word_file, cache).collect() == []


def test_many_texts_of_one_id_or_none(spark, frame, word_file, libraries):
    """Joined rows grow with the rows, however many share a key."""
    rows = [(7 if i % 2 else None, f"text number {i % 2000} here") for i in range(6000)]
    counted = token_cache.count_tokens(frame(rows), word_file, token_cache.new_cache(spark)).collect()
    expected = [(i, len(t), len(library_ids(libraries["word_bpe_49k.json"], t)), False) for i, t in rows]
    assert sorted(map(tuple, counted), key=str) == sorted(expected, key=str)


def test_digest_keeps_special_strings_apart(word_file, libraries):
    pattern = token_cache.special_pattern(word_file)
    digest = lambda t: token_cache.content_digest(t, pattern)
    assert digest("A  b\n") == digest("a b ") and digest("<|endoftext|>") != digest("<|ENDOFTEXT|>")
    assert digest("a<|endoftext|>b") != digest("a<|startoftext|>b") and digest("") != digest(" ")


def sizes(kinds):
    return sum(many for _, many in kinds)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 60), max_size=12))
def test_plan_places_every_piece(counts):
    kinds = packing.plan(counts, 30)
    placed = {}
    for lengths, many in kinds:
        assert sum(lengths) <= 30 and many > 0 and sum(3 * n > 30 for n in lengths) <= 2
        for n in lengths:
            placed[n] = placed.get(n, 0) + many
    assert placed == counts
    # never more than first fit, which places one piece after the other
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(30 - n)
        else:
            gaps[at] -= n
    assert sizes(kinds) <= len(gaps) * 1.05 + 2


def check_packed(rows, ids_of, capacity, end_id):
    sequences, seen = {}, {}
    for r in rows:
        ids = ids_of[r["doc_id"]] + [end_id]
        part = ids[r["start"] : r["start"] + capacity]
        assert r["start"] == r["piece"] * capacity and r["length"] == len(part)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append(r["piece"])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, found in seen.items():
        assert sorted(found) == list(range(-(-(len(ids_of[i]) + 1) // capacity)))
    assert set(seen) == set(ids_of)
    return len(sequences)


def test_pack_query(spark, libraries):
    ids = {r["doc_id"]: library_ids(libraries["word_bpe_49k.json"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    n = check_packed(QUERIES["op10_best_fit_packing"](spark, DATA).collect(), ids, 4096, 1)
    assert n <= sum(len(x) + 1 for x in ids.values()) / 4096 * 1.02 + 1


def test_pack_many_equal_and_odd(frame, word_file, libraries, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    draw = random.Random(3)
    rows = [(i, "word " * draw.choice((1, 5, 9, 30))) for i in range(100)] + [(200, None), (201, "")]
    ids = {i: library_ids(libraries["word_bpe_49k.json"], t) for i, t in rows}
    check_packed(packing.pack(frame(rows), word_file, 12, 7).collect(), ids, 12, 7)
    assert packing.pack(frame([]), word_file).collect() == []
    # repeated rows and rows without an id are packed each
    assert len(packing.pack(frame(ODD), word_file).collect()) == len(ODD)
