"""Blocks of ids: round trips, reading parts, and documents against the tokenizer library."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dimsift.llm import id_blocks
from dimsift.llm.queries import QUERIES
from dimsift.llm.tokenizer_file import default_path

from ..conftest import DATA
from .conftest import ODD

IDS = st.integers(0, 9) | st.integers(0, 49407) | st.sampled_from((0, (1 << 32) - 1, 1 << 31))
LISTS = st.lists(IDS, max_size=300) | st.integers(250, 700).flatmap(lambda n: st.lists(st.integers(30_000, 30_020), min_size=n, max_size=n))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, id_blocks.END_ID]


def in_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(ids=LISTS, percentile=st.sampled_from((1, 50, 90, 100)))
def test_blocks(ids, percentile):
    data, starts = id_blocks.encode_blocks(np.array(ids, np.uint64), percentile)
    assert len(data) == starts[-1] and len(starts) == -(-len(ids) // id_blocks.BLOCK) + 1
    assert id_blocks.decode_blocks(np.frombuffer(data, np.uint8), starts[:-1])[: len(ids)].tolist() == ids


def test_outliers_go_to_the_list():
    ids = np.arange(1000, 1000 + id_blocks.BLOCK, dtype=np.uint64) % 8 + 1000
    ids[[3, 99]] = (70_000, (1 << 32) - 1)
    data, starts = id_blocks.encode_blocks(ids)
    least, width, odd = struct.unpack_from("<IBB", data)
    assert (least, width, odd) == (1000, 3, 2) and len(data) == 6 + 3 * id_blocks.BLOCK // 8 + 2 * 5
    assert (np.frombuffer(data, np.uint8)[-10:-8] == (3, 99)).all()
    assert (id_blocks.decode_blocks(np.frombuffer(data, np.uint8), starts[:-1]) == ids).all()


@settings(max_examples=50, deadline=None)
@given(documents=st.lists(LISTS, max_size=6), data=st.data())
def test_files(documents, data):
    keys = [None if i == 1 else f"k é{i}" for i in range(len(documents))]
    file = id_blocks.IdFile(id_blocks.file_of(keys, [in_bytes(d) for d in documents]))
    flat = [x for d in documents for x in d]
    assert file.keys == keys and file.ids == len(flat)
    assert [file.document(i).tolist() for i in range(len(documents))] == documents
    first = data.draw(st.integers(0, len(flat)))
    end = data.draw(st.integers(first, len(flat)))
    assert file.read(first, end).tolist() == flat[first:end]
    with pytest.raises(IndexError):
        file.read(0, len(flat) + 1)


def test_damaged_files():
    good = id_blocks.file_of(["a"], [in_bytes(range(500))])
    for bad in (b"", good[:-1], good[:50] + bytes([good[50] ^ 1]) + good[51:], b"X" + good[1:]):
        with pytest.raises(id_blocks.BadFile):
            id_blocks.IdFile(bad)


def expected(rows, library):
    """Documents in order, as plain lists."""
    out, at = [], 0
    for key, text in rows:
        ids = library(text)
        out.append((key, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [id_blocks.FILE_IDS, 40])
def test_odd_rows(spark, frame, word_file, library, monkeypatch, file_ids):
    monkeypatch.setattr(id_blocks, "FILE_IDS", file_ids)  # reaches the tasks with the function that is sent
    rows = [*ODD, (9, "a long text " * 30_000), (-4, "first"), (8, "Eight")]
    folder = id_blocks.write_ids(frame(rows), word_file)
    found = id_blocks.read_ids(spark, folder).orderBy("start").collect()
    # rows without a key first; rows of one key in any order
    keys = [None, "-4", "1", "2", "3", "4", "4", "5", "6", "8", "9"]
    assert [r.doc_id for r in found] == keys
    texts = {str(d) if d is not None else None: t for d, t in rows}
    assert [tuple(r) for r in found] == expected([(k, texts[k]) for k in keys], library)
    digests = id_blocks.read_digests(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in digests] == [(k, at, n, zlib.crc32(in_bytes(ids))) for k, at, n, ids in expected([(k, texts[k]) for k in keys], library)]


def test_one_key_for_all_rows(spark, frame, word_file, library):
    rows = [(7, f"text {i % 50}") for i in range(400)]
    found = id_blocks.read_ids(spark, id_blocks.write_ids(frame(rows), word_file)).orderBy("start").collect()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert sorted(r.ids for r in found) == sorted(library(t) for _, t in rows)


def test_an_empty_table(spark, frame, word_file):
    folder = id_blocks.write_ids(frame([]), word_file)
    assert id_blocks.read_ids(spark, folder).collect() == [] and id_blocks.read_digests(spark, folder).collect() == []


def test_files_of_lost_attempts_do_not_count(spark, frame, word_file):
    from dimsift.llm.warc import file_system

    folder = id_blocks.write_ids(frame([(1, "a"), (2, "b")]), word_file)
    store, root = file_system(f"{folder}/data")
    with store.open_output_stream(f"{root}/part-00000-999999-00000{id_blocks.SUFFIX}", compression=None) as out:
        out.write(id_blocks.file_of(["1"], [in_bytes([5, 6, 7])]))
    assert [r.doc_id for r in id_blocks.read_digests(spark, folder).orderBy("start").collect()] == ["1", "2"]


def test_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = QUERIES["op11_id_blocks"](spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in found] == [
        (d, at, n, zlib.crc32(in_bytes(ids))) for d, at, n, ids in expected(docs, library)
    ]
