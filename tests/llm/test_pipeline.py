"""Every stage of the pipeline on the input that the one before left, against brute force."""

import corpus_pipeline
import pytest

from dimsift.llm import quality_net
from dimsift.llm.tokenizer_file import default_path
from dimsift.storage import materialize

from .test_dedup import brute_jaccard, brute_lines, brute_substring, words
from .test_tokenizers import check_packed, library_ids

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def left(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(left):
    assert all(sorted(df.columns) == sorted(COLUMNS) for df in left[:-1])
    for df in left[1:-1]:
        assert all(r["n_chars"] == len(r["text"]) and r["lang"] and r["source"] for r in df.collect())


def test_quality(spark, left):
    model = quality_net.fit(left[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality_net.score(left[0], model).collect()
    before = texts(left[0])
    assert texts(left[1]) == {r["doc_id"]: before[r["doc_id"]] for r in scored if r["predicted"] == 1}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(clean & set(texts(left[1]))) >= 0.98 * len(clean)


def test_lines(left):
    before = list(texts(left[1]).items())
    assert texts(left[2]) == {i: t for i, _, gone, t in brute_lines(before) if not gone or words(t)}


def test_near_copies(left):
    before = texts(left[2])
    assert texts(left[3]) == {i: before[i] for i, found, _, _ in brute_jaccard(list(before.items())) if i == found}


def test_passages(left):
    before = texts(left[3])
    expected = {i: (t if gone else before[i]) for i, _, gone, t in brute_substring(list(before.items())) if not gone or words(t)}
    assert texts(left[4]) == expected


def test_packed(left):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    ids = {i: library_ids(lib, t) for i, t in texts(left[4]).items()}
    check_packed(left[5].collect(), ids, 4096, 1)


def test_run_and_empty_input(spark, left):
    assert corpus_pipeline.run(spark, SF).count() == left[-1].count()
    docs = left[0].where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_odd_rows(spark, left):
    """Nulls in every column, empty and repeated rows, and one more column."""
    rows = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, left[0].schema).unionByName(left[0].select(COLUMNS)).selectExpr(*COLUMNS, "1 AS key")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.where("doc_id IS NULL").count() == 2
