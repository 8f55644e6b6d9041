"""Line labelling, quality classifier and nearest neighbours."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from dimsift.llm import hash_forest, labels, line_crf, quality_net
from dimsift.llm.queries import QUERIES

from ..conftest import DATA
from .conftest import ODD

BIGGER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    "", None, " \n ", "a b c a b c a b c", "x\nx\n\nx y\nx y \n", "# * $ % & | < > é🙂", "one\ttwo\x0bthree", "w " * 60, "\n".join(["same line here"] * 30),
    " ".join(f"w{i}" for i in range(80)), "é ü " * 20 + "\n| a | b |\n| a | b |", "long " * 40_000,
]


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    often = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def chain(seed=0):
    draw = np.random.default_rng(seed)
    return line_crf.Chain(draw.normal(size=len(line_crf.FEATURES)), float(draw.normal()), draw.normal(size=(2, 2)))


def test_base_counts(frame):
    rows = [*enumerate(TEXTS), *ODD]
    found = line_crf.judge(frame(rows), chain()).collect()
    got = [(r["doc_id"], *r[1:7]) for r in found]
    assert sorted(got, key=str) == sorted(((i, *base_counts(t)) for i, t in rows), key=str)
    assert all(not r["kept"] or not r["base_failed"] for r in found)
    assert line_crf.judge(frame([]), chain()).collect() == []


def test_base_counts_of_given_documents(spark):
    found = {r["doc_id"]: tuple(r[1:7]) for r in QUERIES["op4_line_labelling"](spark, DATA).collect()}
    assert found == {r["doc_id"]: base_counts(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_viterbi_against_all_markings():
    draw = np.random.default_rng(1)
    for seed in range(20):
        c = chain(seed)
        lengths = draw.integers(1, 7, 5)
        text = np.repeat([3, 4, 6, 7, 9], lengths)
        figures = draw.normal(size=(len(text), len(line_crf.FEATURES)))
        marks, score, at = c.content(text, figures), figures @ c.weights + c.rest, 0
        for n in lengths:
            own = score[at : at + n]
            worth = lambda m: sum(s for s, x in zip(own, m) if x) + sum(c.moves[a, b] for a, b in zip(m, m[1:]))  # noqa: B023, E731
            assert worth(marks[at : at + n].astype(int)) == pytest.approx(max(map(worth, product((0, 1), repeat=n))))
            at += n
    assert len(chain().content(np.zeros(0, int), np.zeros((0, len(line_crf.FEATURES))))) == 0


def test_chain_learns_to_tell_lines():
    draw = np.random.default_rng(2)
    docs = [(draw.normal(loc=y, size=(draw.integers(1, 9), len(line_crf.FEATURES))), y) for y in draw.integers(0, 2, 200)]
    c = line_crf.fit_chain(docs)
    marks = [c.content(np.zeros(len(x), int), x).mean() > 0.5 for x, _ in docs]
    assert np.mean([m == y for m, (_, y) in zip(marks, docs)]) > 0.95
    assert line_crf.fit_chain([]).content(np.zeros(2, int), np.zeros((2, len(line_crf.FEATURES)))).all()


def test_lines_of_mixed_documents_are_told_apart():
    """Labels are of documents; a fifth of the lines of each is of the other kind."""
    draw = np.random.default_rng(7)
    n, docs, truth = len(line_crf.FEATURES), [], []
    for y in draw.integers(0, 2, 300).tolist():
        kinds = np.full(draw.integers(5, 20), y)
        start = draw.integers(0, len(kinds) - 1)
        kinds[start : start + max(1, len(kinds) // 5)] = 1 - y
        docs.append((draw.normal(loc=kinds[:, None] * 1.5, size=(len(kinds), n)), y))
        truth.append(kinds)
    marked = line_crf.line_marks(docs)
    assert np.mean(np.concatenate([m == t for (_, m), t in zip(marked, truth)])) > 0.9
    c = line_crf.fit_chain(marked)
    found = [c.content(np.zeros(len(x), int), x) for x, _ in docs]
    assert np.mean(np.concatenate([f == t for f, t in zip(found, truth)])) > 0.95
    assert np.mean([0 < f.mean() < 1 for f in found]) > 0.9
    # with one mark for all lines of a document, the chain learns never to change it
    whole = line_crf.fit_chain(docs)
    assert np.mean([0 < whole.content(np.zeros(len(x), int), x).mean() < 1 for x, _ in docs]) < 0.1


def test_shares_of_given_documents(spark):
    """Documents with lines of both kinds have shares between 0 and 1."""
    shares = [r["content_share"] for r in QUERIES["op4_line_labelling"](spark, BIGGER).collect()]
    assert sum(0 < s < 1 for s in shares) >= 20


def test_long_documents_take_part_in_the_fit(spark):
    """All labelled documents are long: a part of each is learned from."""
    clean = "\n".join(f"This is sentence number {k} of a text with ordinary words." for k in range(200))
    poor = "\n".join("$$$ BUY | NOW | FREE !!! $$$ ### ***" for _ in range(200))
    rows = [(i, (clean if i % 2 else poor).replace("number", f"number {i}")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS key", "text AS body", "1 AS doc_id", "2 AS label")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    c = line_crf.fit(docs, known, key="key", text="body")
    lines = line_crf.Lines(pa.array([clean, poor, f"{clean}\n{poor}"]))
    marks = c.content(lines.text, lines.figures)
    assert [round(float(marks[lines.text == i].mean()), 1) for i in range(3)] == [1.0, 0.0, 0.5]


def held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    return {i: q for i, q in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0}


def test_line_labelling_on_held_out_documents(spark):
    found = {r["doc_id"]: r for r in QUERIES["op4_line_labelling"](spark, BIGGER).collect()}
    truth = {i: q for i, q in held_out(spark).items() if not found[i]["base_failed"]}
    assert all(found[i]["kept"] for i, q in truth.items() if q == 1)
    assert np.mean([found[i]["kept"] == q for i, q in truth.items()]) > 0.95


def test_classifier_on_held_out_documents(spark):
    found = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, BIGGER).collect()}
    assert len(found) == spark.read.parquet(f"{BIGGER}/documents.parquet").count()
    truth = held_out(spark)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    good, poor = ([found[i]["score"] for i, q in truth.items() if q == want] for want in (1, 0))
    assert np.mean([g > p for g in good for p in poor]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert np.mean([found[i]["predicted"] == q for i, q in truth.items()]) > 0.95


def test_training_rows(spark):
    rows = [(i, i % 2, 0) for i in range(200)] + [(1, 0, 0), (2, 1, 0), (None, 1, 0), (900, None, 0)]
    chosen = labels.training_ids(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), 50).collect()
    assert len(chosen) == 50 == len({r["doc_id"] for r in chosen})
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in chosen)


def test_classifier_on_odd_tables(spark, frame):
    model = quality_net.QualityModel(np.ones((quality_net.ROWS, quality_net.DIMS), np.float32), quality_net.fit_network(
        np.zeros((0, 2 * quality_net.DIMS)), np.zeros(0), np.zeros(0, bool)))
    found = quality_net.score(frame([*ODD, (9, "word " * 60_000)]), model).collect()
    assert len(found) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    assert quality_net.score(frame([]), model).collect() == []
    assert quality_net.accepted(frame(ODD), model).columns == frame(ODD).columns
    # no labels at all: no rows to learn from, and every document has the same score
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in quality_net.score(frame(ODD), quality_net.fit(frame(ODD), none)).collect()}) == 1


def test_neighbour_sums_by_hand():
    column = pa.array(["a b c", "d", None])
    tokens = quality_net.Tokens(column)
    dims, signs = quality_net.own_vectors()
    into = np.zeros(quality_net.ROWS * quality_net.DIMS)
    quality_net.neighbour_sums(tokens, dims, signs, into)
    expected = np.zeros((quality_net.ROWS, quality_net.DIMS))
    for rows in (tokens.word, tokens.shape):
        for a in range(3):
            for b in range(3):
                if a != b:
                    for d, s in zip(dims[rows[b]], signs[rows[b]]):
                        expected[rows[a], d] += s
    assert np.array_equal(into.reshape(expected.shape), expected)


def test_pooled_means():
    vectors = np.random.default_rng(0).normal(size=(quality_net.ROWS, quality_net.DIMS)).astype(np.float32)
    column = pa.array(["The the, THE!! end", None, "", "x"])
    tokens = quality_net.Tokens(column)
    assert len(set(tokens.word[:3])) == 1 and len(set(tokens.shape[:3])) == 3
    pooled = quality_net.pool(column, vectors)
    assert np.allclose(pooled[0, : quality_net.DIMS], vectors[tokens.word[:4]].mean(axis=0), atol=1e-6)
    assert np.allclose(pooled[0, quality_net.DIMS :], vectors[tokens.shape[:4]].mean(axis=0), atol=1e-6)
    assert not pooled[1:3].any()


def brute_nearest(ids, vectors, queries, k=5):
    out = {}
    for q in queries:
        own = vectors[np.flatnonzero(ids == q)[0]]
        cosine = vectors @ own / np.linalg.norm(vectors, axis=1) / np.linalg.norm(own)
        best = {}
        for i in np.lexsort((ids, -cosine)):
            if ids[i] != q:
                best.setdefault(int(ids[i]), cosine[i])
        out[int(q)] = list(best.items())[:k]
    return out


@pytest.mark.parametrize("path, part", [("/root/testdata/sf0.1", {}), ("/root/testdata/sf0.1", {"recall": 0.93}), ("/root/testdata/sf0.01", {})])
def test_recall(spark, path, part):
    """Given vectors point anywhere; the second case compares fewer of the rows."""
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toArrow()
    ids, vectors = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), np.float64)
    wanted = brute_nearest(ids, vectors, ids[ids % 50 == 0])
    found = {}
    if part:
        index = hash_forest.build(spark.read.parquet(f"{path}/embeddings.parquet"))
        answer = hash_forest.search(index, index.where("vec_id % 50 = 0"), **part)
    else:
        answer = QUERIES["op7_hash_prefix_forest"](spark, path)
    for r in answer.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(wanted) and all(len(x) == 5 for x in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    exact = {q: dict(zip(ids.tolist(), vectors @ v / np.linalg.norm(vectors, axis=1) / np.linalg.norm(v))) for q, v in zip(ids.tolist(), vectors) if q in found}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q, some in found.items() for i, s in some)


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.0]), (100, [2.0, 0.0]), (7, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [2.0, 2.0]), (1, None), (150, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (7, [0.0, 1.0]), (200, None), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS strings", "2 AS vec", "3 AS score")
    index = hash_forest.build(df)
    found = hash_forest.search(index, index.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()
    half = np.sqrt(0.5)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [
        (50, 1, 100), (50, 2, 2), (50, 3, 3), (50, 4, 7), (100, 1, 50), (100, 2, 2), (100, 3, 3), (100, 4, 7)]
    assert [r["score"] for r in found] == pytest.approx([1, half, half, 0] * 2)


def test_no_vectors(spark):
    index = hash_forest.build(spark.createDataFrame([(50, None)], "vec_id long, embedding array<float>"))
    assert hash_forest.search(index, index).collect() == []


def test_queries_in_parts_and_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 8))
    vectors[100:140] = vectors[0]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = hash_forest.build(df)
    # so many candidates that every answer is exact
    ask = lambda: hash_forest.search(index, index.where("vec_id % 10 = 0"), recall=2)
    whole = ask().collect()
    monkeypatch.setattr(hash_forest, "QUERY_ROWS", 7)
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 50)
    assert sorted(ask().collect()) == sorted(whole)
    assert [r["vec_id"] for r in sorted(whole) if r["query_id"] == 0] == [100, 101, 102, 103, 104]


def test_each_length_is_a_forest_of_its_own(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=3 + i % 3).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = hash_forest.build(df)
    found = {}
    for r in hash_forest.search(index, index.where("vec_id % 10 = 0"), recall=2).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    for dims in (3, 4, 5):
        ids = np.array([i for i, v in rows if len(v) == dims])
        vectors = np.array([v for _, v in rows if len(v) == dims])
        for q, best in brute_nearest(ids, vectors, ids[ids % 10 == 0]).items():
            assert found.pop(q) == [i for i, _ in best]
    assert not found


def test_candidates_follow_the_vectors():
    """Vectors in groups need fewer candidates than ones that point anywhere, and neither needs all."""
    draw = np.random.default_rng(6)
    anywhere = draw.normal(size=(900, 32))
    groups = draw.normal(size=(60, 32))[np.arange(900) % 60] + 0.05 * draw.normal(size=(900, 32))
    hashes = hash_forest.Hashes(32)
    turns, wanted = hashes.rotations(), []
    for vectors in (groups, anywhere):
        strings = hashes.strings(vectors, turns)
        forest = hash_forest.Forest(np.arange(900), vectors, strings, hashes.bits, 5)
        wanted.append(forest.wanted)
        assert hash_forest.Forest(np.arange(900), vectors, strings, hashes.bits, 5, 2).wanted == 900
    assert wanted[0] <= 90 and wanted[0] < wanted[1] < 900


def test_strings_share_prefixes_when_near():
    hashes = hash_forest.Hashes(16, trees=20)
    draw = np.random.default_rng(5)
    a = draw.normal(size=(200, 16))
    near, far = a + 0.1 * draw.normal(size=a.shape), draw.normal(size=a.shape)
    turns = hashes.rotations()
    own, close, other = (hashes.strings(x, turns) for x in (a, near, far))
    depth = lambda x: np.mean([hashes.bits - int(v).bit_length() for v in (own ^ x).ravel()])
    assert depth(close) > 2 * depth(other) and np.array_equal(own, hashes.strings(3 * a, turns))
