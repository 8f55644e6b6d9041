import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dimsift.operators import blocks as block_module
from dimsift.operators import search as search_module
from dimsift.operators import topk
from dimsift.operators.search import Limits, merge_top_k, search, search_distinct, top_document
from dimsift.operators.topk import RunningTopK
from dimsift.sources.vectors import read_blocks, read_vectors, write_vectors

from .conftest import approx

# limits that make several blocks of queries
BLOCKS = Limits(broadcast_bytes=400)
NARROW = Limits(state_bytes=600_000)


def rows(run, *keys):
    keys = keys or ("query_id",)
    return sorted((*[r[k] for k in keys], r["rank"], r["doc_id"], r["score"]) for r in run.collect())


def random_tables(spark, n_docs=300, n_queries=20, dims=8, seed=0, copies=True):
    rng = np.random.default_rng(seed)
    # few distinct values, so that many scores tie exactly
    docs = rng.integers(-2, 3, (n_docs, dims)).astype(float)
    if copies:
        docs[: n_docs // 3] = docs[0]
    queries = rng.integers(-2, 3, (n_queries, dims)).astype(float)
    d = spark.createDataFrame(
        [(f"d{i}", v.tolist()) for i, v in enumerate(docs)], "doc_id string, vec array<float>"
    ).repartition(7)
    q = spark.createDataFrame(
        [(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vec array<float>"
    )
    return d, q, docs, queries


def brute_force(docs, queries, k):
    out = []
    for i, q in enumerate(queries):
        scored = sorted(((-float(v @ q), f"d{j}") for j, v in enumerate(docs)))[:k]
        out += [(f"q{i}", rank, d, -s) for rank, (s, d) in enumerate(scored)]
    return sorted(out)


def test_micro_order(micro):
    run = search(micro.docs, micro.queries, 10, "m")
    assert run.columns == ["query_id", "Q0", "doc_id", "rank", "score", "run"]
    found = rows(run)
    assert [r[2] for r in found] == ["3", "1", "2", "5", "4"]
    assert [r[3] for r in found] == approx([1.0, 0.5, 0.5, 0.125, 0.0])
    assert run.select("Q0", "run").distinct().collect() == [("Q0", "m")]


def test_k_larger_than_corpus_gives_corpus(micro):
    assert search(micro.docs, micro.queries, 1000).count() == 5


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_equals_brute_force_with_ties_and_copies(spark, k):
    d, q, docs, queries = random_tables(spark)
    expected = brute_force(docs, queries, k)
    assert rows(search(d, q, k)) == expected
    assert rows(search(d, q, k, limits=BLOCKS)) == expected
    assert rows(search(d, q, k, limits=NARROW)) == expected


@pytest.mark.parametrize("k", [1, 7, 100])
def test_more_queries_than_documents(spark, k):
    d, q, docs, queries = random_tables(spark, n_docs=30, n_queries=90)
    assert rows(search(d, q, k, limits=BLOCKS)) == brute_force(docs, queries, k) == rows(search(d, q, k))


def test_more_queries_than_documents_move_no_found_row(spark, monkeypatch):
    """Each task has all of a query's best, in order, so nothing found is dealt out to be merged."""
    d, q, docs, queries = random_tables(spark, n_docs=60, n_queries=90)
    monkeypatch.setattr(search_module, "FEW_SCORES", 1000)
    found = search(d, q, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    monkeypatch.setattr(search_module, "SCORE_BLOCK", 30_000)  # few queries and documents at a time
    assert rows(search(d, q, 7)) == rows(found) == brute_force(docs, queries, 7)


@pytest.mark.parametrize("limits", [Limits(), BLOCKS])
def test_repeated_keys_are_an_error(spark, limits):
    d, q, _, _ = random_tables(spark)
    with pytest.raises(ValueError, match="different"):
        search(d, q.unionByName(q.limit(1)), 2, limits=limits)


@pytest.mark.parametrize("limits", [Limits(), BLOCKS])
def test_corpus_without_finite_vectors(spark, micro, limits):
    odd = spark.createDataFrame([(f"n{i}", [float("nan")] * 4) for i in range(3)], micro.docs.schema)
    assert search(odd, micro.queries, 2, limits=limits).count() == 0


def test_first_look_changes_no_row(spark, monkeypatch):
    """A floor from few documents, from all, and from none."""
    d, q, docs, queries = random_tables(spark, n_docs=200)
    for first in (1, 20, 1000):
        monkeypatch.setattr(search_module, "FLOOR_DOCS", first)
        assert rows(search(d, q, 4)) == brute_force(docs, queries, 4)
    monkeypatch.setattr(search_module, "_floors", lambda *_: None)
    assert rows(search(d, q, 4)) == brute_force(docs, queries, 4)


@pytest.mark.parametrize("spare_ids", [1_000_000, 20])
def test_running_state_has_a_fixed_size(monkeypatch, spare_ids):
    monkeypatch.setattr(topk, "SCORE_BLOCK", 40)
    monkeypatch.setattr(topk, "MERGE_ROWS", 10)
    monkeypatch.setattr(topk, "SPARE_IDS", spare_ids)
    rng = np.random.default_rng(1)
    docs = rng.integers(-2, 3, (500, 6)).astype(np.float32)
    queries = rng.integers(-2, 3, (4, 6)).astype(np.float32)
    best = RunningTopK(queries, 5)
    ids = [f"d{i}" for i in range(500)]
    size = sum(a.nbytes for a in vars(best).values() if isinstance(a, np.ndarray))
    for start in range(0, 500, 50):
        best.add(pa.array(ids[start:start + 50]), docs[start:start + 50])
        assert best.pending <= len(best.found_row)
        assert len(best.ids) <= max(500 if spare_ids > 500 else 0, 2 * best.needed_ids + spare_ids + 50)
    assert sum(a.nbytes for a in vars(best).values() if isinstance(a, np.ndarray)) == size
    out = pa.Table.from_batches(best.result(pa.table({"query_id": [f"q{i}" for i in range(4)]}))).to_pylist()
    found = sorted((r["query_id"], -r["score"], r["doc_id"]) for r in out)
    assert found == sorted((q, -s, d) for q, _, d, s in brute_force(docs, queries, 5))


@pytest.mark.parametrize("k", [1, 4, 30])
def test_running_state_keeps_smaller_ids_of_equal_scores(monkeypatch, k):
    monkeypatch.setattr(topk, "SCORE_BLOCK", 30)
    rng = np.random.default_rng(2)
    docs = rng.integers(0, 2, (200, 3)).astype(np.float32)
    queries = rng.integers(-1, 2, (7, 3)).astype(np.float32)
    best = RunningTopK(queries, k)
    order = rng.permutation(200)
    for some in np.array_split(order, 9):
        best.add(pa.array([f"d{i}" for i in some]), docs[some])
    out = [r for b in best.result(pa.table({"query_id": [f"q{i}" for i in range(7)]})) for r in b.to_pylist()]
    expected = [(q, d, s) for q, _, d, s in brute_force(docs, queries, k)]
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in out) == sorted(expected)


def test_few_products_are_taken_in_double_precision(monkeypatch):
    """Nearly equal documents keep the order of their exact scores, long vectors and short ones; few pairs are multiplied twice."""
    rng = np.random.default_rng(4)
    docs = (rng.normal(size=(1, 32)) + rng.normal(size=(6000, 32)) * 1e-5).astype(np.float32)
    queries = rng.normal(size=(20, 32)).astype(np.float32)
    pairs, real = [], np.einsum
    monkeypatch.setattr(topk.np, "einsum", lambda how, a, b: pairs.append(len(a)) or real(how, a, b))
    for size in (1, 1e-18, 1e12, 1e17):
        best = RunningTopK(queries, 5)
        for start in range(0, 6000, 500):
            best.add(pa.array(range(start, start + 500)), docs[start:start + 500] * np.float32(size))
        out = pa.Table.from_batches(best.result(pa.table({"q": range(20)}), ranked=True))
        exact = (queries.astype(np.float64) @ (docs * np.float32(size)).astype(np.float64).T).astype(np.float32)
        expected = [(q, d) for q in range(20) for d in np.lexsort((np.arange(6000), -exact[q]))[:5]]
        assert list(zip(out["q"].to_pylist(), out["doc_id"].to_pylist())) == expected
    spread, pairs[:] = rng.normal(size=(6000, 32)).astype(np.float32), []
    best = RunningTopK(queries, 5)
    best.add(pa.array(range(6000)), spread)
    assert 0 < sum(pairs) < 20 * 6000 / 100


def test_a_kept_row_takes_few_bytes():
    """Arrays of the running top k and what waits for a merge, for more rows than fit the fixed part."""
    best = RunningTopK(np.zeros((4000, 2)), 1000)
    size = sum(a.nbytes for a in vars(best).values() if isinstance(a, np.ndarray))
    assert size <= 4000 * 1000 * Limits().state_row_bytes
    # 6,980 queries in ten settings, k = 1,000: scans of the corpus
    scans = lambda row_bytes: -(-69_800 * 1000 * row_bytes // Limits().state_bytes)
    assert scans(160) == 21 and scans(Limits().state_row_bytes) == 4


def test_a_task_holds_little_besides_its_kept_rows():
    """Scores and merges take the same memory however many queries and documents there are."""
    rng = np.random.default_rng(3)
    for queries, docs in ((200, 10_000), (4000, 1000)):
        best = RunningTopK(rng.random((queries, 4)), 100)
        ids, vectors = pa.array([f"d{i}" for i in range(docs)]), rng.random((docs, 4)).astype(np.float32)
        tracemalloc.start()
        best.add(ids, vectors)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40_000_000


def test_salted_merge_equals_plain(spark):
    partial = spark.createDataFrame(
        [(f"q{i % 5}", f"d{i}", float(i * 37 % 101)) for i in range(2000)],
        "query_id string, doc_id string, score double",
    )
    plain = merge_top_k(partial, ["query_id"], 7)
    salted = merge_top_k(partial, ["query_id"], 7, tasks=1000)
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_several_keys(spark, micro):
    queries = micro.queries.select("query_id", "vec", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("alpha"))
    run = search(micro.docs, queries, 2, keys=["query_id", "alpha"])
    assert [r[:4] for r in rows(run, "alpha")] == [
        ("a", 0, "3", 1.0), ("a", 1, "1", 0.5), ("b", 0, "3", 1.0), ("b", 1, "1", 0.5),
    ]


def test_rows_without_a_vector_and_empty_sides(spark, micro):
    none = spark.createDataFrame([("x", None)], "doc_id string, vec array<float>")
    assert search(micro.docs.unionByName(none), micro.queries, 10).count() == 5
    assert search(micro.docs.where("false"), micro.queries, 10).count() == 0
    assert search(micro.docs, micro.queries.where("false"), 10).count() == 0
    assert search(micro.docs.where("false"), micro.queries, 10, limits=Limits(broadcast_bytes=1)).count() == 0


@pytest.mark.parametrize("limits", [Limits(), BLOCKS, NARROW])
def test_rows_that_are_not_finite_are_left_out(spark, micro, limits):
    odd = [("n", [float("nan")] * 4), ("i", [float("inf")] * 4), ("0", [1.0, None, 1.0, 1.0])]
    docs = micro.docs.unionByName(spark.createDataFrame(odd, micro.docs.schema))
    queries = micro.queries.unionByName(
        spark.createDataFrame([(f"bad{i}", [float("nan")] * 4) for i in range(9)], micro.queries.schema)
    )
    for k in (2, 10):
        assert rows(search(docs, queries, k, limits=limits)) == rows(search(micro.docs, micro.queries, k))


def test_dimension_mismatch_is_an_error(spark, micro):
    wide = spark.createDataFrame([("q", [1.0] * 5)], "query_id string, vec array<float>")
    with pytest.raises(Exception, match="dimensions"):
        search(micro.docs, wide, 3).collect()


def test_top_document_is_rank_zero(spark):
    d, q, _, _ = random_tables(spark, seed=4)
    first = search(d, q, 9).where("rank = 0").select("query_id", "doc_id", "score")
    assert sorted(top_document(d, q).collect()) == sorted(first.collect())


def test_the_corpus_does_not_move(spark, capsys, tmp_path):
    d, q, _, _ = random_tables(spark)
    d.write.parquet(str(tmp_path / "d"))
    search(spark.read.parquet(str(tmp_path / "d")), q, 3).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    assert "WindowGroupLimit" in plan
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below


def clustered(spark, n_docs=600, centres=12, dims=8, seed=5):
    """Vectors in tight groups, and queries that point at a few of them."""
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((centres, dims)) * 4
    docs = (middles[np.arange(n_docs) % centres] + rng.standard_normal((n_docs, dims)) * 0.05).astype(np.float32)
    queries = (middles[[0, 0, 3]] + rng.standard_normal((3, dims)) * 0.01).astype(np.float32)
    d = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(docs)], "doc_id string, vec array<float>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vec array<float>")
    return d, q


def scanned_rows(df):
    """Rows that the Parquet scans of a plan gave, once it has run."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def in_blocks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "v")
    d, q = clustered(spark)
    write_vectors(d, path, "m", blocks=30)
    return d, q, path


@pytest.mark.parametrize("k", [1, 20, 1000])
@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=130)])
def test_blocks_change_no_row(spark, in_blocks, k, limits):
    d, q, path = in_blocks
    docs, blocks = read_blocks(spark, path)
    expected = rows(search(d, q, k))
    assert rows(search(docs, q, k, blocks=blocks, limits=limits)) == expected
    assert rows(search(read_vectors(spark, path), q, k)) == expected


def test_blocks_out_of_reach_are_not_read(spark, in_blocks, monkeypatch):
    d, q, path = in_blocks
    docs, blocks = read_blocks(spark, path)
    read = []
    for name in ("nearest_blocks", "reached_blocks"):
        real = getattr(block_module, name)
        monkeypatch.setattr(search_module, name, lambda *a, real=real: read.append(real(*a)) or read[-1])
    search(docs, q, 20, blocks=blocks).collect()
    assert 0 < len(set(read[0]) | set(read[1])) < blocks.count() / 2
    # the others are folders that the scan does not open
    some = docs.where(F.col("block").isin(read[0]))
    assert scanned_rows(some) == some.count() < d.count() / 3


def test_blocks_hold_what_they_say(spark, in_blocks):
    _, _, path = in_blocks
    docs, blocks = read_blocks(spark, path)
    table = {r["block"]: r for r in blocks.collect()}
    seen = dict.fromkeys(table, 0)
    for r in docs.collect():
        b = table[r["block"]]
        assert np.linalg.norm(np.array(r["vec"]) - b["centre"]) <= b["radius"] + 1e-9
        seen[r["block"]] += 1
    assert seen == {n: r["vectors"] for n, r in table.items()}


def test_blocks_of_odd_vectors(spark, micro, tmp_path):
    odd = [("n", [float("nan")] * 4), ("i", [float("inf")] * 4), ("0", [1.0, None, 1.0, 1.0]), ("z", [0.0] * 4), ("x", None)]
    docs = micro.docs.unionByName(spark.createDataFrame(odd, micro.docs.schema))
    write_vectors(docs.where("doc_id <> 'x'"), str(tmp_path / "odd"), "m", blocks=3)
    stored, blocks = read_blocks(spark, str(tmp_path / "odd"))
    assert stored.count() == 9
    assert rows(search(stored, micro.queries, 10, blocks=blocks)) == rows(search(docs, micro.queries, 10))
    for name, given in (("none", docs.where("doc_id = 'n'")), ("empty", docs.where("false"))):
        write_vectors(given, str(tmp_path / name), "m", blocks=3)
        stored, blocks = read_blocks(spark, str(tmp_path / name)) if name == "none" else (given.withColumn("block", F.lit(0)), blocks.where("false"))
        assert search(stored, micro.queries, 2, blocks=blocks).count() == 0


@pytest.mark.parametrize("limits", [Limits(), BLOCKS])
def test_equal_vectors_are_searched_once(spark, monkeypatch, limits):
    d, q, docs, queries = random_tables(spark, n_queries=9)
    asked = q.select("query_id", F.explode(F.array(*map(F.lit, "abc"))).alias("setting"), "vec")
    # all of setting c, and one more, have one vector; -0.0 is 0.0
    zero = F.array(*[F.lit(z).cast("float") for z in (0.0, -0.0) * 4])
    asked = asked.withColumn("vec", F.when((F.col("setting") == "c") | (F.col("query_id") == "q4"), zero).otherwise(F.col("vec")))
    searched = []
    real = search_module._search_stored
    monkeypatch.setattr(search_module, "_search_stored", lambda d, q, *a: searched.append(q.count()) or real(d, q, *a))
    keys = ["query_id", "setting"]
    found = search_distinct(d, asked, 5, "r", keys, limits)
    assert searched == [asked.select("vec").distinct().count()] and searched[0] <= 9
    assert found.columns == search(d, asked, 5, "r", keys).columns
    assert rows(found, *keys) == rows(search(d, asked, 5, "r", keys), *keys)


def test_equal_vectors_and_empty_sides(spark, micro):
    assert search_distinct(micro.docs, micro.queries.where("false"), 3).count() == 0
    assert search_distinct(micro.docs.where("false"), micro.queries, 3).count() == 0
    with pytest.raises(ValueError, match="different"):
        search_distinct(micro.docs, micro.queries.unionByName(micro.queries.withColumn("vec", F.reverse("vec"))), 3)


@pytest.mark.parametrize("kind", ["spread", "tied", "skewed", "far"])
def test_guessed_floor_changes_no_row(kind, monkeypatch):
    """Many ties, floors guessed too high, vectors beyond single precision, and merges while rows are found."""
    rng = np.random.default_rng(5)
    docs = rng.integers(-2, 3, (4000, 8)).astype(np.float32) if kind == "tied" else rng.normal(size=(4000, 8)).astype(np.float32)
    queries = rng.integers(-1, 2, (70, 8)).astype(np.float32) if kind == "tied" else rng.normal(size=(70, 8)).astype(np.float32)
    docs *= np.float32(1e16 if kind == "far" else 1)
    if kind == "skewed":
        # the guess is made of these documents alone, of which there are too few
        some = np.sort(np.random.default_rng(0).choice(4000, 4000 // topk.LOOK_SHARE, replace=False))
        docs[some[:20]] = queries.mean(axis=0) * 100
        docs[np.setdiff1d(np.arange(4000), some)] = 0
    again, real = [], topk._best_without_guess
    monkeypatch.setattr(topk, "_best_without_guess", lambda m, *a: again.append(len(m)) or real(m, *a))
    monkeypatch.setattr(topk, "SCORE_BLOCK", 7000)
    counts, rows, scores = topk.best_rows(queries, docs, 30)
    exact = (queries.astype(np.float64) @ docs.astype(np.float64).T).astype(np.float32)
    expected = np.array([np.lexsort((np.arange(4000), -exact[q]))[:30] for q in range(70)])
    assert (counts == 30).all()
    assert (rows.reshape(70, 30) == expected).all()
    assert (scores.reshape(70, 30) == np.take_along_axis(exact, expected, 1)).all()
    assert sum(again) == 0 or kind != "spread"
    assert sum(again) > 0 or kind != "skewed"


def test_a_guessed_floor_meets_few_pairs_twice(monkeypatch):
    """About twice what is kept, where a running top k takes several times as many."""
    rng = np.random.default_rng(6)
    docs, queries = rng.normal(size=(20_000, 16)).astype(np.float32), rng.normal(size=(50, 16)).astype(np.float32)
    pairs, real = [], np.einsum
    monkeypatch.setattr(topk.np, "einsum", lambda how, a, b: pairs.append(len(a)) or real(how, a, b))
    topk.best_rows(queries, docs, 100)
    assert sum(pairs) < 4 * 50 * 100


def test_only_what_may_be_kept_is_multiplied_twice(monkeypatch):
    """Rough products tell the best apart as far as they go, and a guess that is too high is made again, not given up."""
    rng = np.random.default_rng(7)
    docs, queries = rng.normal(size=(20_000, 16)).astype(np.float32), rng.normal(size=(300, 16)).astype(np.float32)
    pairs, again, einsum, without = [], [], np.einsum, topk._best_without_guess
    monkeypatch.setattr(topk.np, "einsum", lambda how, a, b: pairs.append(len(a)) or einsum(how, a, b))
    monkeypatch.setattr(topk, "_best_without_guess", lambda m, *a: again.append(len(m)) or without(m, *a))
    monkeypatch.setattr(topk, "FOUND_SHARE", 1)  # a guess that about half of the queries miss
    counts, rows, _ = topk.best_rows(queries, docs, 100)
    exact = (queries.astype(np.float64) @ docs.astype(np.float64).T).astype(np.float32)
    assert (counts == 100).all()
    assert (rows.reshape(300, 100) == np.argsort(-exact, axis=1, kind="stable")[:, :100]).all()
    assert not again and sum(pairs) < 2 * 300 * 100


def test_documents_are_one_part_as_far_as_single_precision_reaches(spark, monkeypatch):
    """What is found in one part is a list, and no row of it is stored or merged."""
    d, q, docs, queries = random_tables(spark, n_docs=30, n_queries=90)
    dims = len(d.first()["vec"])
    sent, real = [], search_module._from_dealt
    monkeypatch.setattr(search_module, "_from_dealt", lambda dealt, documents, *a: sent.append(len(documents)) or real(dealt, documents, *a))
    assert rows(search(d, q, 7, limits=Limits(broadcast_bytes=30 * dims * 4))) == brute_force(docs, queries, 7)
    assert sent == [30]


def test_lists_keep_places_of_an_evaluation():
    counts, scores = np.array([3, 0, 4]), np.array([2, 2, 1, 1, 0.5, 0.5, 0.5], np.float32)
    assert search_module._evaluated_places(counts, scores).tolist() == [2, 1, 3, 1, 4, 3, 2]
    assert search_module._evaluated_places(np.array([0]), scores[:0]).tolist() == []


@pytest.mark.parametrize("limits", [0, 16 * 1024 * 1024])
def test_vectors_meet_by_a_hash_first(spark, monkeypatch, limits):
    """Zeros of either sign are one vector, and every query row keeps what it found."""
    monkeypatch.setattr(search_module, "JOINED_BYTES", limits)
    vecs = [[0.0, 1.0], [-0.0, 1.0], [1.0, 0.0], [1.0, -0.0]]
    q = spark.createDataFrame([(f"q{i}", vecs[i % 4]) for i in range(12)], "query_id string, vec array<float>")
    d = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.5, 1.0])], "doc_id string, vec array<float>")
    plans, real = {}, search_module.materialize

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(search_module, "materialize", noted)
    found = search_distinct(d, q, 1)
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == sorted((f"q{i}", "b" if i % 4 < 2 else "a") for i in range(12))
    assert "_hash" in plans["members"]
