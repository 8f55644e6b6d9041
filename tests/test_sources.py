import hashlib
import re
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimsift.functions import tokens
from dimsift.operators import numbering
from dimsift.operators import vectors as vec
from dimsift.operators.encode import encode_text, hash_model, hash_vectors
from dimsift.operators.importance import PseudoRelevance
from dimsift.operators.search import search
from dimsift.plans import build, retrieve
from dimsift.sources import feedback, results, runs, vectors
from dimsift.sources.collections import Catalog, Collection, Table, public_collection
from dimsift.storage import broadcast_if_small, materialize, shared_folder

from .conftest import approx
from .test_search import scanned_rows


def same(left, right):
    return sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


def test_run_round_trip(spark, micro, tmp_path):
    run = search(micro.docs, micro.queries, 10, "m")
    path = f"{tmp_path}/run"
    runs.write_run(run, path)
    assert same(runs.read_run(spark, path), run)
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, f"{tmp_path}/absent")


def test_sweep_round_trip(spark, micro, tmp_path):
    prf = PseudoRelevance(retrieve.baseline(micro.docs, micro.queries, 10), micro.docs, 2)
    sweep = retrieve.sweep(micro.queries, micro.docs, prf, alphas=[1.0, 0.25], k=10)
    sweep.save(f"{tmp_path}/sweep")
    back = retrieve.Sweep.load(spark, f"{tmp_path}/sweep")
    assert back.alphas == ("0.25", "1.0")
    assert same(back.run(1.0), sweep.run(1.0)) and same(back.run_table, sweep.run_table)
    assert same(runs.read_sweep(spark, f"{tmp_path}/sweep", "0.25"), sweep.run("0.25"))
    with pytest.raises(KeyError):
        runs.read_sweep(spark, f"{tmp_path}/sweep", "0.3")


def test_alpha_labels_sort_numbers_first(spark):
    df = spark.createDataFrame([("rdime",), ("1.0",), ("0.2",)], "alpha string")
    assert runs.alphas_of(df) == ["0.2", "1.0", "rdime"]


def test_results_round_trip_keeps_shares(spark, micro, tmp_path):
    prf = PseudoRelevance(retrieve.baseline(micro.docs, micro.queries, 10), micro.docs, 2)
    sweep = retrieve.sweep(micro.queries, micro.docs, prf, "rdime", k=10).evaluate(micro.qrels)
    sweep.save(f"{tmp_path}/sweep")
    sweep.save_results(f"{tmp_path}/results")
    back = retrieve.Sweep.load(spark, f"{tmp_path}/sweep", f"{tmp_path}/results")
    assert back.mean("rdime", "AP") == approx(sweep.mean("rdime", "AP"))
    back.save_results(f"{tmp_path}/again")
    again = results.read_results(spark, f"{tmp_path}/again")
    assert {r["retained_frac"] for r in again.collect()} == {0.75}
    columns = ["query_id", "alpha", "measure", "value", "retained_frac"]
    assert same(again.select(columns), sweep.results().select(columns))


def test_results_are_read_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, "007", "AP")], "value double, query_id string, measure string")
    rows.write.option("header", True).csv(f"{tmp_path}/r")
    assert [r.asDict() for r in results.read_results(spark, f"{tmp_path}/r").collect()] == [
        {"query_id": "007", "measure": "AP", "value": 0.5}
    ]


def test_first_answer_wins(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text('query_id,text\n1,"first, with comma"\n2,"two ""quoted""\nlines"\n1,second\n')
    found = {r["query_id"]: r["text"] for r in feedback.read_answers(spark, str(path), multi_line=True).collect()}
    assert found == {"1": "first, with comma", "2": 'two "quoted"\nlines'}


def test_ce_scores(spark, tmp_path):
    path = tmp_path / "ce.tsv"
    path.write_text("01\t0\td1\t-0.5\n01\t0\td2\t0.75\n")
    found = feedback.read_ce_scores(spark, str(path))
    assert found.columns == ["query_id", "doc_id", "ce_score"]
    assert sorted(map(tuple, found.collect())) == [("01", "d1", -0.5), ("01", "d2", 0.75)]


def test_eval_set_round_trip(spark, tmp_path):
    queries = spark.createDataFrame([("1", 'a "b"\tc'), ("2", "plain")], "query_id string, text string")
    feedback.write_eval_queries(queries, f"{tmp_path}/q")
    assert same(feedback.read_eval_queries(spark, f"{tmp_path}/q"), queries)
    qrels = spark.createDataFrame([("1", "d", 2)], "query_id string, doc_id string, relevance int")
    feedback.write_eval_qrels(qrels, f"{tmp_path}/r")
    assert same(feedback.read_eval_qrels(spark, f"{tmp_path}/r"), qrels)


def test_vectors_and_manifest(spark, micro, tmp_path):
    path = vectors.corpus_path(str(tmp_path), "m", "c")
    with pytest.raises(FileNotFoundError):
        vectors.read_vectors(spark, path)
    made = vectors.write_vectors(micro.docs, path, "m")
    assert (made["n_items"], made["dims"], made["status"]) == (5, 4, "complete")
    back = vectors.read_vectors(spark, path)
    assert same(back, micro.docs)
    kept = vectors.write_vectors(micro.docs.limit(2), path, "m")
    assert kept["n_items"] == 5 and kept["written_at"] == made["written_at"]
    assert vectors.write_vectors(micro.docs.limit(2), path, "m", overwrite=True)["n_items"] == 2
    vectors._write_manifest(spark, path, model="m", status="writing")
    with pytest.raises(RuntimeError):
        vectors.read_vectors(spark, path)


def test_known_models_have_known_dimensions(spark, micro, tmp_path):
    with pytest.raises(ValueError, match="768"):
        vectors.write_vectors(micro.docs, f"{tmp_path}/v", "ance")
    assert not vectors.is_complete(spark, f"{tmp_path}/v")


def test_public_collections_share_a_corpus():
    table = Table("x", {})
    names = {public_collection(c, table, table, table).corpus_name for c in ("dl19", "dl20", "dlhard")}
    assert len(names) == 1
    with pytest.raises(KeyError):
        public_collection("DL19", table, table, table)


def test_mixed_lengths_are_refused(spark, tmp_path):
    mixed = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "doc_id string, vec array<float>")
    vectors.write_vectors(mixed, f"{tmp_path}/mixed", "m")
    with pytest.raises(RuntimeError):
        vectors.read_vectors(spark, f"{tmp_path}/mixed")
    assert vectors.manifest_of(mixed, "m").first()["status"] == "incomplete"


def test_lookup_centroid_and_missing(spark, micro):
    ids = spark.createDataFrame([("1",), ("3",), ("3",)], "doc_id string")
    assert vec.lookup(micro.docs, ids, strict=True).count() == 3
    absent = ids.unionByName(spark.createDataFrame([("zz",)], "doc_id string"))
    assert [r[0] for r in vec.missing_ids(micro.docs, absent).collect()] == ["zz"]
    with pytest.raises(KeyError, match="zz"):
        vec.lookup(micro.docs, absent, strict=True)
    centre = {r["dim"]: r["value"] for r in vec.centroid(micro.docs).collect()}
    assert [centre[d] for d in range(4)] == approx([0.2, -0.1, 0.4, 0.0])
    one = vec.normalized(micro.docs, ids.limit(1)).first()
    assert sum(x * x for x in one["vec"]) == approx(1.0)


@pytest.mark.parametrize("pushed", [10_000, 0])
def test_lookup_of_odd_ids(spark, monkeypatch, pushed):
    monkeypatch.setattr(vec, "PUSHED_IDS", pushed)
    names = ["a", "it's", "back\\slash", "\\'", "%_", "", " ", "é\n", "NULL", "?", "${x}", None]
    vectors = spark.createDataFrame([(n, [float(i)]) for i, n in enumerate([*names, "other"])], "doc_id string, vec array<float>")
    ids = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [("zz", 99), ("a", 100)], "doc_id string, n int")
    found = sorted((r["n"], r["doc_id"], r["vec"][0]) for r in vec.lookup(vectors, ids).collect())
    assert found == [(i, n, float(i)) for i, n in enumerate(names) if n is not None] + [(100, "a", 0.0)]
    assert vec.lookup(vectors, ids.where("false")).collect() == []
    numbers = spark.range(20).select((F.col("id") - 5).alias("doc_id"), F.array(F.col("id").cast("float")).alias("vec"))
    few = spark.createDataFrame([(-3,), (7,), (7,), (99,)], "doc_id bigint")
    assert sorted(r["vec"][0] for r in vec.lookup(numbers, few).collect()) == [2.0, 12.0, 12.0]


def test_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch, capsys):
    """Ids go to the scan, which leaves out row groups and pages that have none of them."""
    monkeypatch.setattr(vectors, "ROW_GROUP_BYTES", 20_000)
    given = spark.range(6000).select(F.sha1(F.col("id").cast("string")).alias("doc_id"), F.array(F.col("id").cast("float"), F.rand(1).cast("float")).alias("vec"))
    vectors.write_vectors(given, f"{tmp_path}/v", "m")
    stored = vectors.read_vectors(spark, f"{tmp_path}/v")
    ids = given.select("doc_id").where("vec[0] % 3000 = 3")
    found = vec.lookup(stored, ids, strict=True)
    assert sorted(r["vec"][0] for r in found.collect()) == [3.0, 3003.0]
    found.explain("formatted")
    assert "PushedFilters: [In(doc_id" in capsys.readouterr().out
    wanted = [r[0] for r in ids.collect()]
    chosen = spark.read.parquet(f"{tmp_path}/v/data").where(vec.among("doc_id", wanted))
    assert chosen.count() == 2 and scanned_rows(chosen) <= 6000 / 6
    # an id that no row group has, though it lies between their ends, is told by the Bloom filters
    absent = spark.read.parquet(f"{tmp_path}/v/data").where(vec.among("doc_id", ["7" * 40]))
    assert scanned_rows(absent) == 0
    assert scanned_rows(spark.read.parquet(f"{tmp_path}/v/data")) == 6000


def test_mean_vectors_with_and_without_broadcast(micro, monkeypatch):
    members = micro.qrels.where("relevance > 0")
    named = vec.mean_vectors(members, micro.docs, ["query_id"]).collect()
    monkeypatch.setattr(vec, "PUSHED_IDS", 0)
    hinted = vec.mean_vectors(members, micro.docs, ["query_id"]).collect()
    assert named == hinted
    monkeypatch.setattr(vec, "broadcast_if_small", lambda df: broadcast_if_small(df, 0))
    assert vec.mean_vectors(members, micro.docs, ["query_id"]).collect() == hinted


def test_mean_vectors_move_few_rows(spark):
    """A row per stretch of dimensions, whatever their number; vectors of several lengths and with nulls count as far as they go."""
    rng = np.random.default_rng(8)
    vecs = [[float(x) for x in rng.integers(-8, 8, n)] for n in (70, 70, 33, 5, 0, 70)]
    vecs[1][3] = vecs[1][69] = None
    d = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(vecs)], "doc_id string, vec array<float>")
    lists = {"a": [0, 1, 2, 3, 4], "b": [1, 3], "c": [5, 5, 0]}
    members = spark.createDataFrame([(q, f"d{i}") for q, some in lists.items() for i in some], "query_id string, doc_id string")
    means = vec.mean_vectors(members, d, ["query_id"])
    found = {r["query_id"]: r["mean"] for r in means.collect()}
    for q, some in lists.items():
        columns = [[vecs[i][n] for i in some if n < len(vecs[i]) and vecs[i][n] is not None] for n in range(70)]
        assert found[q] == approx([sum(c) / len(c) if c else None for c in columns])
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" in plan and "posexplode" not in plan


def test_hash_model(spark):
    texts = spark.createDataFrame([("a", "Fox fox 123 FOX"), ("b", ""), ("c", None)], "doc_id string, text string")
    found = {r["doc_id"]: r["vec"] for r in encode_text(texts, hash_model(16)).collect()}
    assert sorted(found["a"])[-1] == 1.0 and sum(found["a"]) == 1.0
    assert sum(found["b"]) == sum(found["c"]) == 0.0
    other = encode_text(texts.where("doc_id = 'a'"), hash_model(16, salt=1)).first()["vec"]
    assert len(other) == 16


def test_hash_model_remembers_few_tokens():
    predict = hash_model(16)()
    tokens = ["".join(chr(97 + i // 26**p % 26) for p in range(5)) for i in range(250_000)]
    tracemalloc.start()
    found = predict([" ".join(tokens[i:i + 1000]) for i in range(0, len(tokens), 1000)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 16_000_000
    assert (found == predict([" ".join(tokens[i:i + 1000]) for i in range(0, len(tokens), 1000)])).all()


def test_hash_model_calls_no_function_per_token():
    predict, calls = hash_model(16)(), []
    text = "The fox, the \u212aelvin fox \ud800 f\u00fcr x_y " * 500
    first = predict([text])
    sys.setprofile(lambda frame, event, _: calls.append(event) if event == "call" else None)
    again = predict([text] * 2)
    sys.setprofile(None)
    assert len(calls) < 50
    counts = np.zeros(16)
    for token in re.findall("[a-z]+", text.lower()):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
    expected = np.floor(counts / np.sqrt((counts * counts).sum()) * 2.0**20 + 0.5) / 2.0**20
    assert (again == first).all() and (first[0] == expected.astype(np.float32)).all()


@pytest.mark.parametrize("known", [1, 8, 100_000])
@pytest.mark.parametrize("chunk", [1, 1_000_000])
def test_tokens_as_arrays(monkeypatch, known, chunk):
    """Every token is counted once, whatever is remembered: long ones, those of equal first letters, and texts without any."""
    monkeypatch.setattr(tokens, "CHUNK_BYTES", chunk)
    letters = "abcdefghijklmnopqrstuvwxyz"
    cut = [letters[:n] for n in range(1, 26)] + [letters[:8] + c for c in letters] + [letters * 3]
    rng = np.random.default_rng(3)
    texts = [None, "", " 1 ", "\u0130\u03a3 \ud800x"] + [" ".join(rng.choice(cut, 40)) for _ in range(20)] + ["a" * 70, "", None]
    for salt in (0, 3):
        found = tokens.TokenDimensions(16, salt, known)
        for _ in range(2):
            counts = found.counts(texts)
            for row, text in enumerate(texts):
                expected = np.zeros(16)
                for token in re.findall("[a-z]+", (text or "").lower()):
                    expected[int(hashlib.md5(token.encode()).hexdigest()[8 * salt:8 * salt + 8], 16) % 16] += 1
                assert (counts[row] == expected).all()


def test_tokens_cost_no_step_each():
    """Tokens that are remembered are not hashed again, and no dictionary is asked for them."""
    found, words = tokens.TokenDimensions(16, 0, 1000), " ".join(a + b for a in "abcdefghij" for b in "klmnopqrst")
    found.counts([words])
    events = []
    sys.setprofile(lambda frame, event, _: events.append(event))
    found.counts([words * 100])
    sys.setprofile(None)
    assert len(events) < 200


def test_native_hash_vectors(spark):
    texts = spark.createDataFrame(
        [("a", "Fox fox 123 FOX den"), ("b", ""), ("c", None), ("d", "\u212a\u0130 x" * 50)], "doc_id string, text string"
    )
    for salt in (0, 2):
        assert same(hash_vectors(texts, "doc_id", 16, salt), encode_text(texts, hash_model(16, salt)))


def test_dense_offsets(spark):
    ids = [str(i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id string").repartition(5)
    found = {r["doc_id"]: r["offset"] for r in numbering.dense_offsets(df, ["doc_id"]).collect()}
    assert found == {d: n for n, d in enumerate(sorted(ids))}
    queries = spark.createDataFrame(list(enumerate(ids)), "line long, query_id string").repartition(3)
    found = numbering.dense_offsets(queries, ["line"]).collect()
    assert {r["query_id"]: r["offset"] for r in found} == {d: n for n, d in enumerate(ids)}


def test_materialize_uses_the_named_folder(spark, micro):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    stored = materialize(micro.docs, "docs")
    assert same(stored, micro.docs)
    assert all(folder in f for f in stored.inputFiles())


@pytest.fixture()
def catalog(spark, tmp_path):
    texts = {"1": "red fox", "2": "blue whale", "3": "red whale — blue"}
    spark.createDataFrame(list(texts.items()), "pid string, body string").write.parquet(f"{tmp_path}/docs")
    (tmp_path / "queries.tsv").write_text("q1\tred — fox\nq2\twhale\n")
    (tmp_path / "qrels.csv").write_text("query_id,doc_id,relevance\nq1,1,2\nq2,2,1\n")
    collection = Collection(
        "tiny", "tiny-corpus",
        Table(f"{tmp_path}/docs", {"doc_id": "pid", "text": "body"}),
        Table(f"{tmp_path}/queries.tsv", {}, "csv", {"sep": "\t"}, "query_id string, text string"),
        Table(f"{tmp_path}/qrels.csv", {}, "csv", {"header": "true"}),
    )
    return Catalog(spark, collection)


def test_catalog(catalog):
    corpus, queries, qrels = catalog.all("tiny")
    assert {r["doc_id"]: r["text"] for r in corpus.collect()}["3"] == "red whale - blue"
    assert {r["query_id"]: r["text"] for r in queries.collect()}["q1"] == "red — fox"
    assert catalog.queries("tiny", normalized=True).where("query_id = 'q1'").first()["text"] == "red - fox"
    assert qrels.dtypes == [("query_id", "string"), ("doc_id", "string"), ("relevance", "int")]
    with pytest.raises(KeyError, match="tiny"):
        catalog.corpus("other")


def test_build_and_search(spark, catalog, tmp_path):
    root = f"{tmp_path}/out"
    build.build(spark, catalog, "tiny", "h", hash_model(), root, skip_queries=True)
    assert not vectors.is_complete(spark, vectors.query_path(root, "h", "tiny"))
    build.build(spark, catalog, "tiny", "h", hash_model(), root)
    first = build.search_collection(spark, catalog, "tiny", "h", root, k=2)
    assert {(r["query_id"], r["doc_id"]) for r in first.where("rank = 0").collect()} == {("q1", "1"), ("q2", "2")}
    # a finished stage is kept, whatever is asked, until it is overwritten
    assert build.search_collection(spark, catalog, "tiny", "h", root, k=1).count() == first.count()
    assert build.search_collection(spark, catalog, "tiny", "h", root, k=1, overwrite=True).count() == 2


def test_eval_run(spark, catalog, tmp_path):
    root = f"{tmp_path}/out"
    docs = encode_text(catalog.corpus("tiny"), hash_model())
    run = build.build_eval_run(spark, catalog.queries("tiny"), docs, "h", hash_model(), root, "tiny", k=2)
    assert run.count() == 4
    assert vectors.is_complete(spark, vectors.query_path(root, "h", "tiny", "tune_queries"))
    assert not vectors.is_complete(spark, vectors.query_path(root, "h", "tiny"))


def test_hot_id_in_answers(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("query_id"),
        F.concat(F.lit("t"), "id").alias("text"), "id",
    )
    found = feedback.first_per_query(rows, "id")
    assert found.where("query_id = 'hot'").first()["text"] == "t0" and found.count() == 667


def test_texts_with_line_ends_are_one_line_each(spark, tmp_path):
    texts = ["plain", "two\nlines", "cr\rlf\r\n", "back\\slash \\n \\s \\\\n", '"quoted", tab\t', ""]
    rows = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")
    feedback.write_answers(rows.coalesce(1), str(tmp_path / "a"))
    lines = spark.read.text(str(tmp_path / "a")).count()
    assert lines == len(texts) + 1
    found = {r["query_id"]: r["text"] or "" for r in feedback.read_answers(spark, str(tmp_path / "a")).collect()}
    assert found == {f"q{i}": t for i, t in enumerate(texts)}
    feedback.write_eval_queries(rows, str(tmp_path / "q"))
    assert {r["query_id"]: r["text"] or "" for r in feedback.read_eval_queries(spark, str(tmp_path / "q")).collect()} == found


def test_files_from_elsewhere_may_hold_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('query_id,text\nq1,"one\ntwo \\n"\nq2,x\n')
    found = {r["query_id"]: r["text"] for r in feedback.read_answers(spark, str(tmp_path / "a.csv"), multi_line=True).collect()}
    assert found == {"q1": "one\ntwo \\n", "q2": "x"}


def test_a_wide_side_table_is_not_broadcast(spark, tmp_path, capsys, monkeypatch):
    """Only the ids are, which are counted by their files."""
    monkeypatch.setattr(vec, "PUSHED_IDS", 10)
    vectors = spark.createDataFrame([(str(i), [float(i)]) for i in range(50)], "doc_id string, vec array<float>")
    wide = spark.range(40).selectExpr("cast(id AS string) AS doc_id", "repeat('x', 20000) AS text")
    wide.write.parquet(str(tmp_path / "w"))
    found = vec.lookup(vectors, spark.read.parquet(str(tmp_path / "w")))
    assert found.count() == 40 and sorted(found.columns) == ["doc_id", "text", "vec"]
    found.explain("extended")
    plan = capsys.readouterr().out
    hints = plan[plan.index("Analyzed"):plan.index("Optimized")]
    assert hints.count("ResolvedHint") == 1


def test_offsets_need_an_order(spark):
    with pytest.raises(ValueError):
        numbering.dense_offsets(spark.range(3), [])
