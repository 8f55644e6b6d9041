import pytest
from pyspark.sql import functions as F

from dimsift.operators import report, tune
from dimsift.operators import search as search_module
from dimsift.operators.importance import NegativeFeedback, PseudoRelevance
from dimsift.plans import retrieve
from dimsift.sources import results as files

from .conftest import approx
from .test_search import random_tables

LONG = (
    "collection string, model string, filter string, selector string, alpha string, query_id string, "
    "measure string, value double, retained_frac double"
)


def test_grades(spark):
    scores = [-1.0, 0.0, 0.25, 0.26, 0.75, 0.76]
    df = spark.createDataFrame([("q", str(i), s) for i, s in enumerate(scores)], "query_id string, doc_id string, ce_score double")
    found = {r["doc_id"]: r["relevance"] for r in tune.graded_qrels(df).collect()}
    assert [found[str(i)] for i in range(6)] == [0, 0, 1, 2, 2, 3]


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(str(i % 90), "d", 0.5) for i in range(900)], "query_id string, doc_id string, ce_score double")
    first = [r[0] for r in tune.sample_queries(df, 20).collect()]
    assert first == sorted(first) and len(set(first)) == 20
    assert [r[0] for r in tune.sample_queries(df.repartition(11), 20).collect()] == first
    assert [r[0] for r in tune.sample_queries(df, 20, seed=7).collect()] != first
    assert tune.sample_queries(df, 500).count() == 90


def test_sampled_id_without_text_stays_in_the_judgments(spark):
    scores = spark.createDataFrame([("1", "d", 0.5), ("2", "d", 0.9)], "query_id string, doc_id string, ce_score double")
    texts = spark.createDataFrame([("1", "x"), ("3", "y")], "query_id string, text string")
    queries, qrels = tune.eval_set(scores, texts, 10)
    assert [r[0] for r in queries.collect()] == ["1"]
    assert {r[0] for r in qrels.collect()} == {"1", "2"}


def test_trials():
    grid = tune.grid_trials(k=(2, 5), alpha=(0.2, 0.6, 1.0))
    assert len(grid) == 6 and [t["trial_id"] for t in grid] == list(range(6))
    drawn = tune.random_trials(["k", "kneg", "lambda_pos", "lambda_neg", "alpha"], 200)
    assert drawn == tune.random_trials(["k", "kneg", "lambda_pos", "lambda_neg", "alpha"], 200)
    for t in drawn:
        assert 2 <= t["k"] <= 20 and isinstance(t["kneg"], int)
        assert 0.5 <= t["lambda_pos"] <= 2.0 and 0.1 <= t["lambda_neg"] <= 1.0
        assert round(t["alpha"] * 10) == t["alpha"] * 10 and 0.1 <= t["alpha"] <= 1.0


@pytest.fixture(scope="module")
def study_tables(spark):
    docs, queries, *_ = random_tables(spark, 120, 6, 8, seed=3, copies=False)
    run = retrieve.baseline(docs, queries, 40)
    qrels = spark.createDataFrame(
        [(f"q{q}", f"d{d}", (q * 5 + d * 3) % 4) for q in range(6) for d in range(0, 120, 2)],
        "query_id string, doc_id string, relevance int",
    )
    return docs, queries, run, qrels


def test_trials_equal_single_searches(study_tables):
    docs, queries, run, qrels = study_tables
    trials = tune.grid_trials(k=(2, 7), kneg=(3,), lambda_pos=(1.5,), lambda_neg=(0.25,), alpha=(0.25, 1.0))
    found = {r["trial_id"]: r["value"] for r in tune.run_trials(queries, trials, run, docs, qrels, depth=20).collect()}
    for t in trials:
        chosen = NegativeFeedback(PseudoRelevance(run, docs, t["k"]), run, docs, 3, 1.5, 0.25)
        sweep = retrieve.sweep(queries, docs, chosen, alphas=[t["alpha"]], k=20)
        assert found[t["trial_id"]] == approx(sweep.evaluate(qrels, ["nDCG@100"]).mean(t["alpha"], "nDCG@100"), 1e-9)


def test_equal_masks_of_trials_are_searched_once(study_tables, monkeypatch):
    docs, queries, run, qrels = study_tables
    searched = []
    real = search_module._search_stored
    monkeypatch.setattr(search_module, "_search_stored", lambda d, q, *a: searched.append(q.count()) or real(d, q, *a))
    trials = tune.grid_trials(k=(2, 5), kneg=(2, 5), lambda_neg=(0.1, 0.5), alpha=(1.0,))
    study = tune.run_trials(queries, trials, run, docs, qrels, depth=20).collect()
    # with all dimensions kept, the eight trials are one search per query
    assert searched == [queries.select("vec").distinct().count()]
    assert len(study) == 8 and len({round(r["value"], 9) for r in study}) == 1


def test_trials_with_threshold_and_given_base(study_tables):
    docs, queries, run, qrels = study_tables
    trials = tune.grid_trials(k=(2, 3))
    found = {r["trial_id"]: r["value"] for r in tune.run_trials(queries, trials, run, docs, qrels, "rdime").collect()}
    for t in trials:
        sweep = retrieve.sweep(queries, docs, PseudoRelevance(run, docs, t["k"]), "rdime", k=100)
        assert found[t["trial_id"]] == approx(sweep.evaluate(qrels, ["nDCG@100"]).mean("rdime", "nDCG@100"), 1e-9)
    base = PseudoRelevance(run, docs, 2)(queries)
    given = tune.run_trials(queries, [{"trial_id": 0, "kneg": None}], run, docs, qrels, "rdime", base)
    assert given.first()["value"] == approx(found[0], 1e-9)


def test_study_files(spark, tmp_path):
    rows = [(0, 2, None, None, None, 0.5, 0.25), (1, 5, None, None, None, 0.6, 0.75), (2, 6, None, None, None, 0.7, 0.75)]
    study = spark.createDataFrame(rows, tune.PARAMETERS + ", value double")
    assert tune.best_trial(study).first()["trial_id"] == 1
    files.write_study(study, f"{tmp_path}/study", f"{tmp_path}/best")
    best = files.read_best(spark, f"{tmp_path}/best").first()
    assert (best["trial_id"], best["k"], best["alpha"], best["value"]) == (1, 5, 0.6, 0.75)
    assert files.read_study(spark, f"{tmp_path}/study").count() == 3


@pytest.fixture(scope="module")
def long(spark):
    rows = []

    def add(collection, name, selector, alpha, measure, values, frac=None):
        rows.extend((collection, "m", name, selector, alpha, str(i), measure, v, frac) for i, v in enumerate(values))

    add("c1", "baseline", None, None, "AP", [0.25, 0.75])
    add("c1", "f", "top-alpha", "0.4", "AP", [0.5, 0.25])
    add("c1", "f", "top-alpha", "0.6", "AP", [0.5, 0.5])
    add("c1", "f", "top-alpha", "0.8", "AP", [0.5, 0.5])
    add("c1", "f", "rdime", "rdime", "AP", [0.5, 0.75], 0.25)
    add("c2", "g", "top-alpha", "0.4", "AP", [0.0])
    add("c2", "g", "rdime", "rdime", "AP", [0.5], 0.75)
    return spark.createDataFrame(rows, LONG)


def test_means(long):
    base = {(r["collection"], r["measure"]): r["mean"] for r in report.baseline_means(long, ["c1", "c2"], ["m"], ["AP", "RR"]).collect()}
    assert base == {("c1", "AP"): 0.5, ("c1", "RR"): None, ("c2", "AP"): None, ("c2", "RR"): None}
    kept = {(r["collection"], r["filter"]): r["retained_frac"] for r in report.retained_means(long).collect()}
    assert kept == {("c1", "f"): 0.25, ("c2", "g"): 0.75}
    assert report.sweep_means(long).count() == 6


def test_performance(long):
    found = report.performance(long, ["m"], ["c1", "c2"], ["f", "g"], "top-alpha", 0.6, ["AP"])
    rows = {r["filter"]: r.asDict() for r in found.collect()}
    assert rows["f"]["c1:AP"] == rows["baseline"]["c1:AP"] == 0.5
    assert rows["f"]["c1:AP:best"] and rows["baseline"]["c1:AP:best"]
    assert rows["g"]["c1:AP"] is None and rows["g"]["c1:AP:best"] is False
    assert rows["g"]["c2:AP"] is None
    adaptive = report.performance(long, ["m"], ["c1"], ["f"], "rdime", 0.8, ["AP"], include_baseline=False)
    assert [r["c1:AP"] for r in adaptive.collect()] == [0.625]


def test_comparison(long):
    found = report.comparison(long, ["m"], ["c1", "c2"], ["f", "g"], "AP")
    rows = {(r["collection"], r["filter"]): r.asDict() for r in found.collect()}
    f = rows["c1", "f"]
    assert (f["alpha_0_4"], f["alpha_0_6"], f["alpha_0_8"]) == (0.375, 0.5, 0.5)
    assert (f["best_0_4"], f["best_0_6"], f["best_0_8"]) == (False, True, True)
    assert (f["rdime"], f["retained_frac"], f["delta_pct"]) == (0.625, 0.25, 25.0)
    assert rows["c2", "g"]["delta_pct"] is None and rows["c2", "g"]["rdime"] == 0.5
    assert rows["c2", "f"]["alpha_0_4"] is None and rows["c2", "f"]["rdime"] is None
    assert (rows["c1", "baseline"]["rdime"], rows["c1", "baseline"]["retained_frac"]) == (0.5, 1.0)
    assert rows["c2", "baseline"]["retained_frac"] is None


def test_sweep_table(long):
    found = report.sweep(long, ["m"], ["c1", "c2"], ["f", "g"], alphas=[0.4, 0.6], measures=["AP"])
    rows = {(r["collection"], r["filter"]): r.asDict() for r in found.collect()}
    assert len(rows) == 4
    assert rows["c1", "f"]["best_0_6"] and not rows["c1", "f"]["best_0_4"] and rows["c1", "f"]["baseline"] == 0.5
    assert rows["c2", "g"]["alpha_0_4"] == 0.0 and rows["c2", "g"]["alpha_0_6"] is None and rows["c2", "g"]["best_0_4"]
    assert rows["c2", "f"]["baseline"] is None


def test_tables_read_the_results_once(spark, long, tmp_path):
    long.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    for table in (
        report.comparison(stored, ["m"], ["c1", "c2"], ["f", "g"], "AP"),
        report.sweep(stored, ["m"], ["c1", "c2"], ["f", "g"], measures=["AP"]),
        report.performance(stored, ["m"], ["c1", "c2"], ["f", "g"], "top-alpha", 0.6, ["AP"]),
        report.retained(stored, ["m"], ["c1", "c2"], ["f", "g"]),
    ):
        table.collect()
        assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_tables_without_the_unmasked_run(long):
    compared = report.comparison(long, ["m"], ["c1"], ["f"], "AP", include_baseline=False)
    assert [(r["filter"], r["rdime"]) for r in compared.collect()] == [("f", 0.625)]
    swept = report.sweep(long, ["m"], ["c1"], ["f"], alphas=[0.4], measures=["AP"], include_baseline=False)
    assert swept.columns[-2:] == ["alpha_0_4", "best_0_4"] and [r["alpha_0_4"] for r in swept.collect()] == [0.375]


def test_retained_table(long):
    rows = {r["filter"]: (r["c1"], r["c2"]) for r in report.retained(long, ["m"], ["c1", "c2"], ["f", "g"]).collect()}
    assert rows == {"f": (0.25, None), "g": (None, 0.75)}


def test_delta(spark):
    df = spark.createDataFrame([(1.5, 1.0), (1.0, 0.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(report.delta_pct(F.col("a"), F.col("b"))).collect()] == [50.0, None, None, None]




class Halves:
    """Soft weights; a selector of its own kind."""

    tag = "halves"

    def weights(self, importance, alphas=None):
        half = F.transform("importance", lambda _: F.lit(0.5))
        return importance.select("query_id", F.lit(self.tag).alias("alpha"), F.lit(None).cast("double").alias("alpha_value"), "vec", half.alias("weights"))


def test_selector_objects(spark, micro):
    run = retrieve.baseline(micro.docs, micro.queries, 5)
    prf = PseudoRelevance(run, micro.docs, 2)
    sweep = retrieve.sweep(micro.queries, micro.docs, prf, Halves(), k=5)
    assert sweep.alphas == ("halves",)
    plain = {r["doc_id"]: r["score"] for r in run.collect()}
    assert {r["doc_id"]: r["score"] for r in sweep.run("halves").collect()} == {d: s / 2 for d, s in plain.items()}
    results = sweep.evaluate(micro.qrels, ["AP"]).results().collect()
    assert [r["retained_frac"] for r in results] == [0.5]
    compared = retrieve.compare(micro.queries, micro.docs, [prf], ["rdime", Halves()], k=5).results(micro.qrels, ["AP"])
    assert sorted(r["selector"] for r in compared.collect()) == ["halves", "rdime"]
    trials = tune.grid_trials(k=(1, 2), alpha=(0.5,))
    study = tune.run_trials(micro.queries, trials, run, micro.docs, micro.qrels, Halves(), measure="AP").collect()
    assert {round(r["value"], 6) for r in study} == {round(results[0]["value"], 6)} and len(study) == 2


def test_unknown_selectors_are_an_error(spark, micro):
    run = retrieve.baseline(micro.docs, micro.queries, 5)
    prf = PseudoRelevance(run, micro.docs, 2)
    for call in (
        lambda: retrieve.sweep(micro.queries, micro.docs, prf, "no-such"),
        lambda: retrieve.compare(micro.queries, micro.docs, [prf], ["no-such"]),
        lambda: tune.run_trials(micro.queries, tune.grid_trials(k=(1,), alpha=(1.0,)), run, micro.docs, micro.qrels, "no-such"),
    ):
        with pytest.raises(ValueError, match="no-such"):
            call()
