import pytest
from pyspark.sql import functions as F

from dimsift.operators import importance as imp
from dimsift.operators import select
from dimsift.operators.encode import hash_model
from dimsift.operators.search import search
from dimsift.plans import retrieve

from .conftest import QUERY, approx


@pytest.fixture(scope="module")
def run(micro):
    return retrieve.baseline(micro.docs, micro.queries, 10)


def values(frame, column="importance"):
    return {r["query_id"]: list(r[column]) for r in frame.collect()}


def masks(frame):
    return {(r["query_id"], r["alpha"]): list(r["weights"]) for r in frame.collect()}


def test_pseudo_relevance(micro, run):
    prf = imp.PseudoRelevance(run, micro.docs, 2)
    assert prf.tag == "prf-k2"
    assert values(prf(micro.queries))["q"] == approx([0.25, 0.125, 0.375, 0.0])


def test_query_without_run_rows(spark, micro, run):
    other = micro.queries.withColumn("query_id", F.lit("z"))
    frame = imp.PseudoRelevance(run, micro.docs, 2)(other)
    assert values(frame)["z"] == [0.0] * 4
    weighted = select.NoiseThreshold().weights(frame)
    assert masks(weighted)["z", "rdime"] == [0.0] * 4
    assert select.retained(weighted).first()["retained_frac"] == 0.0
    found = search(micro.docs, select.apply_weights(weighted), 10)
    assert {r["score"] for r in found.collect()} == {0.0}


def test_negative_feedback(micro, run):
    base = imp.PseudoRelevance(run, micro.docs, 2)
    eclipse = imp.NegativeFeedback(base, run, micro.docs, 2)
    assert eclipse.tag == "prf-k2-eclipse"
    frame = eclipse(micro.queries)
    assert values(frame)["q"] == approx([0.3125, 0.125, 0.28125, 0.0])
    assert masks(select.NoiseThreshold().weights(frame))["q", "rdime"] == [1, 1, 1, 0]
    plain = imp.NegativeFeedback(base, run, micro.docs, 2, 1.0, 0.0)
    assert values(plain(micro.queries)) == values(base(micro.queries))


def test_negative_feedback_over_any_base(micro, run):
    base = imp.PseudoRelevance(run, micro.docs, 2)

    class Plain:
        tag = "plain"

        def __call__(self, queries):
            return base(queries)

    fused = imp.NegativeFeedback(base, run, micro.docs, 2, 1.5, 0.25)(micro.queries)
    apart = imp.NegativeFeedback(Plain(), run, micro.docs, 2, 1.5, 0.25)(micro.queries)
    assert fused.collect() == apart.collect()


def test_judged(micro):
    # relevant: 2, 3 and 5
    means = [0.5 / 3, -0.5 / 3, 2.0 / 3, -1.0 / 3]
    frame = imp.Judged(micro.qrels, micro.docs)(micro.queries)
    assert values(frame)["q"] == approx([q * m for q, m in zip(QUERY, means)])


def test_answers_fall_back_to_the_query(spark):
    from dimsift.operators.encode import encode_text

    texts = spark.createDataFrame([("a", "red fox"), ("b", "blue whale sings")], "query_id string, text string")
    queries = encode_text(texts, hash_model()).join(texts, "query_id")
    answers = spark.createDataFrame([("a", "foxes are red")], "query_id string, text string")
    chosen = imp.Answers(answers, hash_model(), "variant-x")
    assert chosen.tag == "variant-x"
    frame = chosen(queries)
    q = values(queries, "vec")
    assert values(frame)["b"] == approx([x * x for x in q["b"]])
    answered = encode_text(answers, hash_model()).first()["vec"]
    assert values(frame)["a"] == approx([x * y for x, y in zip(q["a"], answered)])


def test_long_form_round_trip_and_ranks(micro, run):
    frame = imp.PseudoRelevance(run, micro.docs, 2)(micro.queries)
    long = imp.to_long(frame)
    assert [tuple(r) for r in long.orderBy("dim").collect()] == [
        ("q", 0, 0.25, 2), ("q", 1, 0.125, 3), ("q", 2, 0.375, 1), ("q", 3, 0.0, 4),
    ]
    assert values(imp.from_long(long, micro.queries)) == values(frame)


def test_accessors(spark, micro, run):
    frame = imp.PseudoRelevance(run, micro.docs, 2)(micro.queries)
    assert imp.check_shape(frame) == (1, 4)
    assert imp.row(frame, "q").count() == 1
    with pytest.raises(KeyError):
        imp.row(frame, "nobody")
    assert imp.subset(frame, spark.createDataFrame([("x",)], "query_id string")).count() == 0
    with pytest.raises(ValueError):
        imp.check_shape(frame.unionByName(frame))
    with pytest.raises(ValueError):
        imp.check_shape(frame.withColumn("importance", F.slice("importance", 1, 2)))


def test_top_alpha(micro, run):
    frame = imp.PseudoRelevance(run, micro.docs, 2)(micro.queries)
    alphas = [0.25, 0.5, 0.75, 1.0]
    weighted = select.TopAlpha().weights(frame, alphas)
    found = masks(weighted)
    expected = {"0.25": [0, 0, 1, 0], "0.5": [1, 0, 1, 0], "0.75": [1, 1, 1, 0], "1.0": [1, 1, 1, 1]}
    assert {a: found["q", a] for a in expected} == expected
    assert masks(select.NoiseThreshold().weights(frame))["q", "rdime"] == [1, 1, 1, 0]
    shares = {r["alpha"]: r["retained_frac"] for r in select.retained(weighted).collect()}
    assert shares == {"0.25": 0.25, "0.5": 0.5, "0.75": 0.75, "1.0": 1.0}
    assert {r["alpha"]: r["retained_frac"] for r in select.mean_retained(select.retained(weighted)).collect()} == shares


def test_masks_are_nested_and_exact(spark):
    rows = [(str(i), [((i * 7 + d * 13) % 11) / 11 for d in range(64)]) for i in range(20)]
    frame = spark.createDataFrame(rows, "query_id string, importance array<double>").withColumn("vec", F.col("importance"))
    found = masks(select.TopAlpha().weights(frame))
    for i in range(20):
        before = [0.0] * 64
        for alpha in select.DEFAULT_ALPHAS:
            mask = found[str(i), str(alpha)]
            assert sum(mask) == max(1, round(alpha * 64))
            assert all(a <= b for a, b in zip(before, mask))
            before = mask


def test_top_k_bounds(micro, run):
    frame = imp.PseudoRelevance(run, micro.docs, 2)(micro.queries)
    for k, kept in [(-1, 0), (0, 0), (2, 2), (4, 4), (9, 4)]:
        assert sum(select.top_k_weights(frame, k).first()["weights"]) == kept


def test_threshold_ignores_alpha(micro, run):
    frame = imp.PseudoRelevance(run, micro.docs, 2)(micro.queries)
    chosen = select.selector("rdime")
    assert masks(chosen.weights(frame, [0.1])) == masks(chosen.weights(frame))
    with pytest.raises(ValueError):
        select.selector("other")


def test_soft_weights(spark, micro):
    weighted = micro.queries.withColumn("weights", F.array(*[F.lit(w) for w in (0.5, 0.0, 2.0, 1.0)]))
    assert list(select.apply_weights(weighted).first()["vec"]) == [0.25, 0.0, 1.5, 0.25]


def test_sweep_micro(micro, run):
    prf = imp.PseudoRelevance(run, micro.docs, 2)
    alphas = [1.0, 0.25, 0.5, 0.75]
    sweep = retrieve.sweep(micro.queries, micro.docs, prf, alphas=alphas, k=10, model="m")
    assert sweep.alphas == ("0.25", "0.5", "0.75", "1.0")
    scores = {a: {r["doc_id"]: r["score"] for r in sweep.run(a).collect()} for a in alphas}
    assert [scores[0.25][d] for d in "12345"] == approx([0, 0.375, 0.75, 0, 0.375])
    assert [scores[0.5][d] for d in "12345"] == approx([0.5, 0.625, 0.75, -0.25, 0.375])
    assert [scores[0.75][d] for d in "12345"] == approx([0.5, 0.5, 1.0, -0.25, 0.375])
    assert {r["run"] for r in sweep.run_table.collect()} == {"m__prf-k2__top-alpha"}
    full = {r["doc_id"]: (r["rank"], r["score"]) for r in sweep.run(1.0).collect()}
    assert full == {r["doc_id"]: (r["rank"], r["score"]) for r in run.collect()}
    measures = ("nDCG@3", "AP", "R@3", "RR")
    done = sweep.evaluate(micro.qrels, measures)
    for m in measures:
        assert done.mean(0.25, m) == approx(1.0)
    assert done.mean(0.5, "nDCG@3") == approx(0.840303)
    assert done.mean(0.75, "AP") == approx(0.916667)
    table = {r["alpha"]: r["AP"] for r in done.summary_table(measures).collect()}
    assert list(table) == ["0.25", "0.5", "0.75", "1.0"]
    with pytest.raises(KeyError):
        sweep.run(0.3)
    with pytest.raises(KeyError):
        done.mean(0.5, "nDCG@7")
    with pytest.raises(RuntimeError):
        sweep.summary_table()


def test_threshold_search_reports_shares(micro, run):
    prf = imp.PseudoRelevance(run, micro.docs, 2)
    sweep = retrieve.sweep(micro.queries, micro.docs, prf, "rdime", k=10)
    assert sweep.alphas == ("rdime",)
    results = sweep.evaluate(micro.qrels).results().collect()
    assert {r["retained_frac"] for r in results} == {0.75} and len(results) == 4


def test_comparison_equals_single_sweeps(micro, run):
    prf = imp.PseudoRelevance(run, micro.docs, 2)
    eclipse = imp.NegativeFeedback(prf, run, micro.docs, 2)
    found = retrieve.compare(micro.queries, micro.docs, [prf, eclipse], alphas=[0.5, 0.25], k=3, model="m")
    columns = ["query_id", "doc_id", "rank", "score", "run", "alpha"]
    results = found.results(micro.qrels)
    assert len(found.settings) == 6 and results.count() == 6 * 4
    for chosen in (prf, eclipse):
        for tag in ("top-alpha", "rdime"):
            single = retrieve.sweep(micro.queries, micro.docs, chosen, tag, [0.25, 0.5], 3, "m")
            mine = (F.col("filter") == chosen.tag) & (F.col("selector") == tag)
            assert sorted(found.run_table.where(mine).select(columns).collect()) == sorted(
                single.run_table.select(columns).collect()
            )
            names = ["alpha", "query_id", "measure", "value"]
            alone = single.evaluate(micro.qrels).results()
            assert sorted(results.where(mine).select(names).collect()) == sorted(alone.select(names).collect())
            shares = {r[0] for r in results.where(mine).select("retained_frac").collect()}
            assert shares == ({0.75} if tag == "rdime" else {None})


def test_a_comparison_asks_a_filter_once(spark, micro, run):
    prf, asked = imp.PseudoRelevance(run, micro.docs, 2), spark.sparkContext.accumulator(0)

    def looked_at(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    class Watched:
        tag = "watched"

        def __call__(self, queries):
            frame = prf(queries)
            return frame.mapInArrow(looked_at, frame.schema)

    found = retrieve.compare(micro.queries, micro.docs, [Watched()], k=3)
    assert found.results(micro.qrels).count() == 11 * 4 and asked.value == 1


def test_feedback_without_a_vector_is_an_error(spark, micro):
    run = spark.createDataFrame(
        [("q", "1", 0, 2.0), ("q", "gone", 1, 1.0)], "query_id string, doc_id string, rank int, score double"
    )
    qrels = spark.createDataFrame([("q", "1", 1), ("q", "gone", 1)], "query_id string, doc_id string, relevance int")
    whole = run.where("doc_id <> 'gone'")
    for made in (
        imp.PseudoRelevance(run, micro.docs, 2), imp.Judged(qrels, micro.docs),
        imp.NegativeFeedback(imp.PseudoRelevance(whole, micro.docs, 1), run, micro.docs, 1),
    ):
        with pytest.raises(KeyError, match="gone"):
            made(micro.queries).collect()
