import math

from pyspark.sql import functions as F

from dimsift.functions import arrays, text
from dimsift.operators import select

from .conftest import approx


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_dot_and_normalize(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, arrays.dot(a, b)) == 11.0
    assert one(spark, arrays.l2_normalize(a)) == approx([0.6, 0.8])
    assert one(spark, arrays.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_dim_ranks_break_ties_by_dimension(spark):
    values = F.array(*[F.lit(v) for v in (0.0, 2.0, -0.0, 2.0, -1.0)])
    assert one(spark, arrays.dim_ranks(values)) == [3, 1, 4, 2, 5]


def test_alpha_to_k_rounds_halves_to_even(spark):
    for alpha, dims in [(0.5, 5), (0.3, 5), (0.1, 64), (0.7, 64), (1.0, 64), (0.001, 64), (0.5, 7)]:
        k = one(spark, arrays.alpha_to_k(F.lit(alpha), F.lit(dims)))
        assert k == max(1, round(alpha * dims))


def test_noise_threshold(spark):
    q = F.array(*map(F.lit, (0.5, -0.25, 0.75, 0.25)))
    u = F.array(*map(F.lit, (0.25, 0.125, 0.375, 0.0)))
    assert one(spark, arrays.noise_threshold(q, u)) == 0.046875
    assert one(spark, arrays.threshold_weights(q, u)) == [1, 1, 1, 0]


def test_normalize_text(spark):
    cases = {
        "a\u0001b\u0008c\u001bd­e": "abcde",
        "a\u0010b": "a\u0010b",
        "a\u000bb\u000cc\u0085d": "a b c d",
        "-‐‑⁃‒–—―−－⁻": "-" * 11,
        "\"“”„‟": '"' * 5,
        "'‘’‚‛՚Ꞌꞌ＇`´": "'" * 11,
        "′‵″‶‴‷⁗": "'" * (1 + 1 + 2 + 2 + 3 + 3 + 4),
        "wait… . . . and . . . on": "wait... ... and ... on",
        "1⁄2∕3/4": "1/2/3/4",
        "~˜∼～+＋": "~˜∼～+＋",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("out", text.normalize("raw"))
    for row in df.collect():
        assert row["out"] == cases[row["raw"]], repr(row["raw"])
    assert spark.range(1).select(text.normalize(F.lit(None).cast("string"))).first()[0] is None


def test_text_sources_are_disjoint():
    sources, targets = text.translate_pairs()
    every = sources + "".join(text.TO_SEVERAL)
    assert len(set(every)) == len(every)
    assert not set(every) & set(targets)
    assert math.isfinite(len(targets)) and len(targets) < len(sources)


ODD = [
    ([1.0, -2.0, 0.5, 0.0], [0.5, 0.5, 0.25, -1.0]),
    ([1.0, 2.0], [float("nan"), 1.0]),
    ([3.0, None, 1.0, 2.0], [None, 1.0, float("inf"), None]),
    ([1.0, 2.0, 3.0], [1.0]),
    ([], []),
    (None, [1.0, 0.0, -0.0]),
    ([1e30, 1.0], [1e30, -0.0]),
    ([1.0], None),
]


def test_rows_at_once_are_as_row_by_row(spark):
    """Nulls, several lengths and equal values, for products and for the masks of all fractions."""
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(ODD * 3)], "query_id string, vec array<double>, weights array<double>").repartition(2)
    expected = df.select("query_id", arrays.times("vec", "weights").cast("array<float>").alias("vec"))
    assert sorted(map(str, select.apply_weights(df).collect())) == sorted(map(str, expected.collect()))
    alphas, frame = (0.1, 0.375, 0.5, 1.0), df.withColumnRenamed("weights", "importance")
    ranked = frame.withColumn("r", arrays.dim_ranks("importance"))
    expected = [
        ranked.select("query_id", F.lit(str(a)).alias("alpha"), F.lit(a).alias("alpha_value"), "vec",
                      arrays.top_k_weights(F.col("r"), arrays.alpha_to_k(F.lit(a), F.size("r"))).alias("weights"))
        for a in alphas
    ]
    found = select.TopAlpha().weights(frame, alphas)
    assert sorted(map(str, found.collect())) == sorted(str(r) for e in expected for r in e.collect())
