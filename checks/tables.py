"""Two collections made of the given tables, whole.

``passages``: every ``benchmark`` text is a query, every row of ``documents`` a document.
``dialogue``: every user turn of ``conversations`` is a query, every assistant turn a document;
the assistant turn that follows a user turn is that query's generated answer.

Texts become vectors with the weightless hash model. Judgments are pooled: the best 50 documents
of a second, unrelated hash model, graded by a score derived from that model's inner product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimsift.operators.encode import encode_text, hash_model
from dimsift.operators.evaluate import evaluate
from dimsift.operators.importance import Answers, Judged, NegativeFeedback, PseudoRelevance
from dimsift.operators.report import BASELINE
from dimsift.operators.search import search
from dimsift.operators.tune import graded_qrels
from dimsift.plans import retrieve
from dimsift.schemas import REPORT_INPUT
from dimsift.storage import materialize, spread

MODEL = "hash64"
DEPTH = 100  # of the baseline and masked runs
POOL = 50  # documents judged per query
MEASURES = ("nDCG@10", "AP", "R@100", "RR@10")
COLLECTIONS = ("passages", "dialogue")
FILTERS = ("prf-k2", "prf-k2-eclipse")
K, KNEG = 2, 5
# trec-style score columns are in single precision; this spreads the pool over the four grades
SCORE_SCALE, SCORE_SHIFT = 3.0, 1.5

_stored: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Derive everything anew on next use."""
    _stored.clear()


class Tables:
    """What the queries share, each table derived once per session and data directory, then stored."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = materialize(make(), name)
        return _stored[key]

    # texts

    def doc_texts(self, collection: str) -> DataFrame:
        if collection == "passages":
            return self.raw("documents").select(F.col("doc_id").cast("string"), "text")
        turns = self.raw("conversations").where(F.col("role") == "assistant")
        return turns.select(_turn_id("turn").alias("doc_id"), "text")

    def query_texts(self, collection: str) -> DataFrame:
        if collection == "passages":
            return self.raw("benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
        turns = self.raw("conversations").where(F.col("role") == "user")
        return turns.select(_turn_id("turn").alias("query_id"), "text")

    def answers(self) -> DataFrame:
        turns = self.raw("conversations").where(F.col("role") == "assistant")
        return turns.select(_turn_id(F.col("turn") - 1).alias("query_id"), "text")

    # vectors

    def docs(self, collection: str, salt: int = 0) -> DataFrame:
        return self._once(
            f"{collection}-docs-{salt}",
            lambda: encode_text(spread(self.doc_texts(collection)), hash_model(salt=salt)),
        )

    def queries(self, collection: str, salt: int = 0) -> DataFrame:
        return self._once(
            f"{collection}-queries-{salt}",
            lambda: encode_text(self.query_texts(collection), hash_model(salt=salt)),
        )

    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vec")
        )

    # runs and judgments

    def run(self, collection: str) -> DataFrame:
        return self._once(
            f"{collection}-run",
            lambda: search(self.docs(collection), self.queries(collection), DEPTH, MODEL),
        )

    def ce_scores(self, collection: str) -> DataFrame:
        pool = self._once(
            f"{collection}-pool", lambda: search(self.docs(collection, 1), self.queries(collection, 1), POOL)
        )
        score = F.col("score") * SCORE_SCALE - SCORE_SHIFT
        return pool.select("query_id", "doc_id", score.alias("ce_score"))

    def qrels(self, collection: str) -> DataFrame:
        return graded_qrels(self.ce_scores(collection))

    # importance

    def prf(self, collection: str, k: int = K) -> PseudoRelevance:
        return PseudoRelevance(self.run(collection), self.docs(collection), k)

    def eclipse(self, collection: str) -> NegativeFeedback:
        return NegativeFeedback(self.prf(collection), self.run(collection), self.docs(collection), KNEG)

    def oracular(self, collection: str) -> Judged:
        return Judged(self.qrels(collection), self.docs(collection))

    def answer_filter(self) -> Answers:
        return Answers(self.answers(), hash_model(), "dialogue-answers")

    def texts_and_vectors(self, collection: str) -> DataFrame:
        return self.queries(collection).join(self.query_texts(collection), "query_id")

    def sweep(self, collection: str, name: str = "prf-k2", selector: str = "top-alpha", **options):
        chosen = {"prf-k2": self.prf, "prf-k2-eclipse": self.eclipse}[name](collection)
        return retrieve.sweep(
            self.queries(collection), self.docs(collection), chosen, selector, k=DEPTH, model=MODEL, **options
        )

    # everything the reports compare

    def results(self) -> DataFrame:
        return self._once("results", lambda: reduce(DataFrame.unionByName, self._results()))

    def _results(self):
        for collection in COLLECTIONS:
            qrels = self.qrels(collection)
            base = evaluate(self.run(collection), qrels, MEASURES, depth=DEPTH)
            yield _labelled(base, collection, filter=F.lit(BASELINE))
            found = retrieve.compare(
                self.queries(collection), self.docs(collection), [self.prf(collection), self.eclipse(collection)],
                k=DEPTH, model=MODEL,
            )
            yield _labelled(found.results(qrels, MEASURES), collection)


def _turn_id(turn) -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), (F.col(turn) if isinstance(turn, str) else turn).cast("string"))


def _labelled(results: DataFrame, collection: str, **given: Column) -> DataFrame:
    """The report columns, with nulls for those a run does not have."""
    given |= {"collection": F.lit(collection), "model": F.lit(MODEL)}
    return results.select(*[
        given.get(f.name, F.col(f.name) if f.name in results.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in REPORT_INPUT.fields
    ])
