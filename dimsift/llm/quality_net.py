"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token has a fixed sparse vector of a few +1 and -1, drawn from its hash. The vector of a token
is the sum of the sparse vectors of its neighbours, over all documents, and of its own. Tokens are the
words without outer punctuation and in lower case, and for every word its shape (case, punctuation
behind it, whether it equals the word before, whether its three words came earlier in the text).
Tokens are hashed into a fixed number of rows, so the vectors have one size for any corpus and unseen
words have one too. A document is the mean of its words' vectors beside the mean of its shapes'
vectors; the network and the temperature of its probabilities are fitted on a bounded sample of
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .labels import fold, with_labels

WORD_ROWS, SHAPE_ROWS = 1 << 14, 1 << 10
ROWS = WORD_ROWS + SHAPE_ROWS
DIMS = 32
NONZERO = 2  # entries of a token's own sparse vector
REACH = 2  # words on either side that count as neighbours
HIDDEN = 16
SAMPLE_DOCS = 6000  # labelled documents the network is fitted on
CALIBRATION_FOLD = 1  # of the sample, kept for the temperature
THRESHOLD = 0.3
STEPS, RATE, DECAY = 400, 0.01, 1e-4

_letter = np.zeros(256, bool)
_letter[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_letter[0x80:] = True
_to_lower = np.arange(256, dtype=np.uint8)
_to_lower[ord("A") : ord("Z") + 1] += 32


def own_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the entries of each row's sparse vector."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, DIMS, (ROWS, NONZERO)), draw.choice((-1.0, 1.0), (ROWS, NONZERO))


class Tokens:
    """Rows of the word and of the shape of every word, and the text each is in."""

    def __init__(self, column: pa.Array):
        words = arrow.Words(column)
        data, starts, ends = words.data, words.starts, words.ends
        self.text, self.counts = words.text, words.counts
        n = len(starts)
        letters = np.flatnonzero(_letter[data])
        lo, hi = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
        some = hi > lo
        padded = np.append(letters, 0)
        first = np.where(some, padded[np.minimum(lo, len(letters))], starts)
        last = np.where(some, padded[np.maximum(hi - 1, 0)] + 1, ends)
        core = arrow.span_hashes(_to_lower[data], first, last)
        self.word = (core % np.uint64(WORD_ROWS)).astype(np.int64)
        upper = (data >= ord("A")) & (data <= ord("Z"))
        total = np.concatenate(([0], np.cumsum(upper)))
        caps = total[ends] - total[starts]
        case = np.where(caps == 0, 0, np.where(caps == 1, 1, 2))
        tail = arrow.span_hashes(data, np.where(some, last, ends), ends)
        head = first > starts
        same = np.zeros(n, bool)
        same[1:] = (core[1:] == core[:-1]) & (self.text[1:] == self.text[:-1])
        windows, at = words.windows(3)
        keys = arrow.mix(windows ^ arrow.mix(self.text[at].astype(np.uint64)))
        again = np.zeros(n, bool)
        if len(keys):
            later = np.ones(len(keys), bool)
            later[np.unique(keys, return_index=True)[1]] = False
            again[at[later]] = True
        code = case + 3 * head + 6 * same + 12 * again + 24 * ~some
        shape = arrow.mix(tail ^ arrow.mix(code.astype(np.uint64) + np.uint64(1)))
        self.shape = (shape % np.uint64(SHAPE_ROWS)).astype(np.int64) + WORD_ROWS


def neighbour_sums(tokens: Tokens, dims: np.ndarray, signs: np.ndarray, into: np.ndarray) -> None:
    """Add the sparse vectors of the neighbours of every token to its row of ``into`` (flat)."""
    for rows in (tokens.word, tokens.shape):
        for step in range(1, REACH + 1):
            near = np.flatnonzero(tokens.text[step:] == tokens.text[:-step])
            for a, b in ((near, near + step), (near + step, near)):
                for k in range(NONZERO):
                    cell = rows[a] * DIMS + dims[rows[b], k]
                    into += np.bincount(cell, signs[rows[b], k], ROWS * DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all rows, from every text of ``docs``; ``ROWS * DIMS`` numbers reach the driver."""
    dims, signs = own_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(ROWS * DIMS)
        for batch in batches:
            for part in arrow.text_chunks(batch):
                neighbour_sums(Tokens(part["text"]), dims, signs, into)
        table = into.reshape(ROWS, DIMS)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        columns = [pa.array(used.astype(np.int32)), *(pa.array(table[used, k].astype(np.int64)) for k in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, ["row", *(f"d{k}" for k in range(DIMS))])

    schema = "row int, " + ", ".join(f"d{k} long" for k in range(DIMS))
    summed = docs.select("text").mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMS)))
    out = np.zeros((ROWS, DIMS))
    for r in summed.collect():  # at most ROWS rows
        out[r["row"]] = r[1:]
    out /= np.maximum(1, np.linalg.norm(out, axis=1, keepdims=True))
    np.add.at(out, (np.repeat(np.arange(ROWS), NONZERO), dims.ravel()), signs.ravel() / np.sqrt(NONZERO))
    return out.astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Two means per text, of its words and of its shapes; zeros without words."""
    tokens = Tokens(column)
    n = len(column)
    out = np.zeros((n, 2 * DIMS))
    for side, rows in enumerate((tokens.word, tokens.shape)):
        key, often = np.unique(tokens.text * ROWS + rows, return_counts=True)
        text, row = key // ROWS, key % ROWS
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, int)
        if len(first):
            total = np.add.reduceat(vectors[row] * often[:, None], first, axis=0)
            out[text[first], side * DIMS : (side + 1) * DIMS] = total / tokens.counts[text[first], None]
    return out


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray  # weights and, as the last row, offsets
    second: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.centre) / self.scale) @ self.first[:-1] + self.first[-1])
        return h @ self.second[:-1] + self.second[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, seed: int = 11) -> Network:
    """Cross entropy by gradient steps, then the temperature with the least loss on the calibration rows."""
    train = ~calibration
    if train.sum() == 0 or len(np.unique(y[train])) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(2 * DIMS), np.ones(2 * DIMS), np.zeros((2 * DIMS + 1, HIDDEN)), np.append(np.zeros(HIDDEN), np.log(rate / (1 - rate))))
    draw = np.random.default_rng(seed)
    centre, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    z, goal = (x[train] - centre) / scale, y[train]
    first = np.vstack([draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)])
    second = np.append(draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (first, second)]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ first[:-1] + first[-1])
        error = (1 / (1 + np.exp(-(h @ second[:-1] + second[-1]))) - goal) / len(goal)
        back = np.outer(error, second[:-1]) * (1 - h**2)
        slopes = (np.vstack([z.T @ back, back.sum(axis=0)]) + DECAY * first, np.append(h.T @ error, error.sum()) + DECAY * second)
        for p, slope, m in zip((first, second), slopes, moments):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.999 * m[1] + 0.001 * slope**2
            p -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, first, second)
    if calibration.sum() < 10 or len(np.unique(y[calibration])) < 2:
        return net
    logits, goal = net.logits(x[calibration]), y[calibration]
    temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: log_loss(logits / t, goal))
    return Network(centre, scale, first, second, float(temperature))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> QualityModel:
    """Word vectors from all texts; the network from at most ``sample`` labelled rows outside fold 0."""
    rows = arrow.text_only(docs, "doc_id", "text")
    vectors = word_vectors(rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pool(batch["text"], shared.value)
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch["label"], batch["fold"]], ["x", "label", "fold"])

    chosen = with_labels(rows, labels, sample).select("text", "label", fold().cast("int").alias("fold"))
    # in one order, whichever task ended first, so that a fit can be repeated
    found = sorted((r["fold"], r["label"], r["x"]) for r in arrow.map_batches(chosen, step, "x array<double>, label int, fold int").collect())
    x = np.array([r[2] for r in found]).reshape(-1, 2 * DIMS)
    y = np.array([min(1, r[1]) for r in found], float)
    return QualityModel(vectors, fit_network(x, y, np.array([r[0] == CALIBRATION_FOLD for r in found], bool)))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: the score is higher where label 1 is likelier.

    Null and empty texts get the score of a document without words. Repeated rows are scored each; a
    null key is not held out. Texts are scored whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scores = m.network.scores(pool(batch["text"], m.vectors))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = arrow.text_only(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = arrow.map_batches(rows, step, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (with a ``text``) that the classifier does not reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return batch.filter(pa.array(m.network.scores(pool(batch["text"], m.vectors)) >= threshold))

    return arrow.map_batches(docs, step, docs.schema)
