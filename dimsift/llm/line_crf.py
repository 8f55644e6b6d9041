"""Quality rules with a labelling of lines: a linear-chain conditional random field, decoded by Viterbi.

Every line with a word gets a few figures (symbols, repeats, case, length, ...). A chain over the lines
of a document marks each as content or boilerplate; documents whose content lines hold too small a
share of the words are dropped. The weights are fitted here by maximum likelihood, on a bounded sample
of labelled documents.

Labels are of documents, marks of lines. So lines are weighed on their own first, each with the label of its
document; a line that is clearly the other kind, such as a repeated one in a clean document or an ordinary
sentence in a poor one, then takes that mark, all others that of their document. The chain is fitted on these
marks, in which documents change from one kind to the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .labels import with_labels

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
CONTENT_SHARE = 0.5
SAMPLE_DOCS = 2000  # labelled documents the chain is fitted on
SAMPLE_LINES = 64  # a longer document gives so many in a row to the fit, from a place that its length tells
CLEARLY = 1.0  # log odds of a line that outweigh the label of its document
STEPS, RATE, DECAY = 150, 0.1, 1e-3

_symbol, _upper, _lower, _digit, _stop = (np.zeros(256, bool) for _ in range(5))
_symbol[list(SYMBOLS)] = True
_upper[ord("A") : ord("Z") + 1] = True
_lower[ord("a") : ord("z") + 1] = True
_digit[ord("0") : ord("9") + 1] = True
_stop[list(b".!?")] = True

FEATURES = (
    "symbols per character", "words with a symbol", "words in a repeated window", "equals an earlier line",
    "upper-case share of ASCII letters", "digits per character", "exclamation marks per word",
    "log of words", "distinct words per word", "ends a sentence", "mean characters of a word / 10",
)


def sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are true in each span."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


class Lines:
    """Lines with a word of the texts of a column, their figures, and counts per text."""

    def __init__(self, column: pa.Array):
        words = arrow.Words(column)
        data, n = words.data, len(column)
        self.n_words = words.counts
        lead = (data & 0xC0) != 0x80
        inside = ~arrow._is_gap[data]
        lo, hi = words.bounds[:-1], words.bounds[1:]
        self.word_chars = sums(lead & inside, lo, hi)
        self.n_symbols = sums(_symbol[data], lo, hi)
        windows, at = words.windows(REPEAT_WINDOW)
        keys = arrow.mix(windows ^ arrow.mix(words.text[at].astype(np.uint64)))
        _, which, often = np.unique(keys, return_inverse=True, return_counts=True)
        found = at[often[which] > 1]
        repeated = np.zeros(len(words.starts), bool)
        for k in range(REPEAT_WINDOW):
            repeated[found + k] = True
        self.n_repeat_words = np.bincount(words.text[repeated], minlength=n)
        # lines end at a line feed or with the text
        starts, ends = arrow.runs(data != 0x0A, words.bounds)
        first = np.searchsorted(words.starts, starts)
        last = np.searchsorted(words.starts, ends)
        some = last > first
        starts, ends, first, last = starts[some], ends[some], first[some], last[some]
        self.text = words.text[first]
        self.words = last - first
        keys = arrow.mix(arrow.span_hashes(data, starts, ends) ^ arrow.mix(self.text.astype(np.uint64)))
        _, earliest = np.unique(keys, return_index=True)
        again = np.ones(len(keys), bool)
        again[earliest] = False
        self.n_dup_lines = np.bincount(self.text[again], minlength=n)
        chars = sums(lead & inside, starts, ends).astype(float)
        upper, lower = sums(_upper[data], starts, ends), sums(_lower[data], starts, ends)
        symbol_words = sums(sums(_symbol[data], words.starts, words.ends) > 0, first, last)
        line_of_word = np.repeat(np.arange(len(first)), self.words)
        distinct = np.unique(arrow.mix(words.hashes() ^ arrow.mix(line_of_word.astype(np.uint64))), return_index=True)[1]
        self.figures = np.stack([
            sums(_symbol[data], starts, ends) / chars,
            symbol_words / self.words,
            sums(repeated, first, last) / self.words,
            again.astype(float),
            upper / np.maximum(1, upper + lower),
            sums(_digit[data], starts, ends) / chars,
            np.minimum(1, sums(data == 0x21, starts, ends) / self.words),
            np.log(self.words) / 5,
            np.bincount(line_of_word[distinct], minlength=len(first)) / self.words,
            _stop[data[words.ends[last - 1] - 1]].astype(float) if len(last) else np.zeros(0),
            chars / self.words / 10,
        ], axis=1) if len(first) else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Chain:
    """Scores of content against boilerplate: per figure, at rest, and ``moves[from, to]``; 1 is content."""

    weights: np.ndarray
    rest: float
    moves: np.ndarray

    def content(self, text: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """Most probable marks of all lines, where ``text`` tells whose they are; many texts in step."""
        if not len(text):
            return np.zeros(0, bool)
        score = figures @ self.weights + self.rest
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        length = np.diff(np.concatenate((first, [len(text)])))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best = np.zeros((len(first), 2))
        best[:, 1] = score[first]
        came = np.zeros((len(text), 2), bool)  # the better mark before, by mark here
        (m00, m01), (m10, m11) = self.moves
        for t in range(1, length[0]):
            live = np.searchsorted(-length, -t)  # texts with more than t lines come first
            a, b = best[:live, 0], best[:live, 1]
            at = first[:live] + t
            came[at, 0], came[at, 1] = b + m10 > a + m00, b + m11 > a + m01
            best[:live] = np.stack([np.maximum(a + m00, b + m10), np.maximum(a + m01, b + m11) + score[at]], axis=1)
        marks = np.zeros(len(text), bool)
        now = best[:, 1] >= best[:, 0]
        marks[first + length - 1] = now
        for t in range(length[0] - 1, 0, -1):
            live = np.searchsorted(-length, -t)
            at = first[:live] + t
            now[:live] = came[at, now[:live].astype(int)]
            marks[at - 1] = now[:live]
        return marks


def fit_chain(documents: list[tuple[np.ndarray, np.ndarray | int]]) -> Chain:
    """Maximum likelihood by gradient steps; ``documents`` are (figures of the lines, marks of the lines or one of all)."""
    n_features = len(FEATURES)
    documents = [(x, y) for x, y in documents if len(x)]
    if not documents:
        return Chain(np.zeros(n_features), 1.0, np.zeros((2, 2)))
    longest = max(len(x) for x, _ in documents)
    order = sorted(documents, key=lambda d: -len(d[0]))
    length = np.array([len(x) for x, _ in order])
    x = np.zeros((len(order), longest, n_features))
    y = np.zeros((len(order), longest), int)
    for i, (rows, marks) in enumerate(order):
        x[i, : len(rows)], y[i, : len(rows)] = rows, marks
    real = np.arange(longest) < length[:, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1 / len(order))
    theta = np.zeros(n_features + 5)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, rest, moves = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
        score = np.stack([np.zeros(x.shape[:2]), x @ w + rest], axis=2)
        ahead = np.zeros(score.shape)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        behind = np.zeros(score.shape)
        for t in range(longest - 2, -1, -1):
            onward = np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], onward, 0)
        whole = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)
        chance = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None]) * real
        gap = (y - chance) / len(order)
        pair = np.exp(
            ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - whole[:, None, None, None]
        ) * real[:, 1:, None, None]
        expected = pair.sum(axis=(0, 1)) / len(order)
        slope = np.concatenate((np.einsum("nt,ntf->f", gap, x), [gap.sum()], (seen - expected).ravel())) - DECAY * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2))


def line_marks(documents: list[tuple[np.ndarray, int]], clearly: float = CLEARLY) -> list[tuple[np.ndarray, np.ndarray]]:
    """Marks of lines for documents with one label each: the label's, but for lines that are clearly the other kind."""
    alone = fit_chain([(line[None], label) for rows, label in documents for line in rows])
    out = []
    for rows, label in documents:
        odds = rows @ alone.weights + alone.rest
        out.append((rows, np.where(odds > clearly, 1, np.where(odds < -clearly, 0, label))))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> Chain:
    """A chain fitted on at most ``sample`` labelled documents, and at most ``SAMPLE_LINES`` lines of each.

    Documents and labels without a key, and documents without a word, take no part; without any that do, all lines
    are content.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch["text"])
        rows, marks = [], []
        for i, label in enumerate(batch["label"].to_pylist()):
            mine = lines.figures[lines.text == i]
            if len(mine):
                start = int(lines.n_words[i]) % max(1, len(mine) - SAMPLE_LINES + 1)
                rows.append(mine[start : start + SAMPLE_LINES].ravel())
                marks.append(label)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(marks, pa.int32())], ["x", "label"])

    found = arrow.map_batches(with_labels(arrow.text_only(docs, key, text), labels, sample).select("text", "label"), step, "x array<double>, label int")
    rows = sorted((r["label"], r["x"]) for r in found.collect())
    return fit_chain(line_marks([(np.reshape(x, (-1, len(FEATURES))), min(1, label)) for label, x in rows]))


def judge(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept``.

    Null and empty texts have no words, so they fail the base rules, and a content share of 0. Repeated
    rows are judged each, null keys are kept; an empty table gives no rows. Texts are judged whole.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch["text"])
        marks = chain.content(lines.text, lines.figures)
        n = batch.num_rows
        content = np.bincount(lines.text[marks], lines.words[marks], n)
        share = content / np.maximum(1, lines.n_words)
        failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT_PERCENT * lines.n_words)
        counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(share),
             pa.array(~failed & (share >= CONTENT_SHARE))],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
        )

    rows = arrow.text_only(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow.map_batches(
        rows, step, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, content_share double, kept boolean",
    )
