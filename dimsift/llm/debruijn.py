"""Substring dedup by compaction of a De Bruijn graph of repeated word windows.

An edge is a window of ``WINDOW`` consecutive words; it leads from the node of its first words to the
node one word on. Its source is the first place of the smallest document that has it. An edge of a
document is covered if its source lies in a smaller document.

Not every window is shuffled. A window names its minimizer, the part of ``MINIMIZER`` words with the
least hash; a window can only repeat if its minimizer does, and neighbouring windows mostly share
theirs. Minimizers found in two or more documents are put into a sieve, sized by their number, and only windows
that pass it become edges.

An edge that comes very often is not shuffled either: such edges are few, their sources are
summed up in the map tasks and sent to all.

Covered edges of a document whose sources follow one another are one path: it ends where the graph
branches, or where the source does. Paths are kept as spans with the coordinates of their source and a
check sum of their edges, which the words must give again when the span is removed.

Edges are known by two hashes of their words, of 64 and 32 bits; only where both agree does an edge have a
source, so words are not removed for a chance meeting of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .sieve import Sieve

WINDOW = 13
MINIMIZER = 5
HOT_SHARE = 1000  # what comes more often than documents / HOT_SHARE is hot; so there is little of it
HOT_LEAST = 1000
CHECK = np.int64(0xFFFFFFFF)
NO_ID = -(1 << 63)  # no id is smaller, so nothing covers it
CHUNK_BYTES = 1 << 18  # of text that a step works on: its arrays take about a hundred bytes for each

COVERED = "doc_id long, place int, source long, source_place int, sum long"
SPANS = "doc_id long, start int, edges int, source long, source_start int, sum long"


def window_edges(words: arrow.Words, size: int) -> tuple[np.ndarray, ...]:
    """Hash of each window, its minimizer, the text it is in and the number of its first word there."""
    edges, at = words.windows(size)
    part = min(MINIMIZER, size)
    subs, sub_at = words.windows(part)
    if not len(at):
        return edges, edges, at, at
    # the parts of a window are side by side, as they are of one text
    least = np.lib.stride_tricks.sliding_window_view(subs, size - part + 1).min(axis=1)[np.searchsorted(sub_at, at)]
    return edges, least, words.text[at], at - words.first[words.text[at]]


def minimizers(docs: DataFrame, size: int) -> DataFrame:
    """``key, windows``: minimizers that more than one document has, and how many windows have them."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, least, text, _ = window_edges(arrow.Words(batch["text"]), size)
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(change)
        key, owner, windows = least[at], batch["doc_id"].to_numpy()[text[at]], np.diff(np.append(at, len(least)))
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        windows = np.add.reduceat(windows[order], np.flatnonzero(first)) if len(key) else windows
        return pa.RecordBatch.from_arrays(
            [pa.array(arrow.signed(key[first])), pa.array(owner[first]), pa.array(windows.astype(np.int32))], ["key", "doc_id", "windows"]
        )

    rows = arrow.map_batches(docs, step, "key long, doc_id long, windows int", CHUNK_BYTES)
    found = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("windows").alias("windows"))
    return found.where("low < high").select("key", "windows")


class HotEdges:
    """Sources of the edges of very many documents, sorted by edge; few enough to be sent to every task."""

    def __init__(self, table: pa.Table | None = None):
        names = ("edge", "twin", "source", "place")
        columns = [np.zeros(0, np.int64)] * 4 if table is None else [table[n].to_numpy().astype(np.int64) for n in names]
        order = np.argsort(columns[0])
        self.edge, self.twin, self.source, self.place = (c[order] for c in columns)

    def at(self, hashed: np.ndarray, twins: np.ndarray) -> np.ndarray:
        """Where each edge stands in the table, or -1."""
        if not len(self.edge):
            return np.full(len(hashed), -1)
        found = np.minimum(np.searchsorted(self.edge, hashed), len(self.edge) - 1)
        return np.where((self.edge[found] == hashed) & (self.twin[found] == twins), found, -1)


def twins_of(words: arrow.Words, size: int) -> np.ndarray:
    """A second hash of each window, of 32 bits: the hashes of its words put together with another multiplier."""
    at = np.flatnonzero(words.text[size - 1 :] == words.text[: max(0, len(words.text) - size + 1)]) if len(words.text) >= size else np.zeros(0, np.int64)
    return arrow.sequence_hashes(words.hashes(), at, at + size, seed=1).astype(np.uint32).view(np.int32)


def edges(docs: DataFrame, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> DataFrame:
    """``edge, twin, doc_id, place`` of the windows that ``chosen`` tells by their two hashes and minimizers."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = arrow.Words(batch["text"])
        hashed, least, text, place = window_edges(words, size)
        twins = twins_of(words, size)
        some = np.flatnonzero(chosen(hashed, twins, least))
        owner = batch["doc_id"].to_numpy()[text[some]]
        return pa.RecordBatch.from_arrays(
            [pa.array(arrow.signed(hashed[some])), pa.array(twins[some]), pa.array(owner), pa.array(place[some].astype(np.int32))],
            ["edge", "twin", "doc_id", "place"],
        )

    return arrow.map_batches(docs, step, "edge long, twin int, doc_id long, place int", CHUNK_BYTES)


def hot_edges(docs: DataFrame, found: DataFrame, size: int) -> HotEdges:
    """Edges that come more often than ``1 / HOT_SHARE`` of the number of documents.

    There are at most ``HOT_SHARE`` times as many as a mean document has windows, whatever the corpus.
    """
    often = max(HOT_LEAST, docs.count() // HOT_SHARE)
    keys = found.where(F.col("windows") > often).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    if not len(keys):
        return HotEdges()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys))
    rows = edges(docs, lambda _hashed, _twins, least: np.isin(least, sent.value), size)
    counted = rows.groupBy("edge", "twin").agg(
        F.min(F.struct("doc_id", "place")).alias("_source"), F.max("doc_id").alias("_high"), F.count("*").alias("_often")
    )
    hot = counted.where((F.col("_often") > often) & (F.col("_source.doc_id") < F.col("_high")))
    return HotEdges(hot.select("edge", "twin", F.col("_source.doc_id").alias("source"), F.col("_source.place").alias("place")).toArrow())


def covered_in_order(rows: DataFrame) -> DataFrame:
    """Covered edges by one pass over each partition in the order of edge, document and place.

    The pass keeps the source of the current edge only, however often the edge comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # edge and source of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            edge, twin, doc, place = (batch[n].to_numpy() for n in ("edge", "twin", "doc_id", "place"))
            first = np.ones(len(edge), bool)
            first[1:] = (edge[1:] != edge[:-1]) | (twin[1:] != twin[:-1])
            group = np.cumsum(first) - 1
            source, source_place = doc[first], place[first]
            if last is not None and last[:2] == (edge[0], twin[0]):
                source, source_place = source.copy(), source_place.copy()
                source[0], source_place[0] = last[2:]
            last = edge[-1], twin[-1], source[-1], source_place[-1]
            some = doc > source[group]
            columns = (doc[some], place[some], source[group][some], source_place[group][some], edge[some] & CHECK)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in COVERED.split(", ")])

    return rows.repartition("edge").sortWithinPartitions("edge", "twin", "doc_id", "place").mapInArrow(run, COVERED)


def paths(covered: DataFrame) -> DataFrame:
    """Spans of covered edges that follow one another, as do their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a path over two batches is two spans, which cover the same words
            if not batch.num_rows:
                continue
            doc, place, source, source_place, part = (batch[n].to_numpy() for n in batch.schema.names)
            first = np.ones(len(doc), bool)
            first[1:] = (
                (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
                | (source[1:] != source[:-1]) | (source_place[1:] != source_place[:-1] + 1)
            )
            at = np.flatnonzero(first)
            length = np.diff(np.append(at, len(doc))).astype(np.int32)
            columns = (doc[at], place[at], length, source[at], source_place[at], np.add.reduceat(part, at))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in SPANS.split(", ")])

    return covered.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> tuple[DataFrame, HotEdges]:
    """``doc_id, start, edges, source, source_start, sum``, stored: spans of ``edges + size - 1`` words found earlier.

    Edges of very many documents are not in the spans but in a table of their sources. ``docs`` has
    ``doc_id`` (long) and ``text``; rows without an id or a text take no part.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = materialize(minimizers(docs, size), "minimizers")
    sieve, hot = context.broadcast(Sieve(found)), hot_edges(docs, found, size)
    sent = context.broadcast(hot)
    rows = edges(docs, lambda hashed, twins, least: sieve.value.passes(least) & (sent.value.at(arrow.signed(hashed), twins) < 0), size)
    return materialize(paths(covered_in_order(rows)), "spans"), hot


def remove(docs: DataFrame, spans: DataFrame, hot: HotEdges, size: int = WINDOW, squeeze: bool = True) -> DataFrame:
    """``docs`` with ``n_words, n_removed`` and as ``text`` the words outside spans and hot edges, joined by one space.

    Only documents that may have spans are shuffled, other columns with them; a sieve of fixed size tells
    which. A span counts for a row if the edges there have the span's sum, so rows that share an id keep
    apart. Without ``squeeze``, texts that lose nothing stay as they are.
    """
    context = docs.sparkSession.sparkContext
    sieve = context.broadcast(Sieve(spans.select(F.xxhash64("doc_id").alias("key"))))
    sent = context.broadcast(hot)
    inner = docs.schema.simpleString()[len("struct<") : -1]
    kind = f"{inner},n_words:bigint,n_removed:bigint"
    marked = docs.withColumn("_key", F.xxhash64("doc_id"))

    def chosen(batch: pa.RecordBatch, yes: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(sieve.value.passes(batch["_key"].to_numpy()) == yes)).drop_columns(["_key"])

    def answer(batch: pa.RecordBatch, spans_of: list | None) -> pa.RecordBatch:
        words = arrow.Words(batch["text"])
        keep = np.ones(len(words.starts), bool)
        if spans_of is not None or len(sent.value.edge):
            hashed, at = words.windows(size)
            hashed = arrow.signed(hashed)
            sums = np.concatenate(([0], np.cumsum(hashed & CHECK)))
            edge_at = np.searchsorted(at, np.arange(len(words.starts) + 1))
            cover = np.zeros(len(words.starts) + 1, np.int64)
            hit = sent.value.at(hashed, twins_of(words, size) if len(sent.value.edge) else hashed)
            some = np.flatnonzero(hit >= 0)
            owner = batch["doc_id"].take(pa.array(words.text[at[some]])).fill_null(NO_ID).to_numpy()
            some = some[owner > sent.value.source[hit[some]]]
            cover[at[some]] += 1  # a word begins one window
            np.subtract.at(cover, at[some] + size, 1)
            for i, some in enumerate(spans_of or ()):
                lo, hi = words.first[i], words.first[i + 1]
                for s in some or ():
                    begin, end = lo + s["start"], lo + s["start"] + s["edges"] + size - 1
                    if end <= hi and sums[edge_at[begin] + s["edges"]] - sums[edge_at[begin]] == s["sum"]:
                        cover[begin] += 1
                        cover[end] -= 1
            keep = np.cumsum(cover)[:-1] == 0
        kept = np.concatenate(([0], np.cumsum(keep)))
        left = kept[words.first[1:]] - kept[words.first[:-1]]
        gone = words.counts - left
        texts = batch["text"]
        if squeeze or gone.any():
            old = None if squeeze else texts.to_pylist()
            texts = pa.array([words.joined(i, keep).decode() if squeeze or gone[i] else old[i] for i in range(batch.num_rows)], pa.string())
        # replaced in any case: all batches of a task need the same schema, down to what may be null
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", texts)
        return batch.append_column("n_words", pa.array(words.counts.astype(np.int64))).append_column("n_removed", pa.array(gone.astype(np.int64)))

    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges", "sum")).alias("_spans"))
    some = arrow.map_batches(marked, lambda batch: chosen(batch, True), docs.schema)
    some = some.join(by_doc.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, "_spans")
    cut = arrow.map_batches(some, lambda batch: answer(batch.drop_columns(["_spans"]), batch["_spans"].to_pylist()), kind, CHUNK_BYTES)
    return arrow.map_batches(marked, lambda batch: answer(chosen(batch, False), None), kind, CHUNK_BYTES).unionByName(cut)


def dedup(
    df: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", squeeze: bool = True, carry: list[str] | None = None
) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: every row without the words that a smaller document's windows cover.

    A null text has no words; a row without an id keeps all of its words and covers none. Rows that
    repeat an id do not cover each other. An empty table gives no rows. Texts are taken whole. Columns
    named in ``carry`` come along.
    """
    docs = df.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(carry or [])
    )
    spans, hot = repeated_spans(docs.select("doc_id", "text"), size)
    return remove(docs, spans, hot, size, squeeze)
