"""Source divergence audit: which sources of a language use words unlike each other, and which words do it.

Every source of a language gives each kept term a smoothed share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``,
and ``f = floor((p - q)^2 / q)`` says how far it is from another share ``q``. A pair of sources is the sum of
``f`` over all kept terms, though most terms are absent from most sources. So a pair starts from ``V`` times
the ``f`` of two absent terms, and only the counts above zero correct it:

* ``single``: a term that one of the two has, corrected once per source and count (a histogram);
* ``joint``: a term that both have. The nonzero counts of a term, in the order of the sources, are a row; rows
  go into a frequent-pattern tree with their multiplicities. A node stands for all rows that begin alike up to
  it, so what it adds with each of its ancestors is computed once for all of them.

Equal rows are counted before, and rows are dealt by ranges of their beginnings, so those that begin alike meet in
one task, and none is too large. A tree of many nodes is summed up and begun anew: sums stay exact, only less
is shared.

All numbers are whole numbers. A share is divided out in three digits of base 1000, so counts up to 9 * 10^15
of one source stay within 64 bits; sums of corrections are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialize
from . import arrow

MIN_DOCS = 3  # documents of its language that a kept term is in
TOP_TERMS = 200
SCALE_DIGITS = 3  # of base 1000: shares are parts of 10^9
TREE_NODES = 400_000  # a tree is summed up when it has so many
RANGE_ITEMS = 2  # of a row, that ranges are drawn by

PARTIAL = "lang string, source string, term string, count long, docs long"

# a term: ASCII letters and all characters beyond ASCII, whose bytes are 0x80 and above
_in_term = np.zeros(256, bool)
_in_term[0x80:] = _in_term[0x41:0x5B] = _in_term[0x61:0x7B] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, with A to Z in lower case, and the text that each is in."""
    data, bounds = arrow.text_bytes(column)
    inside = _in_term[data]
    starts, ends = arrow.runs(inside, bounds)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = _lower[data[inside]]
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return terms, np.searchsorted(bounds, starts, side="right") - 1


def grouped(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the columns for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents per (lang, source, term) of a batch, and each (lang, source) with a null term."""
    langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
    of_doc = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    groups, of_doc = np.unique(of_doc, return_inverse=True)
    terms, doc = terms_of(batch["text"])
    encoded = terms.dictionary_encode()
    size = max(1, len(encoded.dictionary))
    in_doc, count = grouped(doc * size + encoded.indices.to_numpy(), np.ones(len(terms), np.int64))
    keys, count, docs = grouped(of_doc[in_doc // size] * size + in_doc % size, count, np.ones(len(in_doc), np.int64))
    group = groups[np.concatenate((np.arange(len(groups)), keys // size))]
    none = len(groups)
    zeros = np.zeros(none, np.int64)
    term = pa.concat_arrays([pa.nulls(none, pa.string()), encoded.dictionary.take(pa.array(keys % size))])
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(group // len(sources.dictionary))),
            sources.dictionary.take(pa.array(group % len(sources.dictionary))),
            term, pa.array(np.concatenate((zeros, count))), pa.array(np.concatenate((zeros, docs))),
        ],
        ["lang", "source", "term", "count", "docs"],
    )


def share(count: str, size: str) -> str:
    """SQL of ``1 + floor(10^9 * (count + 1) / size)`` in 64 bits; ``size`` is at least ``count + 1``."""
    rest, digits = f"({count} + 1)", []
    for _ in range(SCALE_DIGITS):
        digits.append(f"({rest} * 1000L) div {size}")
        rest = f"(({rest} * 1000L) % {size})"
    total = "0L"
    for d in digits:
        total = f"({total} * 1000L + {d})"
    return f"(1L + {total})"


def apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``share`` on arrays."""
    rest, total = count + 1, np.zeros_like(count)
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        total, rest = total * 1000 + rest // size, rest % size
    return total + 1


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PatternTree:
    """A frequent-pattern tree over rows of ``(source, count)`` in the order of the sources."""

    def __init__(self):
        self.child: dict[tuple[int, int, int], int] = {}
        self.parent: list[int] = []
        self.source: list[int] = []
        self.count: list[int] = []
        self.times: list[int] = []

    def __len__(self) -> int:
        return len(self.parent)

    def insert(self, sources: list[int], counts: list[int], times: int) -> None:
        at = -1
        for s, c in zip(sources, counts):
            key = at, s, c
            at = self.child.get(key, -1)
            if at < 0:
                at = self.child[key] = len(self.parent)
                self.parent.append(key[0])
                self.source.append(s)
                self.count.append(c)
                self.times.append(0)
            self.times[at] += times

    def corrections(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``source, item, value`` sums over nodes and their ancestors, one distance of ancestors at a time.

        ``size`` is N + V of every source.
        """
        parent, source, count, times = (np.array(x, np.int64) for x in (self.parent, self.source, self.count, self.times))
        own, none = shares(count, size[source]), shares(np.zeros_like(size), size)
        node, up = np.arange(len(parent)), parent.copy()
        while len(node := node[up[node] >= 0]):
            above = up[node]
            for a, b in ((node, above), (above, node)):
                p, q, p0, q0 = own[a], own[b], none[source[a]], none[source[b]]
                joint = squares(p, q) - squares(p, q0) - squares(p0, q) + squares(p0, q0)
                pair, of = np.unique(source[a] * len(size) + source[b], return_inverse=True)
                value = np.zeros(len(pair), np.int64)
                np.add.at(value, of, joint * times[node])
                yield pair // len(size), pair % len(size), value
            up[node] = parent[above]


def joint_corrections(rows: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of ``lang, row (source, count, size), times``: what terms of both sources add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, lang, known, size = PatternTree(), None, {}, []

        def done() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(known), pa.string())
            for a, b, value in tree.corrections(np.array(size, np.int64)):
                for i in range(0, len(value), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value[part]), pa.string()), names.take(pa.array(a[part])), names.take(pa.array(b[part])), pa.array(value[part])],
                        ["lang", "source", "item", "value"],
                    )

        for batch in batches:
            items = batch["row"]
            flat = items.flatten()
            sources, counts, sizes = flat.field("source").to_pylist(), flat.field("count").to_pylist(), flat.field("size").to_pylist()
            ends = np.cumsum(items.value_lengths().to_numpy()).tolist()
            start = 0
            for new, times, end in zip(batch["lang"].to_pylist(), batch["times"].to_pylist(), ends):
                if new != lang or len(tree) >= TREE_NODES:
                    yield from done()
                    tree, lang, known, size = PatternTree(), new, {}, []
                for s, n in zip(sources[start:end], sizes[start:end]):
                    if s not in known:
                        known[s] = len(known)
                        size.append(n)
                tree.insert([known[s] for s in sources[start:end]], counts[start:end], times)
                start = end
        yield from done()

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def summed(value: Column) -> Column:
    """A sum whose parts may pass 64 bits before they cancel out."""
    return F.sum(value.cast("decimal(38,0)")).cast("long")


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of a table ``text, lang, source``.

    Part ``pair``: ``item`` is each other source of the language, ``value`` how far the source is from it, over
    all terms in at least ``min_docs`` documents of the language. Part ``term``: the ``top`` terms that the
    source has and uses more than its language does. Ranks go by value, then by the bytes of the item.

    A null text, language or source counts as empty, and empty ones are values like others. Every row is a
    document, also where rows repeat. A language without kept terms has pairs of value 0; an empty table gives
    no rows. Texts are taken whole.
    """
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = arrow.map_batches(rows, count_terms, PARTIAL)
    counted = materialize(
        partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts"
    )
    total = (
        counted.where("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("count").alias("of_lang")).where(F.col("docs") >= min_docs)
    )
    kept = materialize(counted.drop("docs").join(total.drop("docs"), ["lang", "term"]), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.max("of_lang").alias("of_lang")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("of_lang").alias("n_lang")
    )
    # one row per (lang, source)
    groups = materialize(
        counted.where("term IS NULL").select("lang", "source")
        .join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
        .join(langs, "lang", "left").na.fill(0, ["n", "terms", "n_lang"])
        .selectExpr("lang", "source", "terms", "n + terms AS size", "n_lang + terms AS lang_size")
        .withColumn("absent", F.expr(f"CASE WHEN terms > 0 THEN {share('0L', 'size')} END")),
        "source-sizes",
    )
    sized = kept.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", F.expr(share("count", "size")))
    return _pairs(sized, groups).unionByName(_terms(sized, top))


def _terms(sized: DataFrame, top: int) -> DataFrame:
    found = sized.select("lang", "source", F.col("term").alias("item"), "p", F.expr(share("of_lang", "lang_size")).alias("q"))
    found = found.where("p > q").withColumn("value", F.expr(apart("p", "q")))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Spark cuts each group to its best rows before the shuffle
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language; as many rows as the answer has, and the counts of each source once per other."""
    other = broadcast_if_small(groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("item_absent")))
    none = apart("absent", "item_absent")
    start = groups.join(other, "lang").where("source <> item").selectExpr(
        "lang", "source", "item", f"CASE WHEN terms = 0 THEN 0L ELSE terms * {none} END AS value"
    )
    # how often a source has a count, instead of its terms
    histogram = sized.groupBy("lang", "source", "absent", "p").agg(F.count("*").alias("times"))
    single = histogram.join(other, "lang").where("source <> item").selectExpr(
        "lang",
        f"""inline(array(
            named_struct('source', source, 'item', item, 'value', times * ({apart("p", "item_absent")} - {none})),
            named_struct('source', item, 'item', source, 'value', times * ({apart("item_absent", "p")} - {apart("item_absent", "absent")}))))""",
    )
    in_order = F.sort_array(F.collect_list(F.struct("source", "count", "size"))).alias("row")
    patterns = sized.groupBy("lang", "term").agg(in_order).where(F.size("row") > 1).groupBy("lang", "row").agg(F.count("*").alias("times"))
    # stored, since the ranges are drawn from it first; few bytes, but much work in each
    patterns = materialize(patterns, "term-rows")
    tasks = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that begin alike are neighbours; the hash parts those of one very frequent beginning
    begin = F.transform(F.slice("row", 1, RANGE_ITEMS), lambda x: F.struct(x["source"], x["count"]))
    patterns = patterns.withColumns({"_begin": begin, "_hash": F.xxhash64("row")})
    patterns = patterns.repartitionByRange(tasks, "lang", "_begin", "_hash").sortWithinPartitions("lang", "_begin").drop("_begin", "_hash")
    joint = joint_corrections(patterns)
    parts = start.unionByName(single).unionByName(joint)
    pairs = parts.groupBy("lang", "source", "item").agg(summed(F.col("value")).alias("value"))
    farthest = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(farthest).alias("rank"))
