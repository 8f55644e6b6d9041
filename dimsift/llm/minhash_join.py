"""N-gram Jaccard join by MinHash banding.

A document is the set of its word n-grams. Signatures are cut into bands; documents that agree in a
whole band meet in a shuffle on the band's hash. Rows of a band and the number of bands follow from the
recall wanted at the threshold. Meeting there only says who may be similar: the groups that hang
together by meetings are then compared pair by pair on their full sets, in blocks of bounded size, so
every link between members is found and counted, and no pair of documents is ever a row.

Documents with equal sets are one node from the start, however many there are.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .components import components

WORDS = 5  # of an n-gram
THRESHOLD = 0.8
RECALL = 0.999  # of pairs at the threshold
MAX_HASHES = 256
BLOCK_DOCS, BLOCK_GRAMS = 1000, 500_000  # of one side of a comparison, about
COLUMNS = 2048  # n-grams compared at a time
SEED = 3


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)`` with the most rows per band that reach the recall with at most ``most`` hashes."""
    best = (ceil(log(1 - recall) / log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = ceil(log(1 - recall) / log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def grams(words: arrow.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts as ``(hash, text)``, by text; a shorter text is one n-gram, none if empty."""
    hashes, at = words.windows(size)
    text = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    whole = arrow.sequence_hashes(words.hashes(), words.first[short], words.first[short + 1])
    hashes, text = np.concatenate((hashes, whole)), np.concatenate((text, short))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, low, high, grams, bands``: digest and number of the n-grams, hash of each band (none if empty)."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, text = grams(arrow.Words(batch["text"]), size)
        n = batch.num_rows
        first = np.searchsorted(text, np.arange(n + 1))
        count = np.diff(first)
        low, high = (arrow.sequence_hashes(hashes, first[:-1], first[1:], seed) for seed in (0, 1))
        some = np.flatnonzero(count)
        band = np.zeros((len(some), bands), np.uint64)
        if len(some):
            for i, factor in enumerate(factors):
                least = np.minimum.reduceat(hashes * factor, first[some])
                band[:, i // rows] = arrow.mix(band[:, i // rows] ^ least + np.uint64(i))
        ends = np.zeros(n + 1, np.int32)
        ends[1:] = np.cumsum(np.where(count > 0, bands, 0))
        lists = pa.ListArray.from_arrays(ends, pa.array(arrow.signed(band.ravel())))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(arrow.signed(low)), pa.array(arrow.signed(high)), pa.array(count.astype(np.int32)), lists],
            ["doc_id", "low", "high", "grams", "bands"],
        )

    return arrow.map_batches(docs, step, "doc_id long, low long, high long, grams int, bands array<long>")


def meetings(nodes: DataFrame) -> DataFrame:
    """``a, b``: every node (``node, bands``) with the smallest of each band it shares."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("_most")).where("least < _most")
    return rows.join(least.drop("_most"), "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of ``left`` shares with each of ``right``."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), COLUMNS):
        part = common[i : i + COLUMNS]
        flags = []
        for hashes, owner in sides:
            at = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            hit = part[at] == hashes
            table = np.zeros((owner[-1] + 1, len(part)), np.float32)
            table[owner[hit], at[hit]] = 1
            flags.append(table)
        out += flags[0] @ flags[1].T
    return out


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; without a right side, which of the left among themselves."""
    shared = overlaps(left, left if right is None else right).astype(np.float64)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in (left if right is None else right)])[None, :]
    linked = shared >= threshold * (sizes - shared) - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric table of links."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            queue = [start]
            root[start] = start
            while queue:
                near = np.flatnonzero(linked[queue.pop()] & (root < 0))
                root[near] = start
                queue += near.tolist()
    return root


def verified(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """``node, links, parent`` of ``node, group, text, blocks``: links found in one comparison, and a smaller node reached."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    sides = members.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    sides = sides.select(
        "node", "text", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, of = table["node"].to_numpy(), table["block"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sets = []
        for part in arrow.text_chunks(table.select(["text"]).combine_chunks().to_batches()[0]):
            hashes, text = grams(arrow.Words(part["text"]), size)
            sets += np.split(hashes, np.searchsorted(text, np.arange(1, part.num_rows)))
        linked = np.zeros((len(node), len(node)), bool)
        mine, others = np.flatnonzero(of == i), np.flatnonzero(of == j)
        if i == j:
            linked = compare(sets, None, threshold)
        elif len(mine) and len(others):
            found = compare([sets[k] for k in mine], [sets[k] for k in others], threshold)
            linked[np.ix_(mine, others)] = found
            linked[np.ix_(others, mine)] = found.T
        return pa.table({"node": node, "links": pa.array(linked.sum(axis=1).astype(np.int64)), "parent": node[roots(linked)]})

    return sides.groupBy("group", "i", "j").applyInArrow(run, "node long, links long, parent long")


def jaccard_join(
    df: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` for every row.

    A class is what hangs together by links (Jaccard of the n-gram sets at least ``threshold``), named by
    its smallest id; ``n_links`` counts the other sets a document is linked with, ``n_copies`` the rows
    with its own set. Documents without a word have no n-grams: each is a class of its own. A row without
    an id has no class and no links. Rows that repeat an id are one node, so they share a class.
    """
    bands, rows = banding(threshold, recall)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    signed = materialize(signatures(known, size, bands, rows), "signatures")
    full = signed.where("grams > 0")
    nodes = materialize(
        full.groupBy("low", "high").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("n_copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    near = components(meetings(nodes))
    near = near.join(nodes.groupBy("node").agg(F.max("grams").alias("grams")), "node")
    blocks = near.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("long").alias("blocks")
    )
    grouped = near.join(blocks, "component").select("node", F.col("component").alias("group"), "blocks")
    members = known.join(grouped.hint("shuffle_hash"), known["doc_id"] == grouped["node"]).select("node", "group", "blocks", "text")
    members = members.dropDuplicates(["node", "text"])
    found = materialize(verified(members, size, threshold), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    answer = (
        nodes.select("low", "high", "node", "n_copies").join(links, "node", "left").join(classes, "node", "left")
        .select("low", "high", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("class_id"))
    )
    out = ["doc_id", "class_id", "n_links", "n_copies"]
    alone = signed.where("grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    unknown = docs.where(F.col("doc_id").isNull()).selectExpr("doc_id", "cast(null AS long) AS class_id", "0L AS n_links", "0L AS n_copies")
    return full.join(answer, ["low", "high"]).select(out).unionByName(alone).unionByName(unknown)
