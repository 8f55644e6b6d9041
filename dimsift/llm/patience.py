"""Line dedup by pairwise alignment of documents that share a run of lines.

A line is known by the hash of its words, a run by those of consecutive lines, empty ones aside. Of every run
with enough words to be deleted, each document that has it is held against one earlier document that does, if
it can be one that has it once. The two are aligned with patience diff: lines that are unique on both sides are
matched in their longest common order, then the gaps between matches in the same way. Aligned lines that
follow one another on both sides are a block; blocks of enough words are deleted from the later document, which
is the one with the larger id.

Patience diff keeps one order, so it leaves out a run that was moved, or that a text repeats. Such a run is then an
anchor of its own: it is found in the same earlier document, compared line by line, and carried on both ways as
far as the two agree. So what goes in the end are the lines of every run of enough words that an earlier document
has, too, and the empty lines within.

A document meets as many others as it has runs, at most, so work grows with the lines. Pairs carry hashes of lines
only. All are judged on the documents as given. A document is told from others with its id by a hash of all
its lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .sieve import Sieve

BLOCK_WORDS = 8  # words of a block that is deleted

IDENTITY = ["doc_id", "print"]
PAIR = [*IDENTITY, "from_id", "from_print"]
BLOCKS = "doc_id long, print long, start int, lines int"


def lines_of(column: pa.Array) -> tuple[arrow.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts; hash, words, text, and byte span of each line (an empty line has hash 0)."""
    words = arrow.Words(column)
    feeds = np.flatnonzero(words.data == 0x0A)
    # a line begins with a text and behind every line feed
    n = len(column)
    text = np.concatenate((np.arange(n), np.searchsorted(words.bounds, feeds, side="right") - 1))
    start = np.concatenate((words.bounds[:-1], feeds + 1))
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    end = np.empty(len(start), np.int64)
    end[:-1] = np.where(text[1:] == text[:-1], start[1:] - 1, words.bounds[text[:-1] + 1])
    end[-1:] = words.bounds[-1]
    first, last = np.searchsorted(words.starts, start), np.searchsorted(words.starts, end)
    keys = arrow.sequence_hashes(words.hashes(), first, last)
    keys[first == last] = 0
    return words, keys, last - first, text, start, end


def prints(keys: np.ndarray, at: np.ndarray) -> pa.Array:
    """One hash of all lines of each text."""
    return pa.array(arrow.signed(arrow.sequence_hashes(keys, at[:-1], at[1:])))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, print, keys, words``: hash and number of words of every line, as arrays of bytes (8 and 4 per line).

    Rows with the same id and the same lines are one.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, keys, count, text, _, _ = lines_of(batch["text"])
        at = np.searchsorted(text, np.arange(batch.num_rows + 1))
        count = count.astype(np.int32)
        rows = [(keys[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], prints(keys, at), pa.array([k for k, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())],
            ["doc_id", "print", "keys", "words"],
        )

    return arrow.map_batches(docs, step, "doc_id long, print long, keys binary, words binary").dropDuplicates(IDENTITY)


def runs_of(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first line and end of runs of lines with words, of rows of ``line_table``.

    For every line the shortest run of ``least`` words that begins with it, and the shortest that ends
    with it; and two neighbours that both have so many. Every longer run, with the empty lines in it, is
    made of these, and documents that share a longer one share these.
    """
    data, bounds = arrow.text_bytes(batch["keys"])
    keys, bounds = np.frombuffer(data.tobytes(), np.uint64), bounds // 8
    words = np.frombuffer(arrow.text_bytes(batch["words"])[0].tobytes(), np.int32)
    full = np.flatnonzero(keys)
    row = np.searchsorted(bounds, full, side="right") - 1
    total = np.concatenate(([0], np.cumsum(words[full], dtype=np.int64)))
    begin, end = np.searchsorted(row, row, side="left"), np.searchsorted(row, row, side="right")
    at = np.arange(len(full))
    onward = np.searchsorted(total, total[:-1] + least)
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    long = words[full] >= least
    two = np.flatnonzero(long[:-1] & long[1:] & (row[:-1] == row[1:]))
    lo = np.concatenate((at[onward <= end], back[back >= begin], two))
    hi = np.concatenate((onward[onward <= end], at[back >= begin] + 1, two + 2))
    lo, hi = np.unique(np.stack((lo, hi)), axis=1) if len(lo) else (lo, hi)
    return arrow.sequence_hashes(keys[full], lo, hi), row[lo], full[lo] - bounds[row[lo]], full[hi - 1] + 1 - bounds[row[lo]]


def holders(table: DataFrame, least: int) -> DataFrame:
    """``key, doc_id, print, once``: which documents have a run of lines, and if it is there once."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, row, _, _ = runs_of(batch, least)
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))[: len(keys)])
        once = np.diff(np.append(first, len(keys))) == 1
        of = pa.array(row[first])
        return pa.RecordBatch.from_arrays(
            [pa.array(arrow.signed(keys[first])), batch["doc_id"].take(of), batch["print"].take(of), pa.array(once)], ["key", "doc_id", "print", "once"]
        )

    return arrow.map_batches(table, step, "key long, doc_id long, print long, once boolean")


def shared_runs(table: DataFrame, least: int) -> DataFrame:
    """``key, doc_id, print, from_id, from_print``: runs that an earlier document has, too, one that has it once if there is one."""
    rows, which = holders(table, least), F.struct(*IDENTITY)
    shared = rows.groupBy("key").agg(F.min(which).alias("_first"), F.max("doc_id").alias("_last"), F.min(F.when(F.col("once"), which)).alias("_once"))
    # stored, so that Spark may split the rows of a run that very many documents have
    shared = materialize(shared.where("_first.doc_id < _last"), "runs")
    earlier = F.when(F.col("_once.doc_id") < F.col("doc_id"), F.col("_once")).when(F.col("_first.doc_id") < F.col("doc_id"), F.col("_first"))
    found = rows.drop("once").join(shared, "key").select("key", *IDENTITY, earlier.alias("_from")).where("_from IS NOT NULL")
    return found.select("key", *IDENTITY, F.col("_from.doc_id").alias("from_id"), F.col("_from.print").alias("from_print"))


def side_by_side(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of documents with the lines of both, dealt out over all tasks, since there is more work in them than bytes."""
    earlier = table.toDF("from_id", "from_print", "from_keys", "from_words")
    both = pairs.join(table, IDENTITY).join(earlier, ["from_id", "from_print"])
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, *IDENTITY, "from_id", "from_print")


def left_runs(table: DataFrame, found: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """``doc_id, print, from_id, from_print, runs``: places of runs that are still in a document after the blocks ``gone``."""
    runs = found.groupBy(*IDENTITY).agg(F.sort_array(F.collect_list(F.struct("key", "from_id", "from_print"))).alias("_runs"))
    by_doc = gone.groupBy(*IDENTITY).agg(F.collect_list(F.struct("start", "lines")).alias("_blocks"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        run, row, first, end = runs_of(batch, least)
        run, bounds = arrow.signed(run), arrow.text_bytes(batch["keys"])[1] // 8
        keep = np.ones(bounds[-1], bool)
        for i, some in enumerate(batch["_blocks"].to_pylist()):
            for b in some or ():
                keep[bounds[i] + b["start"] : bounds[i] + b["start"] + b["lines"]] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        order = np.argsort(row, kind="stable")
        of = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
        known, many = batch["_runs"].flatten(), batch["_runs"].value_lengths().to_numpy()
        known_keys, begin = known.field("key").to_numpy(), np.cumsum(many) - many
        chosen, source = [], []
        for i in range(batch.num_rows):
            mine = order[of[i] : of[i + 1]]
            keys = known_keys[begin[i] : begin[i] + many[i]]
            at = np.minimum(np.searchsorted(keys, run[mine]), len(keys) - 1)
            left = (keys[at] == run[mine]) & (kept[bounds[i] + end[mine]] > kept[bounds[i] + first[mine]])
            chosen.append(mine[left])
            source.append(begin[i] + at[left])
        chosen, source = np.concatenate(chosen), pa.array(np.concatenate(source))
        of = pa.array(row[chosen])
        columns = [batch["doc_id"].take(of), batch["print"].take(of), known.field("from_id").take(source), known.field("from_print").take(source)]
        columns += [pa.array(run[chosen]), pa.array(first[chosen].astype(np.int32)), pa.array(end[chosen].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*PAIR, "key", "start", "end"])

    rows = table.join(runs, IDENTITY).join(by_doc, IDENTITY, "left")
    places = arrow.map_batches(rows, step, "doc_id long, print long, from_id long, from_print long, key long, start int, end int")
    return places.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("start", "end", "key"))).alias("runs"))


def anchored(table: DataFrame, left: DataFrame, least: int) -> DataFrame:
    """``doc_id, print, start, lines``: blocks around runs that stand in another place, or order, than in the earlier document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        theirs = pa.RecordBatch.from_arrays([batch["from_keys"], batch["from_words"]], ["keys", "words"])
        run, row, first, _ = runs_of(theirs, least)
        run = arrow.signed(run)
        order = np.lexsort((run, row))
        of = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
        out = []
        for i, places in enumerate(batch["runs"].to_pylist()):
            mine, other = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("keys", "from_keys"))
            known = order[of[i] : of[i + 1]]
            at = np.searchsorted(run[known], [p["key"] for p in places])
            covered = np.zeros(len(mine), bool)
            for p, k in zip(places, at):
                if covered[p["start"] : p["end"]].all() or k == len(known) or run[known[k]] != p["key"]:
                    continue
                start, end = grown(mine, other, p["start"], p["end"], int(first[known[k]]))
                if end > start:
                    covered[start:end] = True
                    out.append((i, start, end - start))
        return found_blocks(batch, out)

    return arrow.map_batches(side_by_side(table, left), step, BLOCKS)


def grown(mine: np.ndarray, theirs: np.ndarray, start: int, end: int, there: int) -> tuple[int, int]:
    """The lines ``start`` to ``end``, which are also ``there``, and equal ones before and behind; none if they differ."""
    places = np.flatnonzero(mine)
    a, other = mine[places], theirs[theirs != 0]
    lo, hi = np.searchsorted(places, (start, end))
    low = int(np.count_nonzero(theirs[:there]))
    high = low + hi - lo
    if high > len(other) or (a[lo:hi] != other[low:high]).any():
        return start, start
    before = equal_run(a[:lo][::-1], other[:low][::-1])
    behind = equal_run(a[hi:], other[high:])
    return int(places[lo - before]), int(places[hi - 1 + behind]) + 1


def equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """In how many places both begin alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def common_order(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matches of the values unique in both lists, in their longest common order."""
    in_a, in_b = Counter(a), Counter(b)
    place = {v: j for j, v in enumerate(b) if in_b[v] == 1}
    pairs = [(i, place[v]) for i, v in enumerate(a) if in_a[v] == 1 and v in place]
    tails: list[int] = []
    ends: list[int] = []  # which pair ends the best run of each length
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two lists of line hashes by patience diff, ascending on both sides."""
    matches = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            matches.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            matches.append((hi, high))
        if lo == hi or low == high:
            continue
        anchors = common_order(a[lo:hi], b[low:high])
        at, other = lo, low
        for i, j in anchors:
            todo.append((at, lo + i, other, low + j))
            matches.append((lo + i, low + j))
            at, other = lo + i + 1, low + j + 1
        if anchors:
            todo.append((at, hi, other, high))
    return sorted(matches)


def blocks_of(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``(start, lines)`` of the later document's blocks; empty lines neither match nor part a block."""
    mine, theirs = np.flatnonzero(later), np.flatnonzero(earlier)
    # only lines of both sides can match; numbers of others would only lengthen the lists
    mine = mine[np.isin(later[mine], earlier)]
    matches = align(later[mine].tolist(), earlier[theirs].tolist())
    if not matches:
        return []
    rank = np.cumsum(later != 0)  # places among the lines with words
    at, other = (np.array(x) for x in zip(*matches))
    place = mine[at]
    new = np.ones(len(at), bool)
    new[1:] = (rank[place[1:]] != rank[place[:-1]] + 1) | (other[1:] != other[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    total = np.add.reduceat(words[place], first)
    return [(int(place[f]), int(place[e] - place[f] + 1)) for f, e, t in zip(first, last, total) if t >= least]


def found_blocks(batch: pa.RecordBatch, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """``doc_id, print, start, lines`` of blocks given by row, first line and number of lines."""
    row, start, lines = zip(*found) if found else ((), (), ())
    of = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(of), batch["print"].take(of), pa.array(start, pa.int32()), pa.array(lines, pa.int32())], ["doc_id", "print", "start", "lines"]
    )


def blocks(table: DataFrame, pairs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, print, start, lines``: aligned blocks of the later documents."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, (mine, count, theirs) in enumerate(zip(*(batch[c] for c in ("keys", "words", "from_keys")))):
            keys, other = (np.frombuffer(x.as_buffer(), np.int64) for x in (mine, theirs))
            out += [(i, start, n) for start, n in blocks_of(keys, other, np.frombuffer(count.as_buffer(), np.int32), least)]
        return found_blocks(batch, out)

    return arrow.map_batches(side_by_side(table, pairs), step, BLOCKS)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines, n_removed`` and ``text`` without the blocks.

    Only documents that may have a block are shuffled; other columns of ``docs`` go with them.
    """
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(found.select(F.xxhash64("doc_id").alias("key"))))
    inner = docs.schema.simpleString()[len("struct<") : -1]
    kind = f"{inner},n_lines:bigint,n_removed:bigint"
    marked = docs.withColumn("_key", F.xxhash64("doc_id"))

    def chosen(batch: pa.RecordBatch, yes: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(sieve.value.passes(batch["_key"].to_numpy()) == yes)).drop_columns(["_key"])

    def untouched(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = chosen(batch, False)
        lines = pc.add(pc.count_substring(batch["text"], "\n"), 1).cast(pa.int64())
        return batch.append_column("n_lines", lines).append_column("n_removed", pa.array(np.zeros(batch.num_rows, np.int64)))

    def told_apart(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = chosen(batch, True)
        _, keys, _, text, _, _ = lines_of(batch["text"])
        return batch.append_column("_print", prints(keys, np.searchsorted(text, np.arange(batch.num_rows + 1))))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, keys, _, text, start, end = lines_of(batch["text"])
        keep = np.ones(len(keys), bool)
        at = np.searchsorted(text, np.arange(batch.num_rows + 1))
        for i, some in enumerate(batch["_blocks"].to_pylist()):
            for b in some or ():
                keep[at[i] + b["start"] : at[i] + b["start"] + b["lines"]] = False
        removed = np.bincount(text[~keep], minlength=batch.num_rows)
        texts = []
        for i in range(batch.num_rows):
            rows = at[i] + np.flatnonzero(keep[at[i] : at[i + 1]])
            texts.append(arrow.join_spans(words.data, start[rows], end[rows], glue=0x0A).decode())
        batch = batch.drop_columns(["_blocks"])
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return batch.append_column("n_lines", pa.array(np.diff(at).astype(np.int64))).append_column("n_removed", pa.array(removed.astype(np.int64)))

    by_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_list(F.struct("start", "lines")).alias("_blocks"))
    some = arrow.map_batches(marked, told_apart, f"{inner},_print:bigint")
    same = (some["doc_id"] == by_doc["_id"]) & (some["_print"] == by_doc["_print"])
    some = some.join(by_doc.hint("shuffle_hash"), same, "left").select(*docs.columns, "_blocks")
    return arrow.map_batches(marked, untouched, kind).unionByName(arrow.map_batches(some, cut, kind))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` for every row, without the lines of runs that an earlier document has.

    Lines end at a line feed; what is left is joined by line feeds again, a document without a block
    stays as it is. A null text counts as one empty line. Rows without an id stay whole and are no
    partner of others; rows that repeat an id are never held against each other. An empty table gives
    no rows. Texts are taken whole. Columns named in ``carry`` come along.
    """
    docs = df.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(carry or [])
    )
    table = materialize(line_table(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")), "lines")
    found = materialize(shared_runs(table, least), "shared-runs")
    gone = materialize(blocks(table, found.select(*PAIR).distinct(), least), "blocks")
    more = materialize(anchored(table, materialize(left_runs(table, found, gone, least), "left-runs"), least), "more-blocks")
    return remove(docs, gone.unionByName(more))
