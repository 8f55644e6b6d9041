"""Substring, line and near-copy dedup against SQL and brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dimsift.llm import arrow, debruijn, minhash_join, patience
from dimsift.llm.components import components
from dimsift.llm.queries import QUERIES, SQL

from ..conftest import DATA
from .conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", ["op1_debruijn_dedup", "op8_minhash_join"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    duck.execute(SQL[name])
    df = QUERIES[name](spark, DATA)
    assert df.columns == [d[0] for d in duck.description]
    assert sorted(map(tuple, df.collect())) == sorted(duck.fetchall())


@pytest.fixture(scope="module")
def made():
    """Copies, near copies, shared and overlapping passages, repeats within a text, one common line."""
    draw = random.Random(1)
    say = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    common, passage = say(14), say(60)
    rows = []
    for i in range(60):
        text = say(draw.randrange(0, 120))
        if i % 3 == 0:
            text += ["\n", *common, "\n"]
        if i % 7 == 0:
            cut = draw.randrange(0, 40)
            text += passage[cut : cut + draw.randrange(12, 30)] + say(5)
        if i % 11 == 0:
            text += passage * 2
        rows.append((i * 3, " ".join(text)))
    for i in range(10):
        base = rows[i * 5][1]
        rows.append((500 + i, base))
        edited = base.split(" ")
        if edited:
            edited[len(edited) // 2] = f"new{i}"
        rows.append((600 + i, " ".join(edited)))
    draw.shuffle(rows)
    return [*rows, *ODD, (900, "long " * 30_000), (901, " ".join(say(4000))), (901, " ".join(passage))]


def brute_substring(rows, size=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1000, 2])
def test_substring(frame, made, monkeypatch, least):
    """With ``least`` 2, edges of more than two documents take the way of the hot ones."""
    monkeypatch.setattr(debruijn, "HOT_LEAST", least)
    found = debruijn.dedup(frame(made), carry=["label"])
    assert found.columns == ["doc_id", "text", "label", "n_words", "n_removed"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found.collect()), key=str) == brute_substring(made)


def test_spans_are_paths_of_one_source(frame):
    text = " ".join(f"w{i}" for i in range(40))
    rows = frame([(1, text), (2, f"x y {text} z"), (3, f"{text} {text}")]).select("doc_id", "text")
    spans = {(r["doc_id"], r["start"]): (r["edges"], r["source"], r["source_start"]) for r in debruijn.repeated_spans(rows)[0].collect()}
    assert spans == {(2, 2): (28, 1, 0), (3, 0): (28, 1, 0), (3, 40): (28, 1, 0)}


def test_a_full_sieve_loses_nothing(frame, made, monkeypatch):
    from dimsift.llm import sieve

    monkeypatch.setattr(sieve.Sieve, "__init__", lambda self, keys: setattr(self, "bits", np.full(sieve.BITS // 64, ~np.uint64(0))))
    found = debruijn.dedup(frame(made))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found.collect()), key=str) == brute_substring(made)


def test_unsqueezed_texts_stay(spark, frame, made):
    rows = [(1, "a  b\n\tc"), (2, None)]
    assert sorted((r["doc_id"], r["text"]) for r in debruijn.dedup(frame(rows), squeeze=False).collect()) == [(1, "a  b\n\tc"), (2, "")]
    # batches with and without a change, in one task
    given = sorted(((i, t or "") for i, t in made), key=str)
    expected = sorted([(i, text) for i, _, gone, text in brute_substring(made) if gone], key=str)
    for rows_of_a_batch in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
        found = debruijn.dedup(frame(made).coalesce(1), squeeze=False).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in found if r["n_removed"]), key=str) == expected
        assert all((r["doc_id"], r["text"]) in given for r in found if not r["n_removed"])


def test_windows_that_meet_in_one_hash_only(spark):
    """Edge 5 stands for two windows; each has the smallest document of its own as source, and a lone one has none."""
    rows = [(5, 1, 30, 0), (5, 1, 10, 4), (5, 2, 20, 7), (5, 2, 40, 9), (5, 3, 50, 1), (6, 1, 5, 2)]
    df = spark.createDataFrame(rows, "edge long, twin int, doc_id long, place int")
    found = sorted((r["doc_id"], r["place"], r["source"], r["source_place"]) for r in debruijn.covered_in_order(df).collect())
    assert found == [(30, 0, 10, 4), (40, 9, 20, 7)]
    hot = debruijn.HotEdges(pa.table({"edge": [5, 9], "twin": [1, 2], "source": [10, 11], "place": [0, 1]}))
    assert hot.at(np.array([5, 5, 9, 7]), np.array([1, 2, 2, 1])).tolist() == [0, -1, 1, -1]


def test_a_sieve_grows_with_its_keys(spark, monkeypatch):
    from dimsift.llm import sieve

    monkeypatch.setattr(sieve, "BITS", 1 << 8)
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    held = sieve.Sieve(keys)
    assert len(held.bits) * 64 == 1 << 16
    inside = np.array([r[0] for r in keys.collect()], np.int64)
    others = np.array([r[0] for r in spark.range(5000, 10_000).select(F.xxhash64("id")).collect()], np.int64)
    assert held.passes(inside).all() and held.passes(others).mean() < 0.12
    monkeypatch.setattr(sieve, "MOST_BITS", 1 << 10)
    assert len(sieve.Sieve(keys).bits) * 64 == 1 << 10 and sieve.Sieve(keys).passes(inside).all()
    assert not sieve.Sieve(keys.where("false")).passes(inside).any()


def brute_lines(rows, least=8):
    """Every stretch of lines against those of the earlier documents; by ids, and rows that repeat an id are left out of the fixture."""
    lines = {i: [(k, tuple(words(x))) for k, x in enumerate((t or "").split("\n")) if words(x)] for i, t in rows if i is not None}
    gone, known = defaultdict(set), set()
    for i in sorted(lines):
        mine, here = lines[i], set()
        for a in range(len(mine)):
            run, count = [], 0
            for k, line in mine[a:]:
                run.append(line)
                count += len(line)
                if count >= least:
                    # a longer stretch is shared only if its beginnings are
                    here.add(tuple(run))
                    if tuple(run) in known:
                        gone[i].update(range(mine[a][0], k + 1))
        known |= here
    out = []
    for i, t in rows:
        some = (t or "").split("\n")
        out.append((i, len(some), len(gone[i]) if i is not None else 0, "\n".join(x for k, x in enumerate(some) if i is None or k not in gone[i])))
    return sorted(out, key=str)


def test_lines(frame):
    draw = random.Random(4)
    lines = [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(1, 14))) for _ in range(90)]
    rows = [(i, "\n".join(draw.choice([draw.choice(lines), "", " ", f"own {i} {k} one two three four five"]) for k in range(draw.randrange(0, 14)))) for i in range(80)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (None, rows[3][1]), (204, "\n" * 5000)]
    found = patience.dedup(frame(rows), carry=["label"])
    assert found.columns == ["doc_id", "text", "label", "n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found.collect()), key=str)
    assert got == brute_lines(rows) and any(r[2] for r in got)


def test_lines_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    expected = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute_lines(rows)]
    assert sorted(map(tuple, QUERIES["op6_patience_line_dedup"](spark, DATA).collect()), key=str) == expected


def test_align():
    assert patience.align(list("abcde"), list("xabyde")) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert patience.align(list("ab"), list("ba")) in ([(0, 1)], [(1, 0)])
    assert patience.align([], list("a")) == [] and patience.align(list("aa"), list("aaa")) == [(0, 0), (1, 1)]
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.randrange(8) for _ in range(draw.randrange(12))] for _ in range(2))
        found = patience.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def brute_jaccard(rows, size=5, threshold=0.8):
    sets, by_row = {}, []
    for i, text in rows:
        w = words(text)
        grams = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())
        by_row.append((i, grams))
        if i is not None and grams:
            sets.setdefault(grams, []).append(i)
    node = {g: min(ids) for g, ids in sets.items()}
    links, parent = Counter(), {n: n for n in node.values()}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(sets, 2):
        both = len(a & b)
        if both >= threshold * (len(a) + len(b) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(node[a]), root(node[b])))
            parent[y] = x
    out = []
    for i, g in by_row:
        if i is None:
            out.append((None, None, 0, 0))
        elif not g:
            out.append((i, i, 0, 1))
        else:
            out.append((i, root(node[g]), links[g], len(sets[g])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard(frame, made, monkeypatch, block):
    """With blocks of 3 documents, groups are compared in several parts."""
    monkeypatch.setattr(minhash_join, "BLOCK_DOCS", block)
    rows = [r for r in made if r[0] != 901]
    base = [f"v{i}" for i in range(120)]
    draw = random.Random(5)
    for i in range(40):
        text = list(base)
        for _ in range(draw.randrange(4)):
            text[draw.randrange(120)] = f"e{draw.randrange(9)}"
        rows.append((1000 + i, " ".join(text)))
    found = sorted(map(tuple, minhash_join.jaccard_join(frame(rows)).collect()), key=str)
    assert found == brute_jaccard(rows)


def test_rows_that_repeat_an_id_are_one_node(frame):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "other words here that differ much")]
    got = sorted(map(tuple, minhash_join.jaccard_join(frame(rows)).collect()))
    assert [r[:2] for r in got] == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = minhash_join.banding(threshold, 0.999)
        assert bands * rows <= minhash_join.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components(spark):
    draw = random.Random(6)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2050)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    loops = {n for n in parent if all(a == b for a, b in pairs if n in (a, b))}
    df = spark.createDataFrame(pairs, "a long, b long")
    assert dict(map(tuple, components(df).collect())) == {n: root(n) for n in parent if n not in loops}
    assert components(df.where("a < 0")).collect() == []


@pytest.mark.parametrize("op", [debruijn.dedup, patience.dedup, minhash_join.jaccard_join])
def test_empty_tables(frame, op):
    assert op(frame([])).collect() == []
    assert len(op(frame(ODD)).collect()) == len(ODD)


def test_words_of_arrow_batches():
    texts = ["a b", None, "", " \t", "é\x0bÜ  z", "x" * 100]
    w = arrow.Words(pa.array(["skipped", *texts]).slice(1))
    assert [w.joined(i).decode() for i in range(len(texts))] == [" ".join(words(t)) for t in texts]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    wide = arrow.Words(pa.array(texts, pa.large_string()))
    assert wide.counts.tolist() == w.counts.tolist() and (wide.hashes() == w.hashes()).all()
    same = arrow.Words(pa.array(["a b a", "b a"]))
    h = same.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    two, at = same.windows(2)
    assert at.tolist() == [0, 1, 3] and two[1] == two[2] != two[0]


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(arrow, "CHUNK_BYTES", 10)
    batch = pa.record_batch({"t": ["abc", "d" * 50, None, "efgh", "ijk", "lmn", "o"]})
    parts = list(arrow.text_chunks(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and [p.num_rows for p in parts] == [1, 1, 4, 1]
    assert list(arrow.text_chunks(batch.slice(0, 0))) == []


def test_steps_of_substring_dedup_hold_little(spark):
    """A step sees a quarter of what others do, and the same words go however texts are cut into steps."""
    words = "a b c d e f g h i j k l m n o p".split()
    rows = [(i, " ".join(words[i % 3 :] + [f"own{i}"] * 20)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batch = pa.record_batch({"text": ["x" * 100_000] * 20})
    assert [p.num_rows for p in arrow.text_chunks(batch, debruijn.CHUNK_BYTES)] == [2] * 10
    found = {r["doc_id"]: (r["n_removed"], r["text"]) for r in debruijn.dedup(docs).collect()}
    assert len(found) == 60 and found[0][0] == 0 and all(found[i][0] >= 13 for i in range(1, 60))


def removed_lines(frame, rows):
    return {r["doc_id"]: (r["n_removed"], r["text"]) for r in patience.dedup(frame(rows)).collect()}


def test_runs_of_frequent_lines_find_every_partner(frame):
    """The first holder of two frequent lines has neither their neighbours nor, for the second, one place for it."""
    common, double = "one two three four five six", "a b c d e f g h i"
    rows = [(0, f"{common}\nalone here\n{double}\nzero\n{double}")]
    rows += [(i, f"own {i}\n{common}\nsome {i}\n{double}\nend {i}") for i in range(1, 8)]
    rows += [(20, f"left 20\n{common}\nnext line\nlast 20"), (21, f"right 21\n{common}\nnext line\nmore 21")]
    got = removed_lines(frame, rows)
    assert got[21] == (2, "right 21\nmore 21") and got[7] == (1, f"own 7\n{common}\nsome 7\nend 7") and got[20][0] == 0
    assert sorted((i, *x) for i, x in got.items()) == [(i, gone, text) for i, _, gone, text in sorted(brute_lines(rows))]


@pytest.mark.parametrize("seed", [8, 9])
def test_lines_of_few_values(frame, seed):
    """Runs that many documents hold, often twice or in another order, against every stretch of every earlier document."""
    draw = random.Random(seed)
    lines = [" ".join(f"w{k}{j}" for j in range(draw.randrange(1, 11))) for k in range(9)]
    rows = [(i, "\n".join(draw.choice([*lines, *lines, "", f"own {i} {k}"]) for k in range(draw.randrange(0, 9)))) for i in range(150)]
    got = sorted((i, *x) for i, x in removed_lines(frame, rows).items())
    assert got == [(i, gone, text) for i, _, gone, text in sorted(brute_lines(rows))] and sum(r[1] for r in got) > 100


def test_copies_with_short_lines(frame):
    """No line has more than four words."""
    verse = "\n".join(f"line {k} of verse" for k in range(6))
    rows = [(1, f"first title\n{verse}"), (2, f"second title\n{verse}\nend"), (3, "one\nword\nonly"), (4, "one\nword\nonly")]
    got = removed_lines(frame, rows)
    assert got == {1: (0, rows[0][1]), 2: (6, "second title\nend"), 3: (0, rows[2][1]), 4: (0, rows[3][1])}


def test_moved_and_repeated_runs(frame):
    """Patience diff keeps one order of lines that are unique on both sides; the others are anchors of their own."""
    a, b, c = ("\n".join(f"{x} {k} some words here" for k in range(3)) for x in "abc")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\nown line\n\n{a}\n{b}"), (3, f"{b}\n{b}\nmine\n{b}"), (4, "x one\nx two\n" * 40)]
    rows += [(5, "x one\nx two\n" * 60), (6, f"before\n\n{a}\n\n \n{a.splitlines()[1]}\nlast")]
    got = removed_lines(frame, rows)
    assert got[2][1] == "own line\n" and got[3][1] == "mine" and got[5][1] == "" and got[6][1].split("\n")[0] == "before"
    assert sorted((i, *x) for i, x in got.items()) == [(i, gone, text) for i, _, gone, text in sorted(brute_lines(rows))]


def test_aligned_rows_grow_with_the_rows(spark, frame):
    """Many rows of two ids with the same lines, and many documents with runs in orders of their own."""
    text = "\n".join(f"line {k} of this text" for k in range(6))
    made = []

    def rows_of(rows):
        docs = frame(rows).select("doc_id", "text")
        table = patience.line_table(docs)
        found = patience.shared_runs(table, 8)
        pairs = found.select(*patience.PAIR).distinct()
        gone = patience.blocks(table, pairs)
        left = patience.left_runs(table, found, gone, 8)
        return pairs.count(), left.count(), patience.anchored(table, left, 8).count()

    assert rows_of([(1, text)] * 50 + [(2, text)] * 50)[0] == 1
    assert {tuple(r) for r in patience.dedup(frame([(1, text)] * 30 + [(2, text)] * 30)).select("doc_id", "n_removed").collect()} == {(1, 0), (2, 6)}
    blocks = [f"{x} one two three four\n{x} five six seven eight" for x in "abcdefgh"]
    draw = random.Random(1)
    for n in (40, 80):
        made.append(rows_of([(i, "\n".join([*draw.sample(blocks, 8), f"own {i}"])) for i in range(n)]))
    assert all(b <= 2.5 * a for a, b in zip(*made)) and made[1][1] > 0


def test_rows_of_one_id_with_different_lines(frame):
    one, two = ("\n".join(f"{x} {k} words of a line" for k in range(4)) for x in "xy")
    rows = [(1, one), (1, two), (1, f"{one}\n{two}"), (2, two), (2, one), (2, "own words")]
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in patience.dedup(frame(rows)).collect())
    assert got == sorted([(1, 0, one), (1, 0, two), (1, 0, f"{one}\n{two}"), (2, 4, ""), (2, 4, ""), (2, 0, "own words")])
