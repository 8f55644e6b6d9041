"""The divergence audit against sums over all terms of every pair."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from dimsift.llm import divergence
from dimsift.llm.queries import QUERIES, SQL

from ..conftest import DATA
from ..test_registered import canonical

SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plainly(rows, min_docs=3, top=200):
    """The audit with Python's whole numbers, term by term."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        mine = [(s, t) for x, s, t in docs if x == lang]
        spread = Counter(w for _, t in mine for w in set(t))
        kept = [w for w, n in spread.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in mine}
        for s, t in mine:
            counts[s].update(w for w in t if spread[w] >= min_docs)

        def shares(c):
            size = sum(c.values()) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // size for w in kept}

        whole = shares(sum(counts.values(), Counter()))
        by = {s: shares(c) for s, c in counts.items()}
        for s in by:
            pairs = [(o, sum((by[s][w] - by[o][w]) ** 2 // by[o][w] for w in kept)) for o in by if o != s]
            terms = [(w, (by[s][w] - whole[w]) ** 2 // whole[w]) for w in kept if counts[s][w] and by[s][w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS count", "'x' AS item", "3 AS size", "4 AS docs")
    assert sorted(map(tuple, divergence.audit(df, **how).collect())) == plainly(rows, **how)


def made(seed, docs, words, sources):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('aÉéZ漢')}{rng.choice('bcdXü')}{rng.choice('efg')}"[: rng.randint(1, 3)] for _ in range(words)]
    return [
        (i, rng.choice(" .\n0_").join(rng.choices(vocabulary, range(words, 0, -1), k=rng.randint(0, 60))), rng.choice(("en", "de", None)), f"s{int(sources * rng.random() ** 3)}")
        for i in range(docs)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_made_tables(spark, seed):
    check(spark, made(seed, 120, 90, 9))
    check(spark, made(seed + 5, 60, 40, 30), min_docs=1, top=3)


def test_trees_that_are_begun_anew(spark, monkeypatch):
    rows = made(9, 150, 120, 12)
    monkeypatch.setattr(divergence, "TREE_NODES", 7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plainly(rows)


def test_odd_rows(spark):
    check(spark, [
        (1, None, None, None), (2, "", "", ""), (3, "only once", "en", "a"), (3, "only once", "en", "a"), (3, "only once", "en", "a"),
        (4, " \x00\t 123 ", "en", "no terms"), (5, "Straße STRASSE strasse", "de", "b"), (6, "x", "xx", "lonely"), (None, "ONLY Only only " * 20_000, "en", "c"),
    ])
    check(spark, [])


def test_equal_terms_rank_by_bytes(spark):
    check(spark, [(i, "zebra Äpfel éa ea zz", "en", f"s{i % 4 // 3}") for i in range(8)] + [(i, "ea rest", "en", "s2") for i in range(5)])


def test_shared_paths_are_one_node():
    tree = divergence.PatternTree()
    for sources, counts, times in (([0, 1, 2], [5, 2, 1], 3), ([0, 1], [5, 2], 4), ([0, 1, 3], [5, 2, 1], 1), ([1, 2], [2, 1], 2)):
        tree.insert(sources, counts, times)
    assert len(tree) == 6 and tree.times == [8, 8, 3, 1, 2, 2]


def test_shares_of_large_counts(spark):
    import numpy as np

    for count, size in ((0, 1), (0, 7), (8 * 10**15, 9 * 10**15), (10**13 - 1, 10**13), (123456789, 987654321987)):
        expected = 1 + 10**9 * (count + 1) // size
        assert divergence.shares(np.array([count]), np.array([size]))[0] == expected
        assert spark.range(1).selectExpr(f"{count}L AS c", f"{size}L AS s").selectExpr(divergence.share("c", "s")).first()[0] == expected


def test_counts_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "source": ["a", "a", "a"], "text": ["B b c", "b", ""]})
    rows = sorted(divergence.count_terms(batch).to_pylist(), key=repr)
    assert [tuple(r.values()) for r in rows] == [("de", "a", None, 0, 0), ("en", "a", "b", 3, 2), ("en", "a", "c", 1, 1), ("en", "a", None, 0, 0)]


def test_query(spark, duck):
    df = QUERIES["op12_source_divergence"](spark, DATA)
    duck.execute(SQL["op12_source_divergence"])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(duck.fetchall(), names)
