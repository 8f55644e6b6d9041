"""Fill-in-middle against a plain version, and back."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dimsift.llm import fim
from dimsift.llm.queries import QUERIES, SQL

from ..conftest import DATA
from ..test_registered import canonical
from .conftest import ODD

PARTS = ("a", "Zq", " ", "\n", "<", ">", "P", "<P>", "<S", "<M>", "é", "漢", "🙂", "\x00", "\x7f", "é", "@[`{", "ÿ")
TEXTS = st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=20)
NUMBERS = st.tuples(*[st.integers(0, (1 << 32) - 1)] * 4)


def plainly(text, h, scheme):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in scheme.markers) or h[2] % 100 >= scheme.rearranged:
        return n, "plain", None, None, text
    if h[3] % 100 < scheme.suffix_first:
        return n, "spm", len(p), len(m), f"{scheme.suffix}{s}{scheme.prefix}{p}{scheme.middle}{m}"
    return n, "psm", len(p), len(m), f"{scheme.prefix}{p}{scheme.suffix}{s}{scheme.middle}{m}"


def numbers_of(doc_id, seed):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


@settings(max_examples=500, deadline=None)
@given(rows=st.lists(st.tuples(TEXTS, NUMBERS), min_size=1, max_size=6))
@pytest.mark.parametrize("scheme", [fim.Scheme(), fim.Scheme("<pre>", "<suf>", "<mid>", 100, 50, 7)])
def test_batches(rows, scheme):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array([t for t, _ in rows], pa.string()), *(pa.array([h[i] for _, h in rows], pa.int64()) for i in range(4))],
        ["doc_id", "text", "_h1", "_h2", "_h3", "_h4"],
    )
    out = fim.rearrange(batch, scheme)
    assert [tuple(r.values())[1:] for r in out.to_pylist()] == [plainly(t, h, scheme) for t, h in rows]
    assert fim.rebuild(out["output"].cast(fim.BYTES), out["form"], scheme).cast(pa.large_binary()).to_pylist() == [t.encode() for t, _ in rows]


def test_odd_rows(frame):
    scheme = fim.Scheme(seed=3)
    rows = [*ODD, (7, "one two  three " * 20_000), (8, "a <M> b")]
    found = fim.restore(fim.transform(frame(rows), scheme), scheme).collect()
    expected = [(d, *plainly(t or "", numbers_of(d, 3), scheme), t or "") for d, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_an_empty_table(frame):
    assert fim.restore(fim.transform(frame([]))).collect() == []


def test_markers():
    for markers in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Scheme(*markers)


def test_a_damaged_text():
    with pytest.raises(ValueError):
        fim.rebuild(pa.array([b"<P>a<S>b"], fim.BYTES), pa.array(["psm"]), fim.Scheme())
    with pytest.raises(ValueError):
        fim.rebuild(pa.array([b"x<P>a<S>b<M>c"], fim.BYTES), pa.array(["psm"]), fim.Scheme())


def test_query(spark, duck):
    df = QUERIES["op13_fill_in_middle"](spark, DATA)
    duck.execute(SQL["op13_fill_in_middle"])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(df.columns) and {"plain", "psm", "spm"} == {r.form for r in df.collect()}
    assert canonical(df.collect(), df.columns) == canonical(duck.fetchall(), names)
