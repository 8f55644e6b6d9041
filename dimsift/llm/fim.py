"""Fill-in-middle transformation: documents cut at two places into prefix, middle and suffix, and put in a new order.

The places are counted in units: a longest run of ASCII letters, or any other single character. All steps
are ``pyarrow.compute`` calls over whole batches: a mark that no UTF-8 text holds is put behind every unit
and the texts are split at it into lists of units; the lists are flattened with the indices of their
parents; a unit's ordinal is its place less the place of its parent's first unit; units are filtered by the
part their ordinal is in, gathered into lists again, and the lists joined.

Numbers come from the SHA-256 of the seed and the key, so a document is cut alike on every run and machine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow

# a unit, on the bytes of UTF-8: letters, another single byte, or a character of several bytes
UNIT = r"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*|[\x80-\xbf]"
MARK = b"\xff"  # in no UTF-8 text
FORMS = ("plain", "psm", "spm")
BYTES = pa.large_binary()


@dataclass(frozen=True)
class Scheme:
    """Markers, and which documents are rearranged in which way; both shares are of a hundred."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rearranged: int = 90
    suffix_first: int = 20
    seed: int = 1

    def __post_init__(self):
        markers = {self.prefix, self.suffix, self.middle}
        # a text without markers must not make one where it meets a marker
        if len(markers) < 3 or not all(re.fullmatch("<[^<>]+>", m) for m in markers):
            raise ValueError("markers are three different strings of the kind <...>")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def numbers(key: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hex digits of the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def remainder(values: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(values, pc.multiply(pc.divide(values, by), by))


def glued(*parts: pa.Array | str) -> pa.Array:
    values = [pa.scalar(p.encode(), BYTES) if isinstance(p, str) else p for p in parts]
    return pc.binary_join_element_wise(*values, pa.scalar(b"", BYTES))


def units_of(text: pa.Array) -> pa.ListArray:
    """The units of every text, and an empty value behind the last."""
    return pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=b"\\0" + MARK), pattern=MARK)


def part(flat: pa.Array, chosen: pa.Array, lengths: pa.Array) -> pa.Array:
    """The chosen units in lists of the given lengths, each joined to one value."""
    zero = pa.array([0], pa.int64())
    bounds = pa.concat_arrays([zero, pc.cumulative_sum(lengths).cast(pa.int64())])
    return pc.binary_join(pa.LargeListArray.from_arrays(bounds, pc.filter(flat, chosen)), pa.scalar(b"", BYTES))


def rearrange(batch: pa.RecordBatch, scheme: Scheme) -> pa.RecordBatch:
    text = pc.fill_null(batch["text"].cast(BYTES), b"")
    units = units_of(text)
    flat, parents = pc.list_flatten(units), pc.list_parent_indices(units)
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)
    first = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parents))
    one, two = (remainder(batch[h], pc.add(n, 1)) for h in ("_h1", "_h2"))
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    after_low = pc.greater_equal(ordinal, pc.take(low, parents))
    after_high = pc.greater_equal(ordinal, pc.take(high, parents))
    inside = pc.less(ordinal, pc.take(n, parents))
    prefix = part(flat, pc.invert(after_low), low)
    middle = part(flat, pc.and_not(after_low, after_high), pc.subtract(high, low))
    suffix = part(flat, pc.and_(after_high, inside), pc.subtract(n, high))

    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(remainder(batch["_h3"], 100), scheme.rearranged))
    for marker in scheme.markers:
        plain = pc.or_(plain, pc.match_substring(text, marker))
    form = pc.if_else(plain, 0, pc.if_else(pc.less(remainder(batch["_h4"], 100), scheme.suffix_first), 2, 1))
    psm = glued(scheme.prefix, prefix, scheme.suffix, suffix, scheme.middle, middle)
    spm = glued(scheme.suffix, suffix, scheme.prefix, prefix, scheme.middle, middle)
    lengths = [
        pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)
    ]
    out = pc.choose(form, text, psm, spm).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], n, pc.take(pa.array(FORMS), form), *lengths, out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    )


def halves(values: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    """What is before and behind the first marker."""
    both = pc.split_pattern(values, pattern=marker, max_splits=1)
    if pc.any(pc.not_equal(pc.list_value_length(both), 2)).as_py():
        raise ValueError(f"a text without {marker}")
    return pc.list_element(both, 0), pc.list_element(both, 1)


def rebuild(output: pa.Array, form: pa.Array, scheme: Scheme) -> pa.Array:
    """The texts that ``rearrange`` was given, from its output and form alone."""
    found, rows = [], []
    for name in FORMS:
        here = pc.equal(form, name)
        some = pc.filter(output, here)
        if name != "plain" and len(some):
            opening, other = (scheme.prefix, scheme.suffix) if name == "psm" else (scheme.suffix, scheme.prefix)
            before, rest = halves(some, opening)
            if pc.any(pc.greater(pc.binary_length(before), 0)).as_py():
                raise ValueError(f"a text that does not begin with {opening}")
            one, rest = halves(rest, other)
            two, middle = halves(rest, scheme.middle)
            prefix, suffix = (one, two) if name == "psm" else (two, one)
            some = glued(prefix, middle, suffix)
        found.append(some)
        rows.append(pc.indices_nonzero(here))
    return pc.take(pa.concat_arrays(found), pc.sort_indices(pa.concat_arrays(rows)))


def transform(df: DataFrame, scheme: Scheme = Scheme(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row; ``n`` counts units.

    A null text counts as empty and stays plain, as does a text that holds a marker. Rows that repeat a key are
    cut by the same numbers, each by its own length; a null key counts as an empty one. An empty table gives
    no rows. Texts are taken whole.
    """
    rows = arrow.text_only(df, key, text).select("*", *numbers(F.col("doc_id"), scheme.seed))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return arrow.map_batches(rows, lambda batch: rearrange(batch, scheme), schema)


def restore(df: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """Rows of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form``; other columns are kept."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = rebuild(batch["output"].cast(BYTES), batch["form"], scheme)
        return batch.append_column("restored", back.cast(pa.large_string()).cast(pa.string()))

    inner = df.schema.simpleString()[len("struct<") : -1]
    return arrow.map_batches(df, step, f"{inner},restored:string")
