import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard

from dimsift.llm import warc
from dimsift.llm.queries import QUERIES, SQL

from ..conftest import DATA

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/\r\nX: y", "two"), (4, "http://ü/", None), (5, "", ""),
    (None, "http://b/", "<p>one</p>"), (None, "http://c/", "alone"), (6, "http://d/", "two"), (6, "http://d/", "two"), (7, "u", "x" * 300_000),
]


def test_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    df = QUERIES["op3_warc_zstd"](spark, DATA)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(SQL["op3_warc_zstd"]).fetchall())


@pytest.mark.parametrize("least", [0, 4])
def test_odd_pages(spark, tmp_path, least):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS revisit")
    back = warc.archive_pages(rows, least, str(tmp_path / "w")).collect()
    expected = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        original = max(ids) if ids else None
        revisit = len(payload) >= least and page != original
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((page, len(payload), digest, "revisit" if revisit else "response", original if revisit else None, None if revisit else payload))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(n=600):
    records = [warc.record(i, f"http://a/{i}", b"<p>%d</p>" % i * 40, hashlib.sha1(b"<p>%d</p>" % i * 40).digest(), None, False) for i in range(n)]
    return records, list(warc.frames(iter(records)))


def test_frames():
    records, frames = archive()
    assert struct.unpack_from("<I", frames[0])[0] == 0x184D2A5D and len(frames) == len(records) + 1
    assert list(warc.decode(b"".join(frames))) == records
    # a dictionary that is stored as it is, and none at all
    plain = zstandard.ZstdDecompressor().decompress(frames[0][8:])
    assert list(warc.decode(b"".join([struct.pack("<II", warc.SKIPPABLE, len(plain)) + plain, *frames[1:]]))) == records
    assert list(warc.decode(zstandard.ZstdCompressor().compress(records[0]))) == records[:1]


def test_archives_roll_over(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 5)
    _, frames = archive(5)
    records, _ = archive(40)
    source = iter(records)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    found = []
    while True:
        some = b"".join(warc.frames(source))
        if not some:
            break
        found.append(list(warc.decode(some)))
    assert len(found) > 1 and [r for some in found for r in some] == records


def bad(record):
    with pytest.raises(warc.BadArchive):
        warc.read_record(record)


def test_bad_records():
    (good, *_), _ = archive(1)
    warc.read_record(good)
    bad(good.replace(b"WARC/1.1", b"WARC/9"))
    bad(good.replace(b"<p>0</p>", b"<p>1</p>"))
    bad(good + b"x")
    bad(good[:-5])
    bad(good.replace(b"WARC-Date", b"WARC-Type"))
    bad(good.replace(b"Content-Length: 3", b"Content-Length: x3", 1))
    bad(good.replace(b"response\r\n", b"other\r\n", 1))
    bad(good.replace(b"response\r\n", b"revisit\r\n", 1))


def test_bad_archives():
    _, frames = archive(20)
    whole = b"".join(frames)
    for broken in (whole[:-3], whole[:40], whole[: len(frames[0])] + b"\x00" * 30):
        with pytest.raises(warc.BadArchive):
            list(warc.decode(broken, "x"))


def test_equal_pages_stay_where_they_are(spark, tmp_path):
    """A payload of very many pages is no group of one task."""
    rows = [(i, f"u{i}", "<html>error</html>" if i % 2 else f"<html>{i}</html>") for i in range(4000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    found = warc.with_originals(pages)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["page_id"]: (r["refers_to"], r["revisit"]) for r in found.select("page_id", "refers_to", "revisit").collect()}
    assert got == {i: (3999, True) if i % 2 and i != 3999 else (None, False) for i in range(4000)}
