import base64
import hashlib
import zlib

import pytest

from apexframe.llm import warc
from apexframe.llm.oracles import ORACLES
from apexframe.llm.queries import op5_warc


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>one</p>", "<p>two</p>", None, "", "<p>one</p>", "é" * 400_000, "<p>one</p>", "\x1f\x8b\x08" * 50, None]
    rows = [(i, f"http://x/{i}%\n", h, "extra") for i, h in enumerate(html)] + [(None, None, "<p>one</p>", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)


def expected(rows):
    last = {}
    for page, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    out = {}
    for page, html in rows:
        data = (html or "").encode()
        refers = last[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[page] = (len(data), digest, "revisit" if refers > page else "response", refers if refers > page else None)
    return out


@pytest.mark.parametrize("split", [100, 1000, 1 << 23])
def test_round_trip_with_any_split(spark, pages, tmp_path, split):
    files = warc.write(warc.with_revisits(pages), str(tmp_path)).collect()
    assert sum(f.records for f in files) == 9
    rows = warc.read(spark, f"file:{tmp_path}", split).collect()
    want = expected([(r.page_id, r.html) for r in pages.collect() if r.page_id is not None])
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == 9
    html = {r.page_id: (r.html or "", r.url) for r in pages.collect()}
    assert all((r.payload, r.url) == html[r.page_id] for r in rows if r.record_type == "response")


def test_magic_inside_data_and_damage(tmp_path):
    first, second = warc.record(1, "u", b"a", None), warc.record(2, "v", warc.MAGIC * 9, None, level=0)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.MAGIC + b"junk" + first + b"\x1f\x8b\x08broken" + second)
    size = path.stat().st_size
    for step in (1, 5, 64, size):
        found = [f["warc-record-id"] for k in range(0, size, step) for _, f, _ in warc.records_in(str(path), k, min(size, k + step))]
        assert found == ["<urn:page:1>", "<urn:page:2>"], step


def test_members_are_gzip():
    data = zlib.decompress(warc.record(7, "http://a", b"body", 9), 31)
    assert data.startswith(b"WARC/1.1\r\n") and b"WARC-Type: revisit" in data and b"<urn:page:9>" in data and data.endswith(b"\r\n\r\n")


def test_least_bytes(pages):
    roles = {r.page_id: r.refers_to for r in warc.with_revisits(pages, least_bytes=1).collect()}
    assert roles[0] == roles[4] == 6 and roles[2] is roles[3] is roles[8] is None


def test_empty(spark, pages, tmp_path):
    assert warc.write(warc.with_revisits(pages.limit(0)), str(tmp_path / "none")).count() == 0
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    duckdb.sql("CREATE OR REPLACE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(duckdb.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op5_warc']})").fetchall())
    assert sorted(map(tuple, op5_warc(spark, "/root/testdata/sf0.001").collect())) == want


def test_archives_that_the_driver_does_not_see(spark, tmp_path):
    with pytest.raises(RuntimeError, match="were written"):
        warc.read(spark, str(tmp_path / "elsewhere"), written=10)
    assert warc.read(spark, str(tmp_path / "elsewhere"), written=0).count() == 0
