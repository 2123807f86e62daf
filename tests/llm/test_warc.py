import glob
import gzip

import pytest
from pyspark.sql import functions as F

from strandworks.llm import warc


def test_parse_arc_both_versions_by_declared_length():
    for version in (1, 2):
        name = f"v{version}.arc"
        tricky = b"<p>\n\nhttp://x/ 127.0.0.1 20200101000000 text/html 5\nabc</p>"
        content = warc.arc_version_block(version, name)
        content += warc.arc_record(version, name, 0, "http://a/", "20210203040506", 7, tricky)
        content += warc.arc_record(version, name, 0, "http://b/", "20210203040506", None, b"")
        for form in (content, gzip.compress(content)):
            got = list(warc.parse_arc(name, form))
            assert [g[1] for g in got] == [version] * 2
            assert [g[2] for g in got] == ["http://a/", "http://b/"]
            assert warc.split_http(got[0][6])[1] == tricky and warc.split_http(got[1][6])[1] == b""
    with pytest.raises(ValueError, match="bad.arc.*offset"):
        list(warc.parse_arc("bad.arc", warc.arc_version_block(1, "x") + b"http://a/ 1 2 text/html 999\nshort"))


def test_conversion_against_brute_force(spark, tmp_path):
    big, other = "é" * 60, "x" * 100
    rows = [(5, "http://e/", big), (3, None, big), (9, "u", big), (2, "http://s/", "short"), (1, "t", "short"), (4, "", None), (6, "v", ""), (7, "w", other), (7, "w", other), (8, "w", other), (None, "n", other), (10, "z\n q", "\r\n\r\nWARC/1.1\r\n" + "q" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash")).withColumn("content", F.lit(1))
    got = warc.convert_pages(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    first = {big: 3, other: 7}
    want = []
    for pid, _, html in rows:
        data = (html or "").encode()
        f = first.get(html)
        again = f is not None and pid != f
        want.append((pid, len(data), "revisit" if again else "response", f if again else None))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    for path in glob.glob(str(tmp_path / "w/**/*.gz"), recursive=True):
        for h, block in warc.parse_warc(path, open(path, "rb").read()):
            assert h["WARC-Record-ID"].startswith("<urn:uuid:") and len(block) == int(h["Content-Length"])


def test_arbitrary_bytes_survive(spark, tmp_path):
    body = bytes(range(256)) * 3
    content = warc.arc_version_block(1, "b.arc") + warc.arc_record(1, "b.arc", 0, "http://a/", "20210203040506", 1, body)
    arcs = spark.createDataFrame([("b.arc", bytearray(content))], "path string, content binary")
    warc.write_warc(warc.convert(arcs), str(tmp_path / "w"))
    (row,) = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert (row.page_id, row.payload_bytes) == (1, len(body))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert_pages(pages, str(tmp_path / "w")).count() == 0


def written(path):
    return [len(gzip.decompress(open(p, "rb").read())) for p in glob.glob(f"{path}/**/*.gz", recursive=True)]


def test_files_are_cut_by_running_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4 << 20)
    rows = [(i, f"http://a/{i}", f"{i} " + "é" * 1_000_000) for i in range(9)] + [(20, "http://b/", rows_text := "z" * 3_000_000), (21, "http://c/", rows_text)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.convert_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted((i, len(t.encode()), "revisit" if i == 21 else "response", 20 if i == 21 else None) for i, _, t in rows)
    sizes = written(tmp_path / "w")
    assert max(sizes) <= 4 << 20 and len(sizes) <= 11


def test_one_long_page_does_not_cut_the_others_apart(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " + "word " * (i % 50)) for i in range(2000)] + [(5000, "http://long/", "é" * (16 << 20))]
    for place in (0, 1000, 2001):
        pages = spark.createDataFrame(rows[:2000][:place] + rows[2000:] + rows[:2000][place:], "page_id long, url string, html string").coalesce(1)
        got = warc.convert_pages(pages, str(tmp_path / f"w{place}")).select("page_id", "payload_bytes").collect()
        assert sorted(map(tuple, got)) == sorted((i, len(t.encode())) for i, _, t in rows)
        assert len(written(tmp_path / f"w{place}")) <= 3
