import hashlib
import io
import zipfile

import pytest

from tidyloom.llm.queries import QUERIES
from tidyloom.llm.wacz import Package, directory, locate_records, parse_record, read_archives, record, write_archives


def reader(data):
    return lambda at, n: data[at : at + n]


def test_directory_of_plain_and_zip64_files(monkeypatch):
    for limit in (None, 10):
        if limit:  # every size and offset above it is written in ZIP64 form
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a", b"x" * 100)
            z.writestr("ü", b"second member")
            z.writestr(zipfile.ZipInfo("c"), b"z" * 500, zipfile.ZIP_DEFLATED)
            z.comment = b"comment PK\5\6 inside"
        data = out.getvalue()
        found = directory(reader(data), len(data))
        assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"a": b"x" * 100, "ü": b"second member"}
        assert (b"PK\6\6" in data) == bool(limit)


def test_records():
    r = parse_record(record(5, "http://a/ü\r\nb", b"pay\r\n\r\nload", hashlib.sha1(b"pay\r\n\r\nload").hexdigest(), None))
    assert (r["page_id"], r["payload"], r["record_type"]) == (5, b"pay\r\n\r\nload", "response")
    r = parse_record(record(6, None, b"12345", "d" * 40, 9))
    assert (r["payload"], r["payload_bytes"], r["refers_to"], r["url"]) == (b"", 5, 9, None)


def test_package_is_a_zip_and_ranges_are_records():
    p = Package()
    for i in range(5):
        p.add(i, "http://x", b"%d" % i * 50, hashlib.sha1(b"%d" % i * 50).hexdigest(), None)
    data = p.finish()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and "datapackage.json" in z.namelist()
    assert len(locate_records(reader(data), len(data))) == 5
    with pytest.raises(ValueError):
        directory(reader(b"no zip"), 6)


def want(rows):
    best = {}
    for k, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, k), k)
    out = []
    for k, html in rows:
        b = (html or "").encode()
        top = best.get(b, k)
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if top > k else "response", top if top > k else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(i, "same" * 400) for i in range(40)] + [(50, "é" * 499), (51, "é" * 499), (52, "é" * 500), (53, "é" * 500)]
    rows += [(60, None), (61, ""), (62, "z" * 3_000_000), (63, "same" * 400), (63, "same" * 400)]
    df = spark.createDataFrame([(k, f"http://h/{k}" if k % 2 else None, t, "x") for k, t in rows], "page_id long, url string, html string, digest string")
    manifest = write_archives(df, str(tmp_path), package_bytes=2000)
    back = read_archives(spark, manifest, str(tmp_path)).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=str) == want(rows)
    texts = dict(rows)
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in back if r.record_type == "response")
    assert not list(tmp_path.glob(".draft*"))
    none = write_archives(df.where("false"), str(tmp_path / "none"))
    assert read_archives(spark, none, str(tmp_path / "none")).count() == 0


def test_query_against_rows(spark, tables):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op10_web_archives"](spark, tables).collect()]
    assert sorted(got, key=str) == want(rows)
