import hashlib

import pytest

from jobreview.llm import warc
from jobreview.llm.warc_format import hex_digest, records

BIG = "é" * 600


def digests(spark, rows, path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, path)
    return warc.page_digests(warc.assemble(warc.landed_records(spark, path, payloads=False)))


def test_round_trip(spark, tmp_path):
    html = "<p>WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n</p>"
    rows = [(1, "http://a.example/x?y#z", BIG), (2, "http://b.example", BIG), (3, None, html), (4, "", None), (5, "u v", "x"), (6, "u", "x"), (7, "u", BIG), (7, "u", BIG), (None, "n", "q")]
    got = digests(spark, rows, str(tmp_path / "w")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = []
    for page, _, text in rows:
        revisit = text == BIG and page != 7
        expected.append((page, len((text or "").encode()), sha(text), "revisit" if revisit else "response", 7 if revisit else None))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, expected))


def test_captures_hold_their_parts(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x?y#z", "<p>é</p>")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    row = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()[0]
    assert bytes(row["response"]["payload"]).decode() == "<p>é</p>"
    assert row["response"]["digest_holds"] and row["copies"] == 1
    assert row["request"]["fields"]["host"] == "a.example"
    assert row["metadata"]["fields"]["page-id"] == "1"


def test_links_in_both_directions(spark):
    columns = [f.name for f in warc.RECORD]
    base = dict.fromkeys(columns)
    rows = [
        base | {"record_id": "r", "type": "response", "concurrent_to": ["q"]},
        base | {"record_id": "q", "type": "request", "concurrent_to": []},
        base | {"record_id": "m", "type": "metadata", "concurrent_to": ["q"]},
        base | {"record_id": "lone", "type": "response", "concurrent_to": []},
        base | {"record_id": "info", "type": "warcinfo", "concurrent_to": []},
    ]
    table = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], warc.RECORD)
    got = {r["record_id"]: r for r in warc.assemble(table).collect()}
    assert set(got) == {"r", "lone"}
    assert got["r"]["request"]["record_id"] == "q" and got["r"]["metadata"]["record_id"] == "m"
    assert got["lone"]["request"] is None


def test_empty_table(spark, tmp_path):
    assert digests(spark, [], str(tmp_path / "w")).count() == 0


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(records(iter([b"nothing here\r\n\r\n"])))
    with pytest.raises(ValueError):
        list(records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"])))
    assert hex_digest("sha1:" + "A" * 32) == "0" * 40
