"""ARC to WARC and back, beside plain Python."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from seriesforge.llm import archives, queries
from seriesforge.sources import staging
from tests.compare import duck
from tests.llm.common import ODD_TEXTS, frame

SF_DIR = "/root/testdata/sf0.001"


def read_back(spark, pages, **options):
    volumes = archives.arc_volumes(pages, "page_id", "url", "html", F.lit(0))
    folder = staging.fresh_path(spark, "warc")
    archives.write_warc(archives.mark_revisits(archives.convert(volumes), **options), folder, records_per_file=7)
    return archives.read_warc(spark, folder).where("type <> 'warcinfo'").collect()


def test_round_trip_of_odd_pages(spark):
    odd = ODD_TEXTS + ["a\r\n\r\nWARC/1.1\r\n\r\n", "HTTP/1.1 200\r\n\r\nx", "\r\n\r\n", "1 0 x\nfiledesc://"]
    rows = [(i, f"http://a b/{i}\n", t) for i, t in enumerate(odd)] + [(100 + i, None, t) for i, t in enumerate(odd)] + [(55, "u", "only"), (55, "u", "only"), (None, None, "n")]
    got = read_back(spark, frame(spark, rows, "page_id long, url string, html string").repartition(3))
    last = {}
    for key, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if key is None else key)
    assert len(got) == len(rows)
    payloads = {}
    for key, _, html in rows:
        payloads.setdefault(key, (html or "").encode())
    for r in got:
        payload = payloads[r.key]
        assert r.payload_bytes == len(payload) and r.payload_digest == archives.base32_sha1(payload)
        if r.type == "response":
            assert r.refers_to_key is None and r.key in (None, last[payload.decode()])
        else:
            assert r.type == "revisit" and r.refers_to_key == last[payload.decode()]
    assert sum(r.type == "response" for r in got) == len(last)
    assert len({r.record_id for r in got}) == len(got)


def test_threshold_and_empty_table(spark):
    pages = frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert sorted((r.key, r.type) for r in read_back(spark, pages, least_bytes=3)) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_foreign_volumes():
    body = b"HTTP/1.0 404 No\r\n\r\ngone"
    about = b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n"
    volume = b"filedesc://x.arc 0.0.0.0 19961212000000 text/plain %d\n" % len(about) + about
    volume += b"\nhttp://a/b c 1.2.3.4 19970101123456 text/html %d\n" % len(body) + body
    volume += b"\n\ndns:a 1.2.3.4 19970101 text/dns 3\nabc\nhttp://z/ 1.2.3.4 19970101000000 text/html 99\nHTTP/1.0 200\r\n\r\nshort"
    found = [archives.to_warc("x", r) for r in archives.parse_arc(volume)]
    assert [r["type"] for r in found] == ["warcinfo", "response", "resource", "response"]
    assert found[1]["url"] == "http://a/b c" and found[1]["payload"] == b"gone" and found[1]["date"] == "1997-01-01T12:34:56Z"
    assert found[2]["date"] == "1997-01-01T00:00:00Z"
    assert [r["truncated"] for r in found] == [False, False, False, True]
    with pytest.raises(ValueError, match="header line"):
        list(archives.parse_arc(volume[: volume.index(b"\n\ndns")] + b"\nbroken line\n"))
    with pytest.raises(ValueError, match="version"):
        list(archives.parse_arc(b"filedesc://x 0 0 text/plain 4\n9 0 \n"))


def test_members_and_pieces():
    record = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(record * 2)
    for step in (1, 7, 1 << 20):
        assert [block for _, block in archives.parse_warc(archives.inflate(data, step))] == [b"hi"] * 3
    assert archives.base32_sha1(b"") == __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()


def test_query_equals_sql(spark):
    got = sorted(map(tuple, queries.queries()["op3_warc"](spark, SF_DIR).collect()))
    assert got == sorted(duck(SF_DIR).execute(queries.oracle_sql()["op3_warc"]).fetchall())
