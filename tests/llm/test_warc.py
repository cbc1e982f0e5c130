import base64
import gzip
import hashlib

import pytest

from attestor.llm import warc as W

ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a b/\n5", "tricky\r\n\r\nWARC/1.1\r\n\r\nfiledesc://x 1 2 3"),
    (6, "http://a/6", "é日本\n\n" * 2000), (7, "http://a/7", "<p>x</p>"), (7, "http://a/7", "<p>x</p>"), (None, "http://n", "null id"), (None, "http://n2", "<p>x</p>"), (8, "u", "\n\nleading"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, 2) for i, u, h in rows], "page_id long, url string, html string, digest string, n long, best long")


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        b = best.get(h or "") if len(p) >= least else None
        same = b is None or b == i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else b))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("least", [0, 8, 100])
def test_archives(spark, version, least):
    got = W.archive(pages(spark, ROWS), version=version, min_bytes=least).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == brute(ROWS, least)
    texts = sorted((h or "").encode() for _, _, h in ROWS)
    if least == 100:
        assert sorted(bytes(r.payload) for r in got if r.payload is not None) == texts
    assert all(r.warc_date == "2024-01-01T00:00:00Z" for r in got)


def test_empty_table(spark):
    assert W.archive(pages(spark, [])).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [("http://a/", b"x\ny"), ("http://b c/", b""), (None, b"\n\nfiledesc://"), ("http://d/", bytes(range(256)))]
    records = list(W.parse_arc(W.arc_bytes(bodies, version=version, date="20010203040506")))
    assert [r.payload for r in records] == [b for _, b in bodies]
    assert [r.fields["url"] for r in records] == ["http://a/", "http://b%20c/", "-", "http://d/"]
    one = W.convert(records[0])
    assert one.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and one.headers["WARC-Record-ID"] == W.convert(records[0]).headers["WARC-Record-ID"]
    assert W.convert(W.ArcRecord(records[0].fields, b"HTTP/1.1 200 OK\r\n\r\n")).headers["Content-Type"] == "application/http;msgtype=response"


def test_bad_arcs():
    good = W.arc_bytes([("http://a/", b"body")])
    for bad in (b"http://a/ 0 0 text 4\nbody\n", good.replace(b"1 0 attestor", b"9 0 attestor"), good[:-3], good.replace(b"text/html 4", b"text/html four")):
        with pytest.raises(ValueError):
            list(W.parse_arc(bad))


def test_reads_plain_and_gzipped_records():
    records = [W.convert(r) for r in W.parse_arc(W.arc_bytes([("http://a/", b"one"), ("http://b/", b"two" * 900_000)]))]
    plain = [W.warc_bytes(r) for r in records]
    for data in (b"".join(plain), gzip.compress(b"".join(plain)), b"".join(map(gzip.compress, plain))):
        assert [r.payload for r in W.parse_warc(data)] == [r.payload for r in records]
    with pytest.raises(ValueError):
        list(W.parse_warc(plain[0].replace(b"one", b"eno")))
    with pytest.raises(ValueError):
        list(W.parse_warc(plain[0][:-9]))


def test_archives_roll_by_bytes_and_are_read_in_lines(spark):
    from attestor.llm.common import Workspace

    rows = [(k, f"http://a/{k}", ("x" * 300 + "\n\r\n") * (k + 1)) for k in range(20)]
    work = Workspace(spark, "t")
    W.write_archives(pages(spark, rows).coalesce(1), work.path("a"), work, archive_bytes=4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.page_id: bytes(r.payload).decode() for r in W.read_archives(spark, work.path("a")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: h for i, _, h in rows}
    assert len(spark.read.text(work.path("a")).inputFiles()) > 4
