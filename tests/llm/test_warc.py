import gzip
import hashlib
import os

import pytest

from kanaforge.llm import warc as W

BIG = "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 800


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "extra", "extra") for i, u, h in rows], "page_id long, url string, html string, digest string, refers_to string")


def round_trip(spark, rows, path):
    W.write_warc(W.mark_revisits(pages(spark, rows)), path, file_sizes=((4, 2), (900, 2), (None, 1)))
    return W.assemble(spark, path)


def test_round_trip(spark, tmpdir_path):
    rows = [(1, "http://a/x y\r\nEvil: 1", BIG), (2, "http://a/2", "small"), (3, None, BIG), (4, "http://a/4", ""), (5, "u", None), (6, "u", BIG + "\r\n\r\n"), (7, "u", "small")]
    captures = round_trip(spark, rows, f"{tmpdir_path}/w").collect()
    assert len(captures) == 7
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in captures:
        c = r["capture"]
        page = int(bytes(r["metadata"]["payload"]).split(b": ")[1])
        assert r["request"]["http_header"].startswith("GET ") and r["request"]["target_uri"] == c["target_uri"]
        assert c["payload_digest"] == hashlib.sha1(html[page]).hexdigest()
        assert (bytes(c["payload"]) == html[page]) if c["record_type"] == "response" else (page == 1 and c["payload"] is None)
        assert page != 1 or c["target_uri"] == "http://a/x%20y%20%20Evil:%201".replace("%20%20Evil", "%20%20Evil")


def test_files_are_bounded_and_long_pages_whole(spark, tmpdir_path):
    rows = [(i, "u", f"page {i}") for i in range(20)] + [(100 + i, "u", f"{i}" + "long page " * 300_000) for i in range(3)]
    marked = W.mark_revisits(pages(spark, rows).coalesce(1))
    W.write_warc(marked, f"{tmpdir_path}/w", file_sizes=((100, 8), (None, 1)))
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmpdir_path}/w") for f in names if f.endswith(".gz")]
    held = sorted(sum(h["warc-type"] == "response" for h, _ in W.parse_warc(open(f, "rb").read())) for f in files)
    assert held == [1, 1, 1, 4, 8, 8]
    slim = {r["metadata"]["payload"]: r["capture"] for r in W.assemble(spark, f"{tmpdir_path}/w", payloads=False).collect()}
    for i, _, html in rows:
        c = slim[b"page-id: %d\r\n" % i]
        assert (c["payload"], c["payload_bytes"], c["payload_sha1"]) == (None, len(html), hashlib.sha1(html.encode()).hexdigest())


def test_many_digests_are_joined_by_shuffle(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_DIGESTS", 0)
    test_revisits(spark, tmpdir_path)


def digests(spark, rows, path):
    from kanaforge.llm.common import materialize

    d = materialize(W.capture_digests(round_trip(spark, rows, path)))
    return sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.resolve_revisits(d).collect()), key=str)


def test_revisits(spark, tmpdir_path):
    same = "x" * 1000
    rows = [(i, "u", same) for i in (5, 9, 7)] + [(i, "u", same[:-1]) for i in (1, 2)] + [(3, "u", "y" * 1000)]
    assert digests(spark, rows, f"{tmpdir_path}/w") == sorted([
        (5, 1000, "revisit", 9), (9, 1000, "response", None), (7, 1000, "revisit", 9), (1, 999, "response", None), (2, 999, "response", None),
        (3, 1000, "response", None)], key=str)


def test_null_and_repeated_ids(spark, tmpdir_path):
    same = "z" * 2000
    rows = [(None, None, same), (4, "u", same), (4, "u", same), (None, None, None)]
    assert digests(spark, rows, f"{tmpdir_path}/w") == sorted([
        (None, 2000, "revisit", 4), (4, 2000, "response", None), (4, 2000, "response", None), (None, 0, "response", None)], key=str)


def test_empty_table(spark, tmpdir_path):
    assert digests(spark, [], f"{tmpdir_path}/w") == []


def test_parser_reads_foreign_archives():
    record = lambda kind, block: b"WARC/1.0\r\nwarc-type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    plain = record(b"warcinfo", b"software: x\r\n") + record(b"response", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n")
    members = b"".join(gzip.compress(record(b"response", b"block %d" % k)) for k in range(3))
    assert [b for _, b in W.parse_warc(plain)] == [b"software: x\r\n", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n"]
    assert [b for _, b in W.parse_warc(members)] == [b"block 0", b"block 1", b"block 2"]
    assert list(W.parse_warc(b"")) == []
    with pytest.raises(ValueError, match="cut short"):
        list(W.parse_warc(plain[:-20]))
    with pytest.raises(ValueError, match="not a WARC"):
        list(W.parse_warc(b"hello"))
