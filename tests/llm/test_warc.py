from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from funnelwright.llm import warc


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    big = "".join(f"<p>é {i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(3000))
    rows = [(4, "http://a/ b\n", big), (2, None, big), (3, "u", "one"), (3, "u", "one"), (None, "u", "one"), (5, "u", None), (6, "u", ""),
            (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, sha int, copy int")
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_archive(pages, path, segment_bytes=5000)
    return rows, path


def test_round_trip(spark, archive):
    rows, path = archive
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    size, digest = {}, {}
    for page, _, html in rows:
        data = (html or "").encode()
        size[page, len(data)] = data
        digest[page, len(data)] = warc.digest_of(data)
    for r in got:
        assert r.payload_digest == digest[r.page_id, r.payload_bytes]
        if r.record_type == "response":
            assert bytes(r.payload) == size[r.page_id, r.payload_bytes] and r.refers_to is None
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    want = [(2, "response", None), (4, "revisit", 2), (3, "response", None), (3, "revisit", 3), (None, "revisit", 3),
            (5, "response", None), (6, "revisit", 5), (None, "response", None)]
    assert kinds == sorted(want, key=repr)


def test_long_records_are_segmented(archive):
    _, path = archive
    records = [r for f in Path(path).glob("part-*") for r in warc.parse_records(gzip.decompress(f.read_bytes()))]
    parts = [f for f, _ in records if "warc-segment-number" in f]
    assert len(parts) > 10 and all(int(f["content-length"]) <= 5000 for f in parts)
    assert sum("warc-segment-total-length" in f for f in parts) == 1


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"), least_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.read_archive(spark, str(tmp_path / "w"), payloads=False).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_broken_input_is_told():
    assert warc.dechunked(warc.chunked(b"x" * 10_000, 999)) == b"x" * 10_000
    assert warc.dechunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for body in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(body)
    assert warc.reassembled([(2, b"b"), (1, b"a")], 2) == b"ab"
    for parts, total in (([(1, b"a"), (3, b"c")], 2), ([(1, b"a")], 2), ([(1, b"a"), (1, b"a")], 2)):
        with pytest.raises(ValueError):
            warc.reassembled(parts, total)
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_digest_is_base32_sha1():
    import base64

    assert base64.b32decode(warc.digest_of(b"abc")) == hashlib.sha1(b"abc").digest()
