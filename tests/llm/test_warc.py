import hashlib
import io
import re
import zlib

import pytest

from motionfield.llm.warc import Inflated, read_warc, records, roles, warc_round_trip, write_warc
from pyspark.sql import functions as F

BIG = "é<p>text</p>\r\n\r\nWARC/1.0\r\n" * 9000


def brute(pages):
    payload = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, p in payload:
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payload:
        ref = first.get(p) if i is not None and i > first.get(p, i) else None
        out.append((repr(i), len(p), hashlib.sha256(p).hexdigest(), "response" if ref is None else "revisit", repr(ref)))
    return sorted(out)


def frame(spark, pages):
    return spark.createDataFrame([(i, "http://x/\r\na" if k % 2 else None, h, 7) for k, (i, h) in enumerate(pages)], "page_id long, url string, html string, chunk int").repartition(3)


def run(spark, pages, chunk):
    return sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to)) for r in warc_round_trip(frame(spark, pages), chunk=chunk).collect())


def test_round_trip_and_edges(spark):
    pages = [(5, BIG), (3, BIG), (9, BIG), (1, "short"), (2, "short"), (4, None), (6, ""), (None, BIG), (7, "x" * 100), (7, "x" * 100), (8, "x" * 100), (10, "y" * 99), (11, "y" * 99), (12, "z" * 64), (13, "z" * 128)]
    for chunk in (64, 1 << 16):
        assert run(spark, pages, chunk) == brute(pages)
    assert run(spark, [], 64) == []


def test_chunks_carry_digests(spark):
    rows = frame(spark, [(1, BIG)]).select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    chunks = sorted(read_warc(write_warc(roles(rows), 1000), 1000).collect(), key=lambda r: r.chunk)
    so_far = b""
    for k, r in enumerate(chunks):
        so_far += bytes(r.data)
        assert r.chunk == k and len(r.data) <= 1000 and r.last == (k == len(chunks) - 1)
        assert r.digest_so_far == hashlib.sha256(so_far).hexdigest()
    assert so_far == BIG.encode()


def strict(data: bytes):
    """Records of an archive, by the rules of WARC/1.0; each is a gzip member."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        raw, data = member.decompress(data), member.unused_data
        assert member.eof
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = [re.fullmatch(r"([!-9;-~]+): (.*)", x).groups() for x in lines]
        h = dict(fields)
        assert version == "WARC/1.0" and len(h) == len(fields)
        assert h["WARC-Type"] in ("response", "revisit") and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", h["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) and re.fullmatch(r"[a-z]+:\S*", h["WARC-Target-URI"]) and re.fullmatch(r"sha256:[0-9a-f]{64}", h["WARC-Payload-Digest"]) and h["Content-Type"]
        n = int(h["Content-Length"])
        assert rest[n:] == b"\r\n\r\n"
        assert (h["WARC-Type"] == "revisit") == ("WARC-Profile" in h) == ("WARC-Refers-To" in h)
        out.append((h, rest[:n]))
    return out


def test_archives_are_read_by_the_rules(spark):
    pages = [(k, "http://x/" + str(k) if k % 3 else None, ("a page of over a hundred bytes " * 9 if k % 2 else f"{k}")) for k in range(20)]
    pages.append(pages[1])
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload")).repartition(2)
    found = [r for m in write_warc(roles(rows)).collect() for r in strict(open(m.path.removeprefix("file:"), "rb").read())]
    ids = {h["WARC-Record-ID"]: (h, body) for h, body in found}
    assert len(found) == 21 and len({(h["WARC-Record-ID"], h["WARC-Type"]) for h, _ in found}) >= 20
    for h, body in found:
        if h["WARC-Type"] == "revisit":
            target, payload = ids[h["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and not body and h["WARC-Payload-Digest"] == target["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert sum(h["WARC-Type"] == "revisit" for h, _ in found) == 9


def test_damaged_archives_are_refused():
    one = b"WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    whole = zlib.compress(one, wbits=31) * 2
    assert [x[2] for x in records(Inflated(io.BytesIO(whole), 7), 2)] == [b"he", b"ll", b"o"] * 2
    for bad in (whole[:-9], zlib.compress(one[:-6], wbits=31), zlib.compress(b"x" + one, wbits=31)):
        with pytest.raises(ValueError):
            list(records(Inflated(io.BytesIO(bad), 7), 2))
