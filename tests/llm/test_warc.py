import gzip
import io

import pytest
from precolens.llm import warc

BIG = "é" * 600
ROWS = [
    (1, "http://a/x y", "short"), (2, "http://b", BIG), (3, None, BIG), (4, "http://c", None), (5, "http://d", "short"),
    (7, "u\r\nInjected: 1", BIG), (7, "http://e", BIG), (None, "http://f", BIG), (9, "http://g", "z" * 300_000),
]


def test_round_trip_of_edge_rows(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as SAME")
    rows = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert all(r.digest_ok for r in rows)
    assert [(r.page_id, r.url, r.payload_bytes) for r in rows] == sorted(
        ((i, u, len((t or "").encode())) for i, u, t in ROWS), key=lambda r: (r[0] or 0, r[1] or "")
    )
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {
        (1, "response", None), (2, "revisit", 7), (3, "revisit", 7), (4, "response", None), (5, "response", None),
        (7, "response", None), (None, "revisit", 7), (9, "response", None),
    }
    texts = {r.page_id: r.payload.decode() for r in rows if r.payload is not None}
    assert texts[9] == "z" * 300_000 and texts[4] == "" and texts[7] == BIG


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def archive(*payloads):
    import hashlib

    return b"".join(gzip.compress(warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None)) for i, p in enumerate(payloads))


def test_reader_sees_cuts_and_changes():
    whole = archive(b"one", b"two" * 100_000)
    assert len(list(warc.read_records(io.BytesIO(whole)))) == 2
    assert list(warc.read_records(io.BytesIO(b""))) == []
    with pytest.raises(warc.WarcError, match="cut"):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    for old, new in ((b"\r\nContent-Length: ", b"\r\nContent-Length: 1"), (b"WARC/1.1", b"WORK/1.1")):
        bad = gzip.compress(gzip.decompress(archive(b"one")).replace(old, new))
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    head, block = next(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(archive(b"one")).replace(b"one", b"oNe")))))
    assert warc.parsed(head, block)[6] is False
