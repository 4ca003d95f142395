import hashlib

from checks.compare import compare
from orelode.llm import queries, warc

SAME = "<p>the same payload, long enough to be a revisit</p>" * 3


def test_query_equals_sql(spark, sf):
    assert not compare(spark, sf, queries.QUERIES["op5_warc"], queries.SQL["op5_warc"])[2]


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/5", SAME), (3, None, SAME), (9, "http://a b\r\n/9", SAME), (1, "u", None), (2, "u", ""), (4, "u", "short"),
            (6, "u", "short"), (None, "n", SAME), (None, None, None), (3, None, SAME), (7, "u", "é" * 200_000), (8, "u", "\r\n\r\n" * 40)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "page_id long, url string, html string, digest string, payload string").repartition(3)
    got = warc.archive_pages(spark, pages, str(tmp_path / "w"), payloads=True).collect()
    assert len(got) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    for r in got:
        revisit = r.page_id in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        if r.page_id is not None:
            assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
            assert r.payload_bytes == len(html[r.page_id])
            assert r.payload == (None if revisit else html[r.page_id])
    assert [r.url for r in got if r.page_id == 9] == ["http://a%20b%0D%0A/9"]


def test_archives_stand_alone():
    import struct

    import zstandard

    records = [warc.record(i, f"http://h/{i}", SAME.encode() * (i % 3), "00", None, "1970-01-01T00:00:00Z") for i in range(300)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])).decompressobj()
    assert one.decompress(data[8 + size:]) == records[0] and one.unused_data  # a frame for each record
    assert [int(h["x-page-id"]) for h, _ in warc.parse(data)] == list(range(300))
    assert len(data) < sum(map(len, records)) / 2


def test_too_few_records_for_a_dictionary():
    record = warc.record(1, None, b"", "00", None, "1970-01-01T00:00:00Z")
    assert [b for _, b in warc.parse(warc.archive([record]))] == [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n"]


def test_no_pages(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
