import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from cutline.llm import queries, warc

ROWS = [(1, "http://a/ b", "same"), (9, None, "same"), (5, "u", "same"), (2, "u", None), (3, "u", ""), (4, "u", "x" * 400_000), (6, "u", "é\r\n\r\nü"), (None, "u", "same"), (None, "u", "lone"), (8, "u", "lone two"), (8, "u", "lone two")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, sha string, n long")


def brute(rows, least):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [x[0] for x in rows if (x[2] or "") == (html or "")]
        keep = max((x for x in ids if x is not None), default=None)
        revisit = len(payload) >= least and keep is not None and i != keep
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6, 10**9])
def test_round_trip(spark, least):
    records = warc.read_warc(warc.write_warc(table(spark, ROWS).repartition(3), min_bytes=least))
    number = lambda c: F.expr(f"try_cast(replace({c}, 'urn:page:', '') AS BIGINT)")
    got = records.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id"), "payload").collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == brute(ROWS, least)
    assert {bytes(x[5]).decode() for x in got if x[3] == "response"} == {x[2] or "" for x in ROWS}
    assert all(x[5] is None for x in got if x[3] == "revisit")


def test_query_on_whole_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x["page_id"], x["url"], x["html"]) for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op5_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0)


def test_empty(spark):
    manifest = warc.write_warc(table(spark, []))
    assert manifest.agg(F.sum("records")).first()[0] in (None, 0)
    assert warc.read_warc(manifest).count() == 0


class _Sink(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


def archive(records):
    sink = _Sink()
    writer = warc.ArchiveWriter(sink)
    for x in records:
        writer.add(x)
    writer.close()
    return sink.data


def test_one_frame_for_each_record_after_the_dictionary():
    records = [warc.page_record(i, "u", f"page {i} ".encode() * 300, None, "1970-01-01T00:00:00Z") for i in range(900)]
    data = archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME and len(data) < sum(map(len, records)) // 4
    found = list(warc.frames(io.BytesIO(data), chunk=1000))
    assert [x for _, x in found] == records
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    offset = found[700][0]
    assert reader.decompressobj().decompress(data[offset:]) == records[700]


def test_malformed():
    good = warc.page_record(1, "u", b"hello", None, "1970-01-01T00:00:00Z")
    headers, block = warc.parse(good)
    assert warc.payload_of(headers, block)[0] == b"hello"
    bad = [good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"hello", b"hallo"), good + b"x", good.replace(b"WARC-Type: ", b"WARC-Type ")]
    for x in bad:
        with pytest.raises(warc.WarcError):
            warc.parse(x)
    data = archive([good] * 5)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data + b"rubbish")))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data[:20])))
