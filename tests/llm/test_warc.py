import base64
import hashlib

import pytest

from evidra.llm.common import scratch_path
from evidra.llm.warc import original_records, read_archive, write_archive

ROWS = [(5, "u5", "<p>a</p>"), (2, "u2", "<p>a</p>"), (9, None, None), (3, "u3", ""), (7, "u7", "é" * 5000), (2, "u2", "<p>a</p>"), (None, "n", "<p>a</p>"), (4, "x", "y")]


def archive(spark, rows):
    path = scratch_path(spark, "test-warc")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'z' AS sha256"), path)
    return path


def test_round_trip(spark):
    got = read_archive(spark, archive(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        html = next(h for i, _, h in ROWS if i == r.page_id) or ""
        same = [i for i, _, h in ROWS if (h or "") == html and i is not None]
        body = html.encode()
        assert (r.payload_bytes, bytes(r.payload)) == (len(body), body)
        assert r.payload_digest == r.header_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("response" if r.page_id == min(same) else "revisit")
        assert r.refers_to == (None if r.page_id == min(same) else min(same))


def test_original_records(spark):
    records = {r.page_id: bytes(r.record) for r in original_records(read_archive(spark, archive(spark, ROWS))).collect()}
    head, _, body = records[7].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in head and body == ("é" * 5000).encode() + b"\r\n\r\n"
    assert b"Content-Length: 0" in records[5] and b"WARC-Refers-To: <urn:page:2>" in records[5]


def test_urls_cannot_forge_fields(spark):
    urls = ["http://a\r\nWARC-Refers-To: <urn:page:99>\r\nX: y", "http://b\nWARC-Type: revisit", "\r", "http://c/\u2028\x85\x00 \t%41é", "http://d?q=1"]
    rows = [(i, u, f"p{i % 2}") for i, u in enumerate(urls)]
    path = archive(spark, rows)
    got = {r.page_id: r for r in read_archive(spark, path).collect()}
    assert [got[i].record_type for i in range(5)] == ["response", "response", "revisit", "revisit", "revisit"]
    assert [got[i].refers_to for i in range(5)] == [None, None, 0, 1, 0]
    assert got[0].url == "http://a%0D%0AWARC-Refers-To:%20<urn:page:99>%0D%0AX:%20y" and got[2].url == "%0D"
    assert got[3].url == "http://c/%E2%80%A8%C2%85%00%20%09%41é" and got[4].url == urls[4]
    for r in original_records(read_archive(spark, path)).collect():
        head = bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        names = [line.partition(":")[0] for line in head[1:]]
        assert len(set(names)) == len(names) and {"WARC-Date", "WARC-Record-ID", "Content-Length", "WARC-Type"} <= set(names)


def test_damage_is_found(spark):
    path = archive(spark, ROWS)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", __import__("pyspark").sql.functions.lit(b"other")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, f"{path}-2").select("payload_bytes").collect()


def test_empty(spark):
    assert read_archive(spark, archive(spark, [])).count() == 0
