"""WARC source: round trips, pushdown, skipping, planning, foreign and malformed files."""

import gzip
import hashlib
import io
import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lectio.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    same = defaultdict(list)
    for i, (p, _, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= 100:
            same[data].append((p is None, p or 0, i))
    out = []
    for i, (p, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = min(same[data], default=None) if data in same else None
        revisit = first is not None and len(same[data]) > 1 and first[2] != i
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    rows[first[2]][0] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("row", F.lit(2)).withColumn("digest", F.lit("x"))


ROWS = [(3, "http://a/x", "<p>" + "é" * 60), (1, "http://b/\r\nWARC-Type: x", "<p>" + "é" * 60), (2, None, "<p>" + "é" * 60), (4, "u", None), (5, "u", ""),
        (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.1\r\n\r\n" * 30), (-9, "u", "WARC/1.1\r\n\r\n" * 30), (None, "u", "x" * 100),
        (None, "v", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 500), (12, "u", "z" * 500), (13, "u", "big " * 600_000), (14, "ü", "\x00<b>\r\n\r\n")]


@pytest.mark.parametrize("options", [{}, {"compress": "false"}, {"fileBytes": "400", "markBytes": "100"}])
def test_round_trip(spark, tmp_path, options):
    path = str(tmp_path / "w")
    W.write_warc(W.page_records(pages(spark, ROWS), "2024-01-01T00:00:00Z"), path, **options)
    back = W.archived_pages(W.read_warc(spark, path, partitionBytes="500"))
    assert got(back) == plain(ROWS)
    texts = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response' and page_id is not null").collect()}
    assert all(texts[p] == (html or "") for p, _, html in ROWS if p in texts and p != 12)


def test_hot_payload_and_empty_table(spark):
    rows = [(i, "u", "copy " * 40) for i in range(300)] + [(1000 + i, "u", f"page {i} " * 30) for i in range(20)]
    assert got(W.archive_pages(pages(spark, rows))) == plain(rows)
    assert W.archive_pages(pages(spark, [])).count() == 0


def test_members_are_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_warc(W.page_records(pages(spark, ROWS[:6]).coalesce(1), "d"), path)
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    text = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 6 and text.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://b/%0D%0AWARC-Type: x\r\n" in text


def test_pushdown_skips_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_warc(W.page_records(pages(spark, ROWS), "d"), path)
    df = W.read_warc(spark, path).where("record_type = 'revisit' and payload_length > 150 and target_uri is not null")
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.payload_length for r in df.collect()} == {360, 500}
    assert W.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    ids = {r.record_id for r in W.read_warc(spark, path).where("target_uri like 'http%' or target_uri is null").collect()}
    assert len(ids) == 3

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.read_bytes += len(out)
            return out

    big = b"".join(W.gzip_member(W.record_bytes(dict(record_type="response", record_id=f"<urn:{i}>", warc_date="d", target_uri="u", payload_digest=None, refers_to=None,
                                                   content_type="application/http", payload_length=None, payload=os.urandom(3_000_000))), 6) for i in range(5))
    only = D.EqualTo(("record_id",), "<urn:3>")
    rows = list(W.records(Counted(big), 0, len(big), True, lambda r: W.judge(only, r), True))
    assert [r["record_id"] for r in rows] == ["<urn:3>"] and len(rows[0]["payload"]) == 3_000_000
    assert Counted.read_bytes < 4_000_000


def test_conditions_follow_sql():
    row = {"record_type": "response", "target_uri": None, "content_length": 7}
    assert W.judge(D.EqualTo(("target_uri",), "x"), row) is None and W.judge(D.Not(D.EqualTo(("target_uri",), "x")), row) is None
    assert W.judge(D.Not(D.In(("record_type",), ("revisit",))), row) is True
    assert W.judge(D.LessThan(("content_length",), 8), row) is True and W.judge(D.EqualNullSafe(("target_uri",), None), row) is True
    assert not W.can_push(D.EqualTo(("payload",), b"x")) and not W.can_push(D.GreaterThan(("record_id",), "a"))


def test_foreign_archives(spark, tmp_path):
    recs = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nX-Other: a: b\r\n\r\nhello\r\n\r\n",
            b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:q>\r\nContent-Type: application/http\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nxy\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    (tmp_path / "skip.txt").write_text("no archive")
    rows = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload), r.payload_length) for r in rows) == sorted(
        [("warcinfo", b"hello", 5), ("response", b"xy", 2), ("metadata", b"", 0)] * 2)
    assert W.read_warc(spark, f"file://{tmp_path}/a.warc").where("record_type = 'response'").first().record_id == "<urn:q>"


def test_malformed_archives_raise(spark, tmp_path):
    for i, bad in enumerate((b"no record\r\n\r\n", b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n")):
        p = tmp_path / f"{i}.warc"
        p.write_bytes(bad)
        with pytest.raises(Exception, match="malformed WARC record at byte 0"):
            W.read_warc(spark, str(p)).collect()


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_warc(W.page_records(pages(spark, ROWS[:3]), "d"), path)
    (tmp_path / "w" / "part-lost.warc").write_bytes(b"cut off")
    assert W.read_warc(spark, path).count() == 3
    W.write_warc(W.page_records(pages(spark, ROWS[3:5]), "d"), path)
    assert W.read_warc(spark, path).count() == 5
    W.write_warc(W.page_records(pages(spark, ROWS[:1]), "d"), path, mode="overwrite")
    assert W.read_warc(spark, path).count() == 1


def test_plan_cuts_at_marks_and_packs():
    files = [{"file": "a", "bytes": 100, "starts": [0, 40, 80]}, {"file": "b", "bytes": 10, "starts": [0]}]
    assert [p.parts for p in W.plan(files, 60)] == [[("a", 0, 40)], [("a", 40, 100)], [("b", 0, 10)]]
    assert [p.parts for p in W.plan(files, 1000)] == [[("a", 0, 100), ("b", 0, 10)]]
    assert json.loads(json.dumps(files)) == files
