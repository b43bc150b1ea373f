import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import warc


def test_framing():
    for payload in (b"", b"x", "é你".encode() * 5000, b"WARC/1.1\r\n\r\n0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
        assert warc.payload_of(warc.HTTP + warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_round_trip(spark, tmp_path):
    long = "long é\r\n\r\nWARC/1.1\r\n" * 20_000
    same = "same page " * 200
    rows = [(1, "u", long), (2, None, None), (3, "u\r\nx", ""), (4, "u", same), (9, "u", same), (9, "u", same), (5, "u", "short"), (6, "u", "short"), (None, "u", same), (None, "u", "lone" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("digest", F.lit(1))
    path = f"file://{tmp_path}/archive"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    found = [(r.id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got]
    want = [(i, "response", None, h or "") for i, _, h in rows if (i, h) not in ((4, same), (None, same))] + [(4, "revisit", 9, None), (None, "revisit", 9, None)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert {r.payload_digest for r in got if r.id == 4} == {hashlib.sha1(same.encode()).hexdigest()}
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_segments_in_any_order_and_damage(spark, tmp_path):
    payload = b"abc " * 3000
    whole = warc.records(7, "u", payload, hashlib.sha1(payload).hexdigest(), None, 1000)
    records = [warc.record(list(f.items()), b) for f, b in warc.parse(iter([whole[i : i + 777] for i in range(0, len(whole), 777)]))]
    assert len(records) > 10
    other = warc.records(8, "u", payload, hashlib.sha1(payload).hexdigest(), None, 1000)
    damaged = [warc.record([*f.items()], b) for f, b in warc.parse(iter([other]))]
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(r) for r in records[::2][::-1]))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"".join(records[1::2] + damaged[:3] + damaged[4:])))
    got = {r.id: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got[7].intact and bytes(got[7].payload) == payload
    assert not got[8].intact and got[8].payload is None


def test_plain_archives_and_files_that_end_early(spark, tmp_path):
    payload = b"abc " * 300
    one = lambda k: warc.records(k, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    (tmp_path / "plain.warc").write_bytes(one(1) + one(2))
    (tmp_path / "other").write_bytes(one(3))
    (tmp_path / "cut.warc").write_bytes(one(4) + one(5)[:-700])
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(one(6) + one(7))[:-40])
    (tmp_path / "noise.gz").write_bytes(b"\x1f\x8b" + b"noise" * 50)
    (tmp_path / "lengthless.warc").write_bytes(one(8) + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    intact = {r.id for r in rows if r.intact}
    assert {1, 2, 3, 4, 8} <= intact <= {1, 2, 3, 4, 6, 8}
    damaged = {r.target_uri.rsplit("/", 1)[1] for r in rows if r.record_type == "damaged"}
    assert damaged == {"cut.warc", "cut.warc.gz", "noise.gz", "lengthless.warc"}
    assert all(not r.intact and r.payload is None for r in rows if r.record_type == "damaged")


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    df = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("*.gz"))) >= 10
    assert warc.read_archives(spark, f"file://{tmp_path}/a").where("intact").count() == 200


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("bits", [24, 4])
def test_only_shared_payloads_move(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(warc, "MARK_BITS", bits, raising=False)
    noise = random.Random(1)
    rows = [(i, "u", noise.randbytes(4000).hex()) for i in range(200)] + [(200 + i, "u", f"{i % 3} " * 600) for i in range(30)] + [(230 + i, "u", "short") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        warc.write_archives(df, f"file://{tmp_path}/a")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    got = sorted((r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.intact) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect())
    last = {h: i for i, _, h in rows}
    first = [last[h] if len(h) >= warc.REVISIT_BYTES else i for i, _, h in rows]
    assert got == [(i, "response" if k == i else "revisit", None if k == i else k, len(h), hashlib.sha1(h.encode()).hexdigest(), True) for (i, _, h), k in zip(rows, first, strict=True)]
    if bits == 24:  # with 16 bits in all, most payloads meet a mark by chance
        assert moved < 0.2 * sum(len(h) for _, _, h in rows)
