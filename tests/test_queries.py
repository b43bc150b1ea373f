"""Every registered key-value query against its SQL, and invariants that no SQL states."""

import duckdb
import pytest

from tidelog import registry
from tidelog.functions.keys import KeyRange, prefix_upper
from tidelog.operators import compact, dml, meta, reads
from tidelog.sources import adapters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_prefix_bounds():
    assert prefix_upper(b"abc") == b"abd" and prefix_upper(b"a\xff\xff") == b"b"
    assert prefix_upper(b"\xff") is None and prefix_upper(b"\xff\xff") is None and prefix_upper(b"") is None
    assert KeyRange("b", "a").empty and KeyRange("a", "a").empty and not KeyRange("a", "a", True, True).empty


def test_binary_prefixes(spark):
    keys = [b"\x00", b"\xfe\xff", b"\xff", b"\xff\x00", b"\xff\x01", b"\xff\xff", b"\xff\xff\x00", b"\xff\xff\x01"]
    df = spark.createDataFrame([(bytearray(k), 1, 1, 0, "v", False, False, 2) for k in keys], "k binary, txid long, cmd long, gid long, v string, tomb boolean, aborted boolean, commit_ts long")
    view = reads.View(df, 10)
    for prefix, n in ((b"\xff", 6), (b"\xff\xff", 3), (b"", 8), (b"\x00", 1)):
        assert view.seek(prefix).count() == n
    assert [bytes(r.k) for r in view.ordered(reverse=True).collect()] == sorted(keys, reverse=True)


def replay(log):
    """Outcomes one after the other: a transaction sees its own writes, others see them if it did not abort."""
    state, own, out, now = {}, {}, {}, None
    for r in sorted(log, key=lambda r: (r.txid, r.cmd)):
        if r.txid != now:
            own, now = {}, r.txid
        live = own.get(r.k, state.get(r.k, "")) != ""
        outcome = "Exist" if r.op == "put" and live else "NotFound" if r.op in ("update", "del") and not live else "Ok"
        out[r.seq] = outcome
        if outcome == "Ok":
            own[r.k] = r.v
            if not r.aborted:
                state[r.k] = r.v
    return out


def test_outcomes_are_those_of_a_replay(spark):
    log = adapters.ops(spark, SF)
    assert {r.seq: r.outcome for r in dml.outcomes(log).collect()} == replay(log.collect())


def test_a_transaction_sees_its_own_writes(spark):
    rows = [(1, "put", "x", 1, 1, True), (2, "put", "y", 1, 2, True), (3, "del", "", 1, 3, True), (4, "update", "z", 2, 1, False), (5, "upsert", "z", 2, 2, False), (6, "upsert", "w", 2, 3, False), (7, "put", "q", 3, 1, False)]
    log = spark.createDataFrame([(s, "k", op, v, t, c, t, a, 0) for s, op, v, t, c, a in rows], "seq long, k string, op string, v string, txid long, cmd long, commit_ts long, aborted boolean, gid long")
    got = sorted((r.seq, r.outcome, r.effect) for r in dml.outcomes(log).collect())
    assert got == [(1, "Ok", "Insert"), (2, "Exist", None), (3, "Ok", None), (4, "NotFound", None), (5, "Ok", "Insert"), (6, "Ok", "Replace"), (7, "Exist", None)]


def test_redo_goes_by_command(spark):
    from tidelog.operators import wal

    log = spark.createDataFrame([(0, 0, p, kind, 7, c, "k", v, 0, True) for p, kind, c, v in ((0, "Begin", None, None), (1, "Update", 1, "a"), (2, "Update", 2, "b"), (3, "Commit", None, None))], "gid long, file long, pos long, kind string, txid long, cmd long, k string, v string, bucket long, intact boolean")
    heads = spark.createDataFrame([(0, "k", 7, 1)], "bucket long, k string, head long, head_cmd long")
    frontier = spark.createDataFrame([], "bucket long, gid long, durable_file long, durable long")
    assert [(r.cmd, r.v) for r in wal.redo(log, frontier, heads, spark.createDataFrame([(0,)], "bucket long")).collect()] == [(2, "b")]


def test_first_writer_wins_in_chains(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(4), t, t + rng.randrange(1, 60)) for t in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "k long, txid long, commit_ts long")
    want, held = {}, {}
    for k, s, c in sorted(rows, key=lambda r: r[1]):
        want[k, s] = held.get(k, -1) < s
        held[k] = c if want[k, s] else held[k]
    assert {(r.k, r.txid): r.ok for r in dml.first_writer_wins(df).collect()} == want


def test_long_and_short_intervals_side_by_side(spark):
    ivs = spark.createDataFrame([(i, 10 * i, 10 * i + 4) for i in range(500)] + [(1000, 10_000, 10**12), (1001, 2 * 10**12, 2 * 10**12)], "file_id long, lo long, hi long")
    points = spark.createDataFrame([(p,) for p in (0, 4, 5, 4994, 4995, 10_000, 10**12, 10**12 + 1, 2 * 10**12)], "p long")
    assert sorted((r.p, r.file_id) for r in meta.locate(points, ivs, "p").collect()) == [(0, 0), (4, 0), (4994, 499), (10_000, 1000), (10**12, 1000), (2 * 10**12, 1001)]
    assert meta.overlapping(ivs).count() == 0


def test_places_need_no_global_window(spark):
    rows = spark.range(5000).selectExpr("format_string('%05d', id * 7919 % 5000) AS k")
    for reverse in (False, True):
        got = {r.k: (r.place, r.n) for r in reads.ranked(rows, reverse).collect()}
        assert got == {f"{i:05d}": ((5000 - i) if reverse else i + 1, 5000) for i in range(5000)}
    plan = reads.ranked(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window", 1)[1].split("BroadcastExchange")[0]
    assert reads.ranked(rows.limit(0)).count() == 0


def test_bounds_reach_the_scan_of_registered_reads(spark):
    for name in ("point_get", "prefix_seek", "range_incl_excl", "history_versions"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(user_id" in plan and "LessThanOrEqual(user_id" in plan


def test_compaction_keeps_snapshots_above_the_boundary(spark):
    versions = dml.versions(adapters.ops(spark, SF)).where("not aborted").cache()
    small = compact.compact(versions, 7960)  # what is below has committed before any of these snapshots begins
    for snapshot in (8003, 9001, 15_000, 99_999):
        assert sorted(reads.View(versions, snapshot).scan().collect()) == sorted(reads.View(small, snapshot).scan().collect())


def test_scans_reach_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "v")
    dml.versions(adapters.ops(spark, SF)).write.parquet(path)
    view = reads.View(spark.read.parquet(path), 9000)
    plan = view.seek("u00001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,u00001)" in plan and "LessThan(k,u00002)" in plan and "WindowGroupLimit" in plan
    assert "LocalTableScan <empty>" in view.range(KeyRange("b", "a"))._jdf.queryExecution().executedPlan().toString()
    keys = view.keys()._jdf.queryExecution().executedPlan().toString()
    assert "v:string" not in keys.split("ReadSchema")[1].split("\n")[0]


def test_intervals(spark):
    ivs = spark.createDataFrame([(10, 0, 100), (20, 101, 200), (30, 10_000, 2_000_000)], "file_id long, lo long, hi long")
    points = spark.createDataFrame([(p,) for p in (0, 50, 100, 101, 150, 200, 201, 9999, 10_000, 2_000_000, 2_000_001)], "p long")
    got = sorted((r.p, r.file_id) for r in meta.locate(points, ivs, "p").collect())
    assert got == [(0, 10), (50, 10), (100, 10), (101, 20), (150, 20), (200, 20), (10_000, 30), (2_000_000, 30)]
    assert meta.locate(points, ivs.limit(0), "p").count() == 0
