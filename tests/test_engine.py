import random

import pytest

from tidelog.functions.keys import KeyRange
from tidelog.operators import wal
from tidelog.plans import engine as e
from tidelog.sources import adapters
from tidelog.streaming import tail


@pytest.fixture
def store(spark, tmp_path):
    return e.Engine(spark, f"file://{tmp_path}/store")


def pairs(df):
    return sorted((bytes(r.k), bytes(r.v)) for r in df.collect())


def test_outcomes_conflicts_and_snapshots(store):
    b = store.new_bucket("b")
    t = b.begin()
    t.put(b"k1", b"10")
    t.put(b"k2", b"20")
    with pytest.raises(e.Exist):
        t.put(b"k1", b"x")
    with pytest.raises(e.NotFound):
        t.update(b"none", b"x")
    assert t.get(b"k1") == b"10"
    t.commit()
    old = b.view()
    t1, t2 = b.begin(), b.begin()
    t1.update(b"k1", b"11")
    with pytest.raises(e.AbortTx):
        t2.update(b"k1", b"12")
    t2.update(b"k2", b"22")  # the transaction goes on after a conflict
    t1.commit()
    with pytest.raises(e.AbortTx):
        t2.upsert(b"k1", b"13")
    t2.commit()
    assert pairs(old.scan()) == [(b"k1", b"10"), (b"k2", b"20")]
    assert pairs(b.view().scan()) == [(b"k1", b"11"), (b"k2", b"22")]
    with b.begin() as t:
        t.delete(b"k1")
        with pytest.raises(e.NotFound):
            t.get(b"k1")
        assert pairs(t.seek(b"k")) == [(b"k2", b"22")]
    assert pairs(b.view().range(KeyRange(b"k1", b"k2"))) == [(b"k1", b"11")]  # dropped, so aborted
    with pytest.raises(e.TooLarge):
        b.begin().put(b"x" * 65_522, b"")


def test_catalog_reopen_and_orphans(spark, store, tmp_path):
    b = store.new_bucket("b", e.BucketOptions(inline_size=1))
    assert b.bucket_options.inline_size == 4096 and b.options.concurrent_write == 16
    for name, error in (("b", e.Exist), ("x" * 32, e.TooLarge)):
        with pytest.raises(error):
            store.new_bucket(name)
    with pytest.raises(e.Again):
        store.update_bucket_opt("b", e.BucketOptions())
    store.drop_bucket("b")
    with pytest.raises(e.Invalid):
        store.update_bucket_opt("b", e.BucketOptions(split_elems=64))
    store.update_bucket_opt("b", e.BucketOptions(cache_evict_pct=99))
    b = store.get_bucket("b")
    assert b.bucket_options.cache_evict_pct == 80
    b.load(spark.range(200).selectExpr("cast(format_string('%08d', id) as binary) AS k", "cast(id as string) AS v"))
    other = store.new_bucket("other")
    store.del_bucket("other")
    assert store.active_buckets == ["b"] and store.nr_buckets == 2 and other.name == "other"
    with pytest.raises(e.NotFound):
        store.get_bucket("other")
    store.start_gc()
    assert store.nr_buckets == 1
    orphan = tmp_path / "store" / "bucket_id=0" / "batch-left"
    orphan.mkdir()
    again = e.Engine(spark, f"file://{tmp_path}/store")
    assert not orphan.exists() and again.get_bucket("b").view().count().first().n == 200
    again.compact_meta()
    with pytest.raises(e.Invalid):
        e.Engine(spark, f"file://{tmp_path}/store", e.Options(concurrent_write=3))
    (last,) = (tmp_path / "store").glob("manifest-*")
    last.write_text("{")
    (tmp_path / "store" / f".{last.name}.crc").unlink(missing_ok=True)
    with pytest.raises(e.Corruption):
        e.Engine(spark, f"file://{tmp_path}/store")


def test_random_transactions_against_a_dict(store):
    rng, model = random.Random(7), {}
    b = store.new_bucket("b")
    for step in range(14):
        t, mine = b.begin(), dict(model)
        for _ in range(3):
            key, value = b"k%d" % rng.randrange(5), rng.choice([b"", b"a", b"bb"])
            op = rng.choice(["put", "update", "upsert", "delete"])
            try:
                getattr(t, op)(*([key] if op == "delete" else [key, value]))
                mine[key] = b"" if op == "delete" else value
            except (e.Exist, e.NotFound):
                live = mine.get(key, b"") != b""
                assert live if op == "put" else not live
        if rng.random() < 0.7:
            t.commit()
            model = mine
        else:
            t.rollback()
        if step == 9:
            b.compact()
        assert pairs(b.view().scan()) == sorted((k, v) for k, v in model.items() if v)


def test_a_failed_publish_leaves_the_old_state(store, monkeypatch):
    b = store.new_bucket("b")
    t = b.begin()
    t.put(b"a", b"1")
    monkeypatch.setattr(store.files, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        t.commit()
    assert pairs(b.view().scan()) == []


def test_log_as_a_stream(spark, tmp_path):
    log = adapters.wal(adapters.ops(spark, "/root/testdata/sf0.001"))
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    for _ in range(2):  # the second run finds nothing new
        tail.follow(tail.read(spark, f"{tmp_path}/log", 1), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = {(r.txid, r.fate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    ended = log.where("kind IN ('Commit', 'Abort') AND intact").select("txid")
    assert got == {(r.txid, r.fate) for r in wal.fates(log).join(ended, "txid", "left_semi").collect()}


def rows_of(spark, n, tag):
    return spark.range(n).selectExpr("cast(format_string('%04d', id) as binary) AS k", f"cast(concat('{tag}', id) as string) AS v")


def test_snapshots_outlive_compaction_and_gc(spark, store):
    b = store.new_bucket("b")
    b.load(rows_of(spark, 50, "a"))
    old, frame = b.view(), b.view().scan()  # a frame alone holds its snapshot too
    t = b.begin()
    rows = b.view().iterate()
    first = next(rows)
    with b.begin() as w:
        w.update(b"0001", b"new")
        w.delete(b"0002")
        w.commit()
    for step in (b.compact, store.start_gc, b.checkpoint, b.compact):
        step()
        assert dict(pairs(old.scan()))[b"0001"] == b"a1" and len(pairs(frame)) == 50
        assert t.get(b"0001") == b"a1" and t.get(b"0002") == b"a2"
    assert bytes(first.k) == b"0000" and [bytes(r.v) for r in rows][:2] == [b"a1", b"a2"]
    with pytest.raises(e.AbortTx):
        t.update(b"0001", b"late")
    t.rollback()
    old.close()
    del frame, rows
    b.compact()
    assert store.files_removed and not store.pins
    assert dict(pairs(b.view().scan()))[b"0001"] == b"new" and b.versions().count() == 49


def test_the_log_is_replayed_at_open(spark, store, tmp_path):
    b, other = store.new_bucket("b"), store.new_bucket("other")
    for i in range(6):
        with b.begin() as t:
            t.upsert(b"k%d" % (i % 3), b"v%d" % i)
            t.upsert(b"same", b"%d" % i)
            t.upsert(b"same", b"%d again" % i)
            t.commit()
        if i == 2:
            b.checkpoint()
    with other.begin() as t:
        t.put(b"x", b"y")
        t.commit()
    want, oracle = pairs(b.view().scan()), store.oracle
    log = store.log_frame()
    assert log.where("not intact").count() == 0 and log.where("kind = 'Commit'").count() == 7
    assert [tuple(r) for r in wal.next_stamp(log).collect()][0][0] <= oracle
    again = e.Engine(spark, f"file://{tmp_path}/store")
    assert pairs(again.get_bucket("b").view().scan()) == want and pairs(again.get_bucket("other").view().scan()) == [(b"x", b"y")]
    assert again.oracle == oracle and len(again.buckets["b"].held) == 6
    with pytest.raises(e.Again), b.begin() as t:  # the first engine may not write any more
        t.upsert(b"k0", b"lost")
        t.commit()
    with again.get_bucket("b").begin() as t:
        with pytest.raises(e.Exist):
            t.put(b"k1", b"x")
        t.update(b"k1", b"next")
        t.commit()
    assert dict(pairs(again.get_bucket("b").view().scan()))[b"k1"] == b"next"


def test_damaged_and_missing_parts_of_the_log(spark, tmp_path):
    root = tmp_path / "s"
    store = e.Engine(spark, f"file://{root}", e.Options(concurrent_write=1, wal_file_size=400))
    b = store.new_bucket("b")
    for i in range(8):
        with b.begin() as t:
            t.put(b"k%d" % i, b"v" * 20)
            t.commit()
    parts = sorted(p for p in (root / "wal" / "gid=0").glob("*.log"))
    assert len({p.name[:8] for p in parts}) > 2

    def open_again(**options):
        for c in root.rglob(".*.crc"):
            c.unlink()
        return e.Engine(spark, f"file://{root}", e.Options(concurrent_write=1, wal_file_size=400, **options))

    whole = parts[-1].read_text()
    parts[-1].write_text(whole[:-9])
    with pytest.raises(e.Corruption):
        open_again(truncate_corrupted_wal=False)
    store = open_again()
    assert store.get_bucket("b").view().count().first().n == 7
    with store.get_bucket("b").begin() as t:  # goes on behind the cut
        t.put(b"k9", b"x")
        t.commit()
    store = open_again()
    assert store.get_bucket("b").view().count().first().n == 8
    lost = parts[2].read_text()
    parts[2].unlink()
    with pytest.raises(e.Corruption):
        open_again()
    parts[2].write_text(lost)
    store = open_again()
    store.get_bucket("b").checkpoint()
    assert store.log_parts_removed and store.get_bucket("b").view().count().first().n == 8
    assert open_again().get_bucket("b").view().count().first().n == 8


def test_merging_small_batches(spark, store):
    b = store.new_bucket("b")
    for tag in "abcd":
        b.load(spark.range(20).selectExpr(f"cast(concat('{tag}', id) as binary) AS k", "cast(id as string) AS v"))
    assert len(store.buckets["b"].files) == 4 and b.merge_small(3) == 3
    assert len(store.buckets["b"].files) == 2 and b.view().count().first().n == 80
