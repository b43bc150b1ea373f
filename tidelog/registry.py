"""Names, callables and reference SQL of the key-value queries.

Each query applies an operator of tidelog.operators to whole tables. The SQL says the same independently, on the same tables;
its common parts stand in _PARTS and a query names those it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.functions.keys import KeyRange, packed_key_bytes, too_large
from tidelog.operators import compact, dml, gc, meta, mvcc, observe, reads, wal
from tidelog.sources import adapters

S, SAFE, CUT = 80_001, 80_000, 80_000
#: Keys that are live and deleted at S.
LIVE, DEAD = "u000002", "u000010"
_QUERIES: dict[str, tuple[Callable, str | None]] = {}

_PARTS = {
    "ops": """ops AS (SELECT event_id AS seq, concat('u', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS k,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'click' THEN 'update' WHEN 'error' THEN 'del' ELSE 'upsert' END AS op,
  CASE WHEN event_type = 'error' OR event_id % 17 = 0 THEN '' ELSE props END AS v, 48 * (event_id // 3) + 1 AS txid, event_id % 3 + 1 AS cmd,
  48 * (event_id // 3) + 40 AS commit_ts, event_id // 3 % 13 = 0 AS aborted, event_id // 3 % 4 AS gid FROM events)""",
    "oc": """fx AS (SELECT *, CASE WHEN op = 'del' THEN 0 WHEN op IN ('update', 'upsert') AND v = '' THEN 0
  WHEN op = 'upsert' THEN 1 WHEN op = 'put' AND v <> '' THEN 1 END AS eff FROM ops),
st AS (SELECT *, coalesce(last_value(eff IGNORE NULLS) OVER (PARTITION BY k, txid ORDER BY cmd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  last_value(CASE WHEN NOT aborted THEN eff END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS live FROM fx),
oc AS (SELECT *, CASE WHEN op = 'put' AND live = 1 THEN 'Exist' WHEN op IN ('update', 'del') AND live = 0 THEN 'NotFound' ELSE 'Ok' END AS outcome FROM st)""",
    "ver": "ver AS (SELECT k, txid, cmd, gid, v, v = '' AS tomb, aborted, commit_ts FROM oc WHERE outcome = 'Ok')",
    "snap": f"""snap AS (SELECT k, v, txid FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY txid DESC, cmd DESC) AS rn FROM ver
  WHERE NOT aborted AND commit_ts < {S} AND txid < {S}) WHERE rn = 1 AND NOT tomb)""",
    "over": "over_ AS (SELECT user_id AS k, 16 * event_id + 1 AS txid, 16 * (event_id + event_id % 5) + 2 + event_id % 5 AS commit_ts, event_id % 4 AS gid FROM events)",
    "txns": f"""txns AS (SELECT txid, gid, CASE WHEN commit_ts >= {CUT} THEN 'active' WHEN aborted THEN 'aborted' ELSE 'committed' END AS state,
  CASE WHEN commit_ts < {CUT} AND NOT aborted THEN commit_ts END AS commit_ts, seq * 3 AS begin_pos FROM
  (SELECT event_id AS seq, event_id % 4 AS gid, 16 * event_id + 1 AS txid, 16 * (event_id + event_id % 5) + 2 + event_id % 5 AS commit_ts, event_id % 13 = 0 AS aborted FROM events) WHERE txid < {CUT})""",
    "wal": """wal AS (SELECT gid, (seq * 5 + part) // 512 AS file, seq * 5 + part AS pos, kind, txid, CASE WHEN part BETWEEN 1 AND 3 THEN cmd * 3 + part - 3 END AS cmd, k,
  CASE WHEN part < 2 THEN v ELSE v || '+' || part END AS v, seq % 3 AS bucket, NOT (gid = 2 AND seq % 2000 = 1602 AND part = 1) AS intact
  FROM (SELECT o.*, p.part, CASE WHEN p.part = 0 THEN 'Begin' WHEN p.part < 4 THEN 'Update' WHEN aborted THEN 'Abort' ELSE 'Commit' END AS kind
  FROM ops o CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS part) p WHERE CASE p.part WHEN 0 THEN cmd = 1 WHEN 4 THEN cmd = 3 ELSE p.part <= seq % 3 + 1 END)
  WHERE NOT (part = 4 AND seq // 3 % 40 = 7))""",
    "good": "good AS (SELECT w.* FROM wal w LEFT JOIN (SELECT gid, min(pos) AS bad FROM wal WHERE NOT intact GROUP BY gid) b USING (gid) WHERE bad IS NULL OR pos < bad)",
    "st": """fs AS (SELECT l_suppkey AS file_id, l_suppkey % 7 AS bucket_id, count(*) AS total_elems, count(*) FILTER (WHERE l_returnflag <> 'R') AS active_elems,
  CAST(sum(l_quantity) AS BIGINT) AS total_size, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0) AS BIGINT) AS active_size,
  max(l_linenumber) + l_suppkey AS up2, max(l_linenumber) + l_suppkey + 5 AS up1 FROM lineitem GROUP BY l_suppkey)""",
    "rank": """sc AS (SELECT *, power(CAST(active_size AS DOUBLE) / (total_size - active_size), 2) / (CAST(greatest(active_elems, 1) AS DOUBLE) * (100000 - up2)) AS rate
  FROM fs WHERE active_elems > 0 AND total_size > active_size AND up2 <> 100000),
rk AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY rate, up2, active_size, file_id) AS place,
  sum(active_size) OVER (PARTITION BY bucket_id ORDER BY rate, up2, active_size, file_id ROWS UNBOUNDED PRECEDING) AS cum FROM sc)""",
    "iv": "iv AS (SELECT o_orderkey // 100 AS file_id, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey % 10 <> 9 GROUP BY 1)",
    "rl": """rl AS (SELECT o_orderkey // 100 AS file_id, o_orderkey AS addr, o_orderkey % 100 AS seq, o_orderkey % 100 * 4096 AS off, raw AS raw_len,
  CASE WHEN raw >= 1024 AND o_orderkey % 3 = 0 THEN raw // 2 ELSE 0 END AS compressed_len FROM (SELECT *, CAST(floor(o_totalprice / 100) AS BIGINT) + 1 AS raw FROM orders WHERE o_orderkey % 10 <> 9))""",
    "pg": """up AS (SELECT l_partkey % 500 AS pid, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_orderkey END AS addr, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
gone AS (SELECT pid, max(seq) AS z FROM up WHERE addr = 0 GROUP BY pid),
pages_ AS (SELECT up.pid, max(addr) AS addr FROM up LEFT JOIN gone USING (pid) WHERE z IS NULL OR seq > z GROUP BY up.pid)""",
    "fr": "fr AS (SELECT event_id % 5 AS bucket_id, event_id % 4 AS group_id, event_id // 1000 AS file_id, event_id * 7919 % 1000 AS off FROM events)",
    "ms": "ms AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'histogram' END AS kind, concat('m_', event_type) AS metric, event_id * 31 % 997 AS value FROM events)",
    "jk": "jk AS (SELECT l_orderkey AS addr, max(l_suppkey) AS tick FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)",
}
_NEEDS = {"oc": ["ops"], "ver": ["oc"], "snap": ["ver"], "wal": ["ops"], "good": ["wal"], "rank": ["st"]}


def _sql(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    body = body if body.startswith(",") else f" {body}"
    return f"WITH {', '.join(_PARTS[n] for n in order)}{body}" if order else body.strip()


def _query(needs: str = "", sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = (f, None if sql is None else _sql(needs, sql))
        return f

    return put


def _log(spark, d):
    return adapters.ops(spark, d)


def _versions(spark, d, users=None):
    return dml.versions(adapters.ops(spark, d, users))


def _view(spark, d, snapshot=S, owner=None, users=None):
    """users: bounds of the keys' numbers, which reach the scan; see adapters.ops()."""
    return reads.View(_versions(spark, d, users), snapshot, owner)


def _number(key: str) -> int:
    return int(key.removeprefix("u"))


def _txns(spark, d):
    o = adapters.overlapping(spark, d)
    return mvcc.states(o.select("txid", "gid", "commit_ts", F.col("e").alias("seq"), (F.col("e") % 13 == 0).alias("aborted")), CUT)


def _wal(spark, d):
    return adapters.wal(_log(spark, d))


# reads


@_query("snap", "SELECT * FROM snap")
def snapshot_scan(spark, d):
    return _view(spark, d).scan()


@_query("snap", f"SELECT * FROM snap WHERE k = '{LIVE}'")
def point_get(spark, d):
    return _view(spark, d, users=(_number(LIVE),) * 2).get(LIVE)


@_query("ver", f"""SELECT v.k, v.txid, v.tomb FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY txid DESC, cmd DESC) AS rn FROM ver
  WHERE NOT aborted AND commit_ts < {S} AND txid < {S}) v WHERE rn = 1 AND tomb AND k = '{DEAD}'""")
def point_get_tombstone(spark, d):
    v = _versions(spark, d, (_number(DEAD),) * 2)
    return reads.newest(v.where((F.col("k") == DEAD) & reads.visible(S)), "k").where("tomb").select("k", "txid", "tomb")


@_query("snap", f"SELECT k, v, txid FROM snap WHERE k = '{DEAD}'")
def point_get_dead(spark, d):
    return _view(spark, d, users=(_number(DEAD),) * 2).get(DEAD)


@_query("ver", """SELECT k, v, txid FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY txid DESC, cmd DESC) AS rn FROM ver
  WHERE NOT aborted AND ((commit_ts < 80017 AND txid < 80017) OR (txid = 80017 AND gid = 3))) WHERE rn = 1 AND NOT tomb""")
def own_write_get(spark, d):
    return _view(spark, d, 80_017, owner=3).scan()


@_query("snap", "SELECT * FROM snap WHERE starts_with(k, 'u00001')")
def prefix_seek(spark, d):
    return _view(spark, d, users=(10, 19)).seek("u00001")


@_query("snap", "SELECT * FROM snap WHERE k > 'u000010' AND k <= 'u000040'")
def range_incl_excl(spark, d):
    return _view(spark, d, users=(11, 40)).range(KeyRange("u000010", "u000040", False, True))


@_query("snap", "SELECT * FROM snap WHERE k >= 'u000100'")
def range_unbounded(spark, d):
    return _view(spark, d).range(KeyRange("u000100"))


@_query("snap", "SELECT * FROM snap WHERE false")
def range_inverted(spark, d):
    return _view(spark, d).range(KeyRange("u000040", "u000010"))


@_query("snap", "SELECT *, row_number() OVER (ORDER BY k DESC) AS place FROM snap WHERE k >= 'u000010' AND k < 'u000060'")
def reverse_scan(spark, d):
    return reads.ranked(_view(spark, d, users=(10, 59)).range(KeyRange("u000010", "u000060")), reverse=True).drop("n")


@_query("snap", "SELECT *, row_number() OVER (ORDER BY k) AS place FROM snap")
def ordered_scan(spark, d):
    return reads.ranked(_view(spark, d).scan()).drop("n")


@_query("snap", "SELECT k, v, txid, least(2 * p - 1, 2 * (n - p + 1)) AS turn FROM (SELECT *, row_number() OVER (ORDER BY k) AS p, count(*) OVER () AS n FROM snap WHERE starts_with(k, 'u0000'))")
def both_ends(spark, d):
    return reads.both_ends(_view(spark, d).seek("u0000"))


@_query("ver", "SELECT k, v, txid, cmd, tomb, aborted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY txid DESC, cmd DESC) AS rn FROM ver) WHERE rn = 1")
def head_lookup(spark, d):
    return reads.heads(_versions(spark, d)).select("k", "v", "txid", "cmd", "tomb", "aborted")


@_query("ver", "SELECT k, max(txid) AS txid, arg_max(tomb, txid * 4 + cmd) AS tomb, arg_max(gid, txid) AS gid FROM ver GROUP BY k")
def head_meta(spark, d):
    return reads.heads(_versions(spark, d), value=False).select("k", "txid", "tomb", "gid")


@_query("snap", "SELECT k FROM snap")
def keys_only(spark, d):
    return _view(spark, d).keys()


@_query("ver", f"SELECT k, txid, cmd, v, tomb, row_number() OVER (ORDER BY txid DESC, cmd DESC) AS age FROM ver WHERE k = '{LIVE}' AND NOT aborted AND commit_ts < {S} AND txid < {S}")
def history_versions(spark, d):
    return reads.history(_versions(spark, d, (_number(LIVE),) * 2), LIVE, S)


@_query("ver", """SELECT s, k, v, txid FROM (SELECT s, ver.*, row_number() OVER (PARTITION BY s, k ORDER BY txid DESC, cmd DESC) AS rn FROM ver
  JOIN (SELECT unnest([20001, 80001, 140001]) AS s) ON txid < s AND commit_ts < s WHERE NOT aborted) WHERE rn = 1 AND NOT tomb""")
def multi_snapshot(spark, d):
    return reads.multi_snapshot(_versions(spark, d), spark.createDataFrame([(20_001,), (80_001,), (140_001,)], "s long"))


@_query("snap", "SELECT * FROM snap WHERE k IN (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer)")
def batched_get(spark, d):
    keys = adapters.table(spark, d, "customer").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))
    return _view(spark, d).get_many(keys)


@_query("snap", "SELECT count(*) AS n FROM snap")
def snapshot_count(spark, d):
    return _view(spark, d).count()


@_query("", "SELECT url, doc FROM (SELECT url, page_id AS doc, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1 AND url >= 'http://www.' AND url < 'http://www/'")
def url_prefix_seek(spark, d):
    pages = adapters.table(spark, d, "pages").select(F.col("url").alias("k"), F.col("page_id").alias("txid"), F.lit(1).alias("cmd"))
    return reads.newest(pages.where(KeyRange.prefix("http://www.").predicate(F.col("k"))), "k").select(F.col("k").alias("url"), F.col("txid").alias("doc"))


# operations and transactions


@_query("oc", "SELECT seq, k, op, outcome, CASE WHEN outcome = 'Ok' AND eff = 1 THEN CASE live WHEN 1 THEN 'Replace' ELSE 'Insert' END END AS effect FROM oc")
def op_outcomes(spark, d):
    return dml.outcomes(_log(spark, d)).select("seq", "k", "op", "outcome", "effect")


@_query("ver", "SELECT k, txid, cmd, gid, v, tomb, aborted, commit_ts FROM ver")
def versions_from_ops(spark, d):
    return _versions(spark, d)


@_query("txns", "SELECT * FROM txns")
def txn_states(spark, d):
    return _txns(spark, d)


@_query("ver", "SELECT k, txid, tomb FROM ver WHERE NOT aborted")
def aborted_purge(spark, d):
    log = _log(spark, d)
    txns = log.select("txid", F.when(F.col("aborted"), "aborted").otherwise("committed").alias("state"))
    return dml.without_aborted(dml.versions(log), txns).select("k", "txid", "tomb")


@_query("over", "SELECT a.k, a.txid AS first, b.txid AS second FROM over_ a JOIN over_ b ON a.k = b.k AND a.txid < b.txid AND b.txid < a.commit_ts")
def overlap_conflicts(spark, d):
    return dml.overlaps(adapters.overlapping(spark, d))


@_query("", """WITH RECURSIVE o AS (SELECT user_id AS k, 16 * event_id + 1 AS s, 16 * (event_id + event_id % 5) + 2 + event_id % 5 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT k, rn, s, c AS hc, true AS ok FROM o WHERE rn = 1 UNION ALL SELECT o.k, o.rn, o.s, CASE WHEN r.hc < o.s THEN o.c ELSE r.hc END, r.hc < o.s FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT k, s AS txid, ok FROM r""")
def first_writer_wins(spark, d):
    return dml.first_writer_wins(adapters.overlapping(spark, d))


@_query("", """WITH p AS (SELECT page_id, octet_length(encode(url)) AS n FROM pages UNION ALL SELECT -n, n FROM (SELECT unnest([115, 116, 65521, 65522]) AS n))
SELECT page_id, CAST(n + 12 + CASE WHEN n + 12 < 128 THEN 1 WHEN n + 12 < 16384 THEN 2 ELSE 3 END AS BIGINT) AS packed,
 n + 12 + CASE WHEN n + 12 < 128 THEN 1 WHEN n + 12 < 16384 THEN 2 ELSE 3 END > 65536 AS large FROM p""")
def size_guard(spark, d):
    pages = adapters.table(spark, d, "pages").select("page_id", "url", "html")
    limits = spark.createDataFrame([(-n, n) for n in (115, 116, 65_521, 65_522)], "page_id long, n int").selectExpr("page_id", "repeat('k', n) AS url", "'' AS html")
    return pages.unionByName(limits).select("page_id", packed_key_bytes(F.col("url")).alias("packed"), too_large(F.col("url"), F.col("html")).alias("large"))


@_query("", "SELECT event_id AS ticket, CAST(event_id % 16 AS INTEGER) AS home, CAST((event_id % 16 + 1 + (event_id // 16) % 15) % 16 AS INTEGER) AS other FROM events")
def two_choices(spark, d):
    home, other = scalars.two_choices(F.col("event_id"), 16)
    return adapters.table(spark, d, "events").select(F.col("event_id").alias("ticket"), home.alias("home"), other.alias("other"))


@_query("over", f"""SELECT fl AS floor, least(fl, coalesce((SELECT min(txid) FROM over_ WHERE commit_ts < {CUT} AND commit_ts >= fl), fl)) AS safe
FROM (SELECT least({CUT}, coalesce(min(txid) FILTER (WHERE txid < {CUT} AND commit_ts >= {CUT}), {CUT})) AS fl FROM over_)""")
def safe_boundary(spark, d):
    return mvcc.safe_boundary(adapters.overlapping(spark, d), CUT)


@_query("over", f"""SELECT fl AS floor, greatest(40000, least(fl, coalesce((SELECT min(txid) FROM over_ WHERE commit_ts < {CUT} AND commit_ts >= fl), fl))) AS safe
FROM (SELECT least(60001, coalesce(min(txid) FILTER (WHERE txid < {CUT} AND commit_ts >= {CUT}), 60001)) AS fl FROM over_)""")
def safe_boundary_views(spark, d):
    return mvcc.safe_boundary(adapters.overlapping(spark, d), CUT, views=(70_001, 60_001), before=40_000)


@_query("over", f"SELECT least({CUT}, coalesce(min(txid) FILTER (WHERE txid < {CUT} AND commit_ts >= {CUT}), {CUT})) AS floor, 40000 AS safe FROM over_")
def safe_boundary_registering(spark, d):
    return mvcc.safe_boundary(adapters.overlapping(spark, d), CUT, before=40_000, registering=True).withColumn("safe", F.col("safe").cast("int"))


@_query("txns", "SELECT m AS abort_floor, greatest(0, least(79905, m) - 1) AS safe_txid FROM (SELECT coalesce(min(txid), 9223372036854775807) AS m FROM txns WHERE state = 'aborted')")
def compact_safe_txid(spark, d):
    return mvcc.compact_safe_txid(79_905, _txns(spark, d))


@_query("txns", "SELECT txid, state FROM txns WHERE state <> 'committed' OR txid >= 79905")
def prune_facts(spark, d):
    return mvcc.pruned_facts(_txns(spark, d), 79_905).select("txid", "state")


@_query("txns", "SELECT gid, min(begin_pos) AS min_pos, min(begin_pos // 512) AS min_file FROM txns WHERE state = 'active' GROUP BY gid")
def active_bounds(spark, d):
    return mvcc.active_bounds(_txns(spark, d))


@_query("txns", "SELECT txid, n AS passed FROM (SELECT txid, (SELECT count(*) FROM (SELECT unnest([14900, 14950, 14991, 14996, 15001]) AS p) WHERE p > begin_pos) AS n FROM txns WHERE state = 'active') WHERE n >= 2")
def long_txn_guard(spark, d):
    marks = spark.createDataFrame([(p,) for p in (14_900, 14_950, 14_991, 14_996, 15_001)], "pos long")
    return mvcc.long_transactions(_txns(spark, d), marks, 2)


@_query("txns", "SELECT gid AS bucket, count(*) AS pending FROM txns WHERE state = 'aborted' GROUP BY gid")
def abort_task_counts(spark, d):
    return mvcc.abort_tasks_by_bucket(_txns(spark, d).where("state = 'aborted'").select(F.col("gid").alias("bucket")))


# compaction


@_query("ver", f"SELECT k, txid, cmd, tomb FROM (SELECT *, row_number() OVER (PARTITION BY k, txid <= {SAFE} ORDER BY txid DESC, cmd DESC) AS rn FROM ver) WHERE txid > {SAFE} OR (rn = 1 AND NOT tomb)")
def compact_versions(spark, d):
    return compact.compact(_versions(spark, d), SAFE).select("k", "txid", "cmd", "tomb")


@_query("ver", f"SELECT k, txid, cmd, tomb FROM (SELECT *, row_number() OVER (PARTITION BY k, txid <= {SAFE} ORDER BY txid DESC, cmd DESC) AS rn FROM ver WHERE NOT aborted) WHERE txid > {SAFE} OR (rn = 1 AND NOT tomb)")
def compact_drop_aborted(spark, d):
    log = _log(spark, d)
    return compact.compact_dropping(dml.versions(log), SAFE, log.where("aborted").select("txid")).select("k", "txid", "cmd", "tomb")


@_query("ver", "SELECT k, txid, cmd, CASE WHEN txid > 60000 THEN v || '!' ELSE v END AS v FROM ver")
def merge_delta_base(spark, d):
    v = _versions(spark, d)
    delta = v.where("txid > 60000").withColumn("v", F.concat("v", F.lit("!")))  # shows which side a version is from
    return compact.merge(delta, v.where("txid < 90000")).select("k", "txid", "cmd", "v")


@_query("", "SELECT doc_id, CASE WHEN octet_length(encode(text)) + 1 >= 4096 THEN 'blob' ELSE 'inline' END AS storage FROM documents")
def inline_vs_blob(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", scalars.storage(F.col("text")).alias("storage"))


@_query("pg", "SELECT pid, addr FROM pages_")
def page_table_fold(spark, d):
    return compact.fold_pages(adapters.page_updates(spark, d))


@_query("ver", "SELECT gid, max(txid) AS newest, count(*) AS n FROM ver GROUP BY gid")
def page_frontier(spark, d):
    return compact.page_frontier(_versions(spark, d))


# log


@_query("good", "SELECT txid, CASE WHEN count(*) FILTER (WHERE kind = 'Commit') > 0 THEN 'committed' ELSE 'aborted' END AS fate FROM good GROUP BY txid")
def wal_outcomes(spark, d):
    return wal.fates(wal.readable(_wal(spark, d)))


@_query("good", "SELECT gid, count(*) AS n, max(pos) AS last FROM good GROUP BY gid")
def wal_torn_tail(spark, d):
    return wal.readable(_wal(spark, d)).groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


@_query("wal", """SELECT gid, file + 1 AS first, nx - 1 AS last FROM (SELECT gid, file, lead(file) OVER (PARTITION BY gid ORDER BY file) AS nx
  FROM (SELECT DISTINCT gid, file FROM wal WHERE file % 7 NOT IN (3, 4))) WHERE nx > file + 1""")
def wal_gap(spark, d):
    return wal.gaps(_wal(spark, d).where("file % 7 NOT IN (3, 4)").select("gid", "file"))


@_query("wal", "SELECT gid, min(file) AS oldest, max(file) AS latest FROM wal GROUP BY gid")
def wal_file_range(spark, d):
    return wal.file_ranges(_wal(spark, d))


def _redo(spark, d):
    log = wal.readable(_wal(spark, d))
    at = [(b, g, 3000 * (b + 1) + 10 * g) for b in range(3) for g in (0, 1, 2)]
    frontier = spark.createDataFrame([(b, g, p // 512, p) for b, g, p in at], "bucket long, gid long, durable_file long, durable long")
    heads = _log(spark, d).where("seq < 4000 AND seq % 11 = 5").groupBy((F.col("seq") % 3).alias("bucket"), "k").agg(F.max(F.struct("txid", (F.col("cmd") * 3 - 2).alias("cmd"))).alias("h"))
    heads = heads.select("bucket", "k", F.col("h.txid").alias("head"), F.col("h.cmd").alias("head_cmd"))
    return wal.redo(log, frontier, heads, spark.createDataFrame([(0,), (1,)], "bucket long"))


_REDO = """, fate AS (SELECT txid FROM good WHERE kind = 'Commit' GROUP BY txid),
heads AS (SELECT seq % 3 AS bucket, k, max(txid * 16 + cmd * 3 - 2) AS head FROM ops WHERE seq < 4000 AND seq % 11 = 5 GROUP BY 1, 2),
redo AS (SELECT g.* FROM good g JOIN fate USING (txid) LEFT JOIN heads h ON h.bucket = g.bucket AND h.k = g.k
  WHERE kind = 'Update' AND g.bucket IN (0, 1) AND (g.gid = 3 OR pos > 3000 * (g.bucket + 1) + 10 * g.gid) AND (head IS NULL OR head < g.txid * 16 + g.cmd))"""
_PARTS["redo"] = _REDO.removeprefix(", ")
_NEEDS["redo"] = ["good"]


@_query("redo", "SELECT bucket, gid, k, v, txid, cmd, file, pos FROM redo")
def wal_redo_gate(spark, d):
    return _redo(spark, d)


@_query("redo", "SELECT bucket, k, v, txid, cmd, row_number() OVER (PARTITION BY bucket, k ORDER BY txid, cmd) AS step FROM redo")
def wal_redo_apply(spark, d):
    from pyspark.sql import Window

    return _redo(spark, d).select("bucket", "k", "v", "txid", "cmd", F.row_number().over(Window.partitionBy("bucket", "k").orderBy("txid", "cmd")).cast("long").alias("step"))


@_query("wal", """SELECT DISTINCT gid, reason FROM (SELECT gid, 'damaged' AS reason FROM wal WHERE NOT intact UNION ALL
  SELECT gid, 'gap' FROM (SELECT gid, file, lead(file) OVER (PARTITION BY gid ORDER BY file) AS nx FROM (SELECT DISTINCT gid, file FROM wal WHERE file % 7 <> 3 OR gid > 1)) WHERE nx > file + 1)""")
def wal_corruption(spark, d):
    return wal.corrupt(_wal(spark, d).where("file % 7 <> 3 OR gid > 1"), truncate=False)


@_query("good", "SELECT max(txid) + 1 AS oracle FROM good")
def oracle_restore(spark, d):
    return wal.next_stamp(wal.readable(_wal(spark, d)))


@_query("wal", "SELECT DISTINCT gid, file FROM wal WHERE NOT (gid = 1 AND file >= 2 AND file < 5)")
def recycle_finish(spark, d):
    states = spark.createDataFrame([(0, "DONE", 0, 9), (1, "INTENT", 2, 5), (2, "NONE", 0, 9)], "gid long, stage string, from_file long, to_file long")
    return wal.finish_recycles(_wal(spark, d).select("gid", "file").distinct(), states)


# metadata


@_query("fr", "SELECT bucket_id, group_id, max(file_id) AS file_id, arg_max(off, file_id * 1000 + off) AS off FROM fr GROUP BY 1, 2")
def frontier_merge(spark, d):
    return meta.merge_frontiers(adapters.frontiers(spark, d))


@_query("fr", "SELECT group_id, min(CASE WHEN bucket_id < 3 THEN f ELSE 6 END) AS floor_file FROM (SELECT bucket_id, group_id, max(file_id) AS f FROM fr GROUP BY 1, 2) GROUP BY 1")
def frontier_lower_bound(spark, d):
    return meta.frontier_floor(meta.merge_frontiers(adapters.frontiers(spark, d)), spark.createDataFrame([(0,), (1,), (2,)], "bucket_id long"), 6)


@_query("iv", "SELECT file_id, count(*) AS n FROM lineitem JOIN iv ON l_orderkey BETWEEN lo AND hi GROUP BY file_id")
def interval_lookup(spark, d):
    points = adapters.table(spark, d, "lineitem").select("l_orderkey")
    return meta.locate(points, adapters.intervals(spark, d), "l_orderkey").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@_query("pg iv rl", """SELECT p.pid, p.addr, r.file_id, r.off, CASE WHEN compressed_len = 0 THEN raw_len ELSE compressed_len END AS len
FROM pages_ p JOIN iv ON p.addr BETWEEN lo AND hi JOIN rl r ON r.file_id = iv.file_id AND r.addr = p.addr""")
def address_resolve(spark, d):
    return meta.resolve(compact.fold_pages(adapters.page_updates(spark, d)), adapters.intervals(spark, d), adapters.relocs(spark, d))


@_query("rl", "SELECT addr, CASE WHEN compressed_len = 0 THEN raw_len ELSE compressed_len END AS len, raw_len >= 1024 AND compressed_len + 16 < raw_len AS pays FROM rl")
def stored_len(spark, d):
    r, c = F.col("raw_len"), F.col("compressed_len")
    return adapters.relocs(spark, d).select("addr", scalars.stored_bytes(r, c).alias("len"), scalars.compresses(r, c).alias("pays"))


@_query("st", "SELECT file_id, CASE WHEN file_id % 5 = 0 THEN up1 + 1000 ELSE up2 END AS up2 FROM fs")
def conditional_update(spark, d):
    stats = adapters.file_stats(spark, d)
    changes = stats.where("file_id % 5 = 0").select("file_id", (F.col("up1") + 1000).alias("up2")).unionByName(spark.createDataFrame([(-1, 5)], "file_id long, up2 long"))
    return meta.update_existing(stats.select("file_id", "up2"), changes, "file_id", "up2")


@_query("st", "SELECT file_id FROM fs WHERE file_id % 3 = 0 AND file_id % 2 = 1")
def orphan_files(spark, d):
    files = adapters.file_stats(spark, d).select("file_id")
    return meta.orphans(files.where("file_id % 3 = 0"), files.where("file_id % 2 = 0"))


@_query("iv", """, x AS (SELECT file_id, lo, CASE WHEN file_id % 7 = 0 THEN hi + 250 ELSE hi END AS hi FROM iv)
SELECT file_id, t.file_id AS other FROM (SELECT file_id, lo, max({'hi': hi, 'file_id': file_id}) OVER (ORDER BY lo, hi, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM x) WHERE t.hi >= lo""")
def interval_overlaps(spark, d):
    rows = adapters.intervals(spark, d)
    return meta.overlapping(rows.withColumn("hi", F.when(F.col("file_id") % 7 == 0, F.col("hi") + 250).otherwise(F.col("hi"))), width=1000)


@_query("iv", """SELECT file_id, lo, CASE WHEN file_id % 5 = 1 THEN hi + 3 ELSE hi END AS hi FROM iv WHERE file_id % 5 <> 0 UNION ALL SELECT 1000000 + n, -100 * n, -100 * n + 9 FROM (SELECT unnest([1, 2]) AS n)""")
def interval_updates(spark, d):
    rows = adapters.intervals(spark, d)
    change = lambda part, seq, hi, file_id: rows.where(part).select("lo", F.lit(seq).alias("seq"), hi.alias("hi"), file_id.cast("long").alias("file_id"))
    changes = change("file_id % 5 = 0", 1, F.col("hi"), F.lit(None)).unionByName(change("file_id % 5 = 1", 1, F.col("hi"), F.lit(None))).unionByName(change("file_id % 5 = 1", 2, F.col("hi") + 3, F.col("file_id")))
    return meta.changed_intervals(rows, changes.unionByName(spark.createDataFrame([(-100 * n, 1, -100 * n + 9, 1_000_000 + n) for n in (1, 2)], "lo long, seq int, hi long, file_id long")))


# garbage collection


@_query("st", "SELECT bucket_id, CAST(sum(CASE WHEN active_elems > 0 THEN total_size ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN active_elems > 0 THEN active_size ELSE 0 END) AS BIGINT) AS active, count(*) FILTER (WHERE active_elems = 0) AS obsolete FROM fs GROUP BY bucket_id")
def gc_candidates(spark, d):
    return gc.usage(adapters.file_stats(spark, d))


@_query("rank", "SELECT bucket_id, file_id, place FROM rk")
def gc_score_rank(spark, d):
    return gc.ranked(adapters.file_stats(spark, d), 100_000).select("bucket_id", "file_id", "place")


@_query("st", "SELECT bucket_id, CAST((t - a) * 100 // t AS BIGINT) AS percent FROM (SELECT bucket_id, CAST(sum(total_size) AS BIGINT) AS t, CAST(sum(active_size) AS BIGINT) AS a FROM fs WHERE active_elems > 0 GROUP BY bucket_id) WHERE (t - a) * 100 // t >= 20")
def gc_ratio_gate(spark, d):
    return gc.wasteful(adapters.file_stats(spark, d), 20)


@_query("rank", """, u AS (SELECT bucket_id FROM fs WHERE active_elems > 0 GROUP BY bucket_id HAVING (sum(total_size) - sum(active_size)) * 100 >= 20 * sum(total_size)),
ct AS (SELECT bucket_id, min(place) FILTER (WHERE cum >= 30000 AND place > 1) AS cut, count(*) AS cnt FROM rk GROUP BY bucket_id)
SELECT bucket_id, file_id, place FROM rk JOIN ct USING (bucket_id) JOIN u USING (bucket_id) WHERE place <= coalesce(cut, CASE WHEN cnt > 1 THEN cnt ELSE 0 END)""")
def gc_batch(spark, d):
    return gc.batch(adapters.file_stats(spark, d), 100_000, 30_000, 20)


@_query("rank", """, u AS (SELECT bucket_id FROM fs WHERE active_elems > 0 GROUP BY bucket_id HAVING (sum(total_size) - sum(active_size)) * 100 >= 20 * sum(total_size)),
ct AS (SELECT bucket_id, min(place) FILTER (WHERE cum >= 11000 AND place > 1) AS cut FROM rk GROUP BY bucket_id)
SELECT bucket_id, file_id, place FROM rk JOIN ct USING (bucket_id) JOIN u USING (bucket_id) WHERE place <= cut""")
def gc_batch_lazy(spark, d):
    return gc.batch(adapters.file_stats(spark, d), 100_000, 11_000, 20, eager=False)


@_query("iv", "SELECT file_id, lo, hi FROM iv WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey BETWEEN lo AND hi AND l_quantity = 50 AND l_linenumber = 6)")
def gc_intervals(spark, d):
    live = adapters.table(spark, d, "lineitem").where("l_quantity = 50 AND l_linenumber = 6").select(F.col("l_orderkey").alias("addr"))
    return gc.kept_intervals(adapters.intervals(spark, d), live).select("file_id", "lo", "hi")


@_query("rl", "SELECT file_id, addr, row_number() OVER (PARTITION BY file_id ORDER BY addr) - 1 AS seq FROM rl WHERE seq % 4 <> 1")
def reloc_reseq(spark, d):
    rows = adapters.relocs(spark, d)
    return gc.renumbered(rows, rows.where("seq % 4 = 1").select("file_id", "seq"))


@_query("iv rl jk", """, hit AS (SELECT r.file_id, count(*) AS n, CAST(sum(CASE WHEN compressed_len = 0 THEN raw_len ELSE compressed_len END) AS BIGINT) AS b FROM jk JOIN iv ON jk.addr BETWEEN lo AND hi JOIN rl r ON r.file_id = iv.file_id AND r.addr = jk.addr WHERE r.seq % 4 <> 1 GROUP BY 1),
s AS (SELECT file_id, count(*) AS e, CAST(sum(raw_len) AS BIGINT) AS z, file_id % 50 AS up1 FROM rl GROUP BY 1)
SELECT s.file_id, e - n AS active_elems, z - b AS active_size, CASE WHEN up1 < t THEN t ELSE up1 END AS up1, CASE WHEN up1 < t THEN up1 ELSE 0 END AS up2 FROM s JOIN hit USING (file_id), (SELECT max(tick) AS t FROM jk)""")
def junk_apply(spark, d):
    rows = adapters.relocs(spark, d)
    stats = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("active_elems"), F.sum("raw_len").alias("active_size")).withColumn("up1", F.col("file_id") % 50).withColumn("up2", F.lit(0).cast("long"))
    return gc.apply_junk(stats, adapters.junk(spark, d), adapters.intervals(spark, d), rows, rows.where("seq % 4 = 1").select("file_id", "seq"))


@_query("wal txns", """, f AS (SELECT gid, min(file) AS oldest, max(file) AS ckpt_file FROM wal GROUP BY gid), a AS (SELECT gid, min(begin_pos // 512) AS m FROM txns WHERE state = 'active' GROUP BY gid)
SELECT f.gid, oldest AS first, least(ckpt_file, coalesce(m, ckpt_file), coalesce(CASE WHEN f.gid = 2 THEN 1 END, ckpt_file)) AS until FROM f LEFT JOIN a USING (gid)
WHERE oldest < least(ckpt_file, coalesce(m, ckpt_file), coalesce(CASE WHEN f.gid = 2 THEN 1 END, ckpt_file))""")
def wal_recycle(spark, d):
    ranges = wal.file_ranges(_wal(spark, d))
    pending = spark.createDataFrame([(2, 1)], "gid long, pin_file long")
    return gc.wal_recycle(ranges.select("gid", "oldest"), mvcc.active_bounds(_txns(spark, d)).select("gid", "min_file"), pending, ranges.select("gid", F.col("latest").alias("ckpt_file")))


@_query("wal", "SELECT DISTINCT bucket, k FROM wal WHERE kind = 'Update' AND txid IN (SELECT txid FROM ops WHERE aborted)")
def abort_clean_keys(spark, d):
    log = _log(spark, d)
    return gc.abort_keys(adapters.wal(log), log.where("aborted").select("txid"))


# metrics


@_query("ms", "SELECT metric, CAST(sum(value) AS BIGINT) AS total FROM ms WHERE kind = 'counter' GROUP BY metric")
def metric_counters(spark, d):
    return observe.counters(adapters.metrics(spark, d))


@_query("ms", "SELECT metric, arg_max(value, seq) AS value FROM ms WHERE kind = 'gauge' GROUP BY metric")
def metric_gauges(spark, d):
    return observe.gauges(adapters.metrics(spark, d))


@_query("ms", "SELECT metric, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, max(value) AS most FROM ms WHERE kind = 'histogram' GROUP BY metric")
def metric_hist(spark, d):
    return observe.histograms(adapters.metrics(spark, d))


@_query("ms", "SELECT * FROM ms ORDER BY seq DESC LIMIT 100")
def event_ring(spark, d):
    return observe.ring(adapters.metrics(spark, d), 100)


@_query("ms", """, names AS (SELECT * FROM (SELECT unnest(['counter', 'gauge', 'histogram']) AS kind), (SELECT unnest(['m_click', 'm_view', 'm_never']) AS metric))
SELECT kind, metric, count(value) AS n, CAST(coalesce(sum(value), 0) AS BIGINT) AS total, coalesce(max(value), 0) AS most FROM names LEFT JOIN ms USING (kind, metric) GROUP BY kind, metric""")
def metric_snapshot(spark, d):
    names = spark.createDataFrame([(k, m) for k in ("counter", "gauge", "histogram") for m in ("m_click", "m_view", "m_never")], "kind string, metric string")
    return observe.snapshot(adapters.metrics(spark, d), names)


@_query("", "SELECT event_id FROM events WHERE event_id & 63 = 0")
def sampled(spark, d):
    return adapters.table(spark, d, "events").where(scalars.sampled(F.col("event_id"))).select("event_id")


@_query("", """WITH RECURSIVE m AS (SELECT concat('m_', event_type) AS metric, event_id // 1000 AS stretch, event_id * 31 % 997 AS x, row_number() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) AS i FROM events),
r AS (SELECT metric, stretch, i, x AS a FROM m WHERE i = 1 UNION ALL SELECT m.metric, m.stretch, m.i, CASE WHEN m.x = 0 THEN r.a WHEN r.a = 0 THEN m.x WHEN m.x >= r.a THEN (r.a * 80 + m.x * 20) // 100 ELSE (r.a * 95 + m.x * 5) // 100 END
  FROM r JOIN m ON m.metric = r.metric AND m.stretch = r.stretch AND m.i = r.i + 1)
SELECT metric, stretch, arg_max(a, i) AS average FROM r GROUP BY metric, stretch""")
def ewma(spark, d):
    return observe.averages(adapters.metrics(spark, d))


@_query("", """WITH a AS (SELECT event_id, (32 + event_id % 3 * 32) * 1048576 AS pool, event_id % 4 * 4194304 AS unit, event_id * 9973 % 100000000 AS dirty,
  event_id * 7907 % 20000000 AS progress, event_id % 5 * 1000000 AS reserved, event_id % 5000 AS write FROM events),
b AS (SELECT *, least(greatest(least(unit, pool // 8), least(greatest(pool // 64, 1048576), pool)), pool) AS burst FROM a)
SELECT event_id, CAST(burst AS INTEGER) AS burst, write = 0 OR greatest(dirty - progress, 0) + reserved + greatest(least(write, pool), 1) <= CASE WHEN dirty >= pool THEN pool + burst + least(progress, burst * 3) ELSE pool END AS admitted,
  CAST(least(greatest(burst // 8, 1048576), burst) AS INTEGER) AS wake FROM b""")
def admission(spark, d):
    n = F.col("event_id")
    pool, unit, reserved = (n % 3 * 32 + 32) * (1 << 20), n % 4 * (4 << 20), n % 5 * 1_000_000
    burst = scalars.admission_burst(pool, unit)
    admitted = scalars.admitted(pool, unit, n * 9973 % 100_000_000, n * 7907 % 20_000_000, reserved, n % 5000)
    return adapters.table(spark, d, "events").select("event_id", burst.cast("int").alias("burst"), admitted.alias("admitted"), scalars.admission_wake(burst).cast("int").alias("wake"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
