"""The star-schema tables read as what a versioned store holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str, users: tuple[int, int] | None = None) -> DataFrame:
    """A serial log of transactions of three operations: seq, k, op, v, txid, cmd, commit_ts, aborted, gid.

    users: the least and largest number of the keys that are asked for; what else is there isn't read, as it changes no key.
    """
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    e = e if users is None else e.where(F.col("user_id").between(*users))
    t = F.expr("event_id DIV 3")
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "del").otherwise("upsert")
    return e.select(
        n.alias("seq"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"), op.alias("op"),
        F.when((F.col("event_type") == "error") | (n % 17 == 0), "").otherwise(F.col("props")).alias("v"),
        (t * 48 + 1).alias("txid"), (n % 3 + 1).alias("cmd"), (t * 48 + 40).alias("commit_ts"), (t % 13 == 0).alias("aborted"), (t % 4).alias("gid"),
    )


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers whose times overlap: k, txid, commit_ts, gid, e."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (n * 16 + 1).alias("txid"), ((n + n % 5) * 16 + 2 + n % 5).alias("commit_ts"), (n % 4).alias("gid"), n.alias("e"))


def wal(log: DataFrame) -> DataFrame:
    """Begin, Update and Commit or Abort records of a log: gid, file, pos, kind, txid, cmd, k, v, bucket, intact.

    An operation is one to three updates of its key, numbered through its transaction. Each fortieth transaction has no end, as
    after a crash; one late record of group 2 is torn.
    """
    first, last = F.col("cmd") == 1, F.col("cmd") == 3
    parts = F.concat(F.when(first, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(1), (F.col("seq") % 3 + 1).cast("int")), F.when(last, F.array(F.lit(4))).otherwise(F.array().cast("array<int>")))
    rows = log.select("seq", "gid", "txid", "aborted", "k", "v", F.col("cmd").alias("op_no"), F.explode(parts).alias("part"))
    rows = rows.where(f"NOT (part = 4 AND {_TXN} % 40 = 7)")
    kind = F.when(F.col("part") == 0, "Begin").when(F.col("part") < 4, "Update").when(F.col("aborted"), "Abort").otherwise("Commit")
    pos = F.col("seq") * 5 + F.col("part")
    value = F.when(F.col("part") < 2, F.col("v")).otherwise(F.concat("v", F.lit("+"), F.col("part").cast("string")))
    return rows.select(
        "gid", F.expr("(seq * 5 + part) DIV 512").alias("file"), pos.alias("pos"), kind.alias("kind"), "txid", F.when(F.col("part").between(1, 3), F.col("op_no") * 3 + F.col("part") - 3).alias("cmd"),
        "k", value.alias("v"), (F.col("seq") % 3).alias("bucket"), (~((F.col("gid") == 2) & (F.col("seq") % 2000 == 1602) & (F.col("part") == 1))).alias("intact"),
    )


#: The number of a transaction, from its operations' numbers.
_TXN = "(seq DIV 3)"


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, bucket_id, total and active elements and sizes, up1, up2."""
    live = F.col("l_returnflag") != "R"
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy(s.alias("file_id"), (s % 7).alias("bucket_id")).agg(
        F.count(F.lit(1)).alias("total_elems"), F.count_if(live).alias("active_elems"), F.sum("l_quantity").cast("long").alias("total_size"),
        F.sum(F.when(live, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("active_size"), F.max("l_linenumber").cast("long").alias("last"),
    ).select("*", (F.col("last") + F.col("file_id")).alias("up2"), (F.col("last") + F.col("file_id") + 5).alias("up1")).drop("last")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address ranges of files: file_id, lo, hi; one address in ten is in none."""
    a = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(a % 10 != 9).groupBy(F.floor(a / 100).cast("long").alias("file_id")).agg(F.min(a).alias("lo"), F.max(a).alias("hi"))


def relocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each address stands in its file: file_id, addr, seq, off, raw_len, compressed_len."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != 9)
    a, raw = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 100).cast("long") + 1
    return o.select(F.floor(a / 100).cast("long").alias("file_id"), a.alias("addr"), (a % 100).alias("seq"), (a % 100 * 4096).alias("off"), raw.alias("raw_len"), F.when((raw >= 1024) & (a % 3 == 0), F.floor(raw / 2).cast("long")).otherwise(0).cast("long").alias("compressed_len"))


def page_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, addr and seq of page-map changes; address 0 takes a page out."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("pid"), F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_orderkey")).cast("long").alias("addr"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


def junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that became garbage, with a tick."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("addr")).agg(F.max("l_suppkey").alias("tick"))


def frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of durable positions: bucket_id, group_id, file_id, off."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((n % 5).alias("bucket_id"), (n % 4).alias("group_id"), F.floor(n / 1000).cast("long").alias("file_id"), (n * 7919 % 1000).alias("off"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, kind (counter, gauge or histogram), metric, value."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "counter").when(n % 3 == 1, "gauge").otherwise("histogram")
    return table(spark, sf_dir, "events").select(n.alias("seq"), kind.alias("kind"), F.concat(F.lit("m_"), "event_type").alias("metric"), (n * 31 % 997).alias("value"))
