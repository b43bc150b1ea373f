"""Garbage collection: which files to rewrite, what to keep, how far logs may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import decline_rate, stored_bytes
from tidelog.operators.meta import locate

MOST_FILES = 102_400


def usage(stats: DataFrame) -> DataFrame:
    """For each bucket the sizes of files that hold something, and how many hold nothing."""
    live = F.col("active_elems") > 0
    return stats.groupBy("bucket_id").agg(F.sum(F.when(live, F.col("total_size")).otherwise(0)).alias("total"), F.sum(F.when(live, F.col("active_size")).otherwise(0)).alias("active"), F.count_if(~live).alias("obsolete"))


def scored(stats: DataFrame, now: int) -> DataFrame:
    rate = decline_rate(F.col("active_size"), F.col("total_size"), F.col("active_elems"), F.col("up2"), now)
    return stats.where("active_elems > 0").withColumn("rate", rate).where("rate IS NOT NULL")


ORDER = ("rate", "up2", "active_size", "file_id")


def ranked(stats: DataFrame, now: int, most: int = MOST_FILES) -> DataFrame:
    """The first files by decline rate over all buckets (a bounded top-k), and each one's place within its bucket."""
    top = scored(stats, now).orderBy(*ORDER).limit(most)
    return top.withColumn("place", F.row_number().over(Window.partitionBy("bucket_id").orderBy(*ORDER)).cast("long"))


def wasteful(stats: DataFrame, ratio: int) -> DataFrame:
    """Buckets whose garbage is at least ratio percent, with the percentage in whole numbers."""
    share = F.expr("((total - active) * 100) DIV total")
    return usage(stats).where("total > 0").withColumn("percent", share).where(F.col("percent") >= ratio).select("bucket_id", "percent")


def batch(stats: DataFrame, now: int, target: int, ratio: int, eager: bool = True, most: int = MOST_FILES) -> DataFrame:
    """The files to rewrite in each wasteful bucket: the shortest prefix of two or more that fills target, or if eager all."""
    files = ranked(stats, now, most).join(F.broadcast(wasteful(stats, ratio).select("bucket_id")), "bucket_id", "left_semi")
    order = Window.partitionBy("bucket_id").orderBy("place")
    files = files.withColumn("filled", F.sum("active_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = files.groupBy("bucket_id").agg(F.min(F.when((F.col("filled") >= target) & (F.col("place") > 1), F.col("place"))).alias("cut"), F.max("place").alias("n"))
    until = F.coalesce("cut", F.when((F.col("n") > 1) & F.lit(eager), F.col("n")).otherwise(0))
    return files.join(cut, "bucket_id").where(F.col("place") <= until).select("bucket_id", "file_id", "place")


def kept_intervals(intervals: DataFrame, live: DataFrame) -> DataFrame:
    """Intervals that at least one live address (column addr) lies in."""
    return intervals.join(locate(live, intervals, "addr").select("file_id").distinct(), "file_id", "left_semi")


def renumbered(relocs: DataFrame, inactive: DataFrame) -> DataFrame:
    """What a rewrite keeps of each file (inactive: file_id, seq), numbered anew by address."""
    rows = relocs.join(inactive, ["file_id", "seq"], "left_anti")
    return rows.select("file_id", "addr", (F.row_number().over(Window.partitionBy("file_id").orderBy("addr")) - 1).cast("long").alias("seq"))


def apply_junk(stats: DataFrame, junk: DataFrame, intervals: DataFrame, relocs: DataFrame, inactive: DataFrame) -> DataFrame:
    """file_id, active elements and sizes, up1 and up2 of the files that garbage addresses change.

    An address that lies in no interval or table, or is inactive already, changes nothing. All of a round share its tick.
    """
    hits = locate(junk.select("addr").distinct(), intervals, "addr").join(relocs, ["file_id", "addr"]).join(inactive, ["file_id", "seq"], "left_anti")
    lost = hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(stored_bytes(F.col("raw_len"), F.col("compressed_len"))).alias("bytes"))
    tick = junk.agg(F.max("tick").alias("tick"))
    rows = stats.join(lost, "file_id").crossJoin(F.broadcast(tick))
    later = F.col("up1") < F.col("tick")
    return rows.select("file_id", (F.col("active_elems") - F.col("n")).alias("active_elems"), (F.col("active_size") - F.col("bytes")).alias("active_size"), F.when(later, F.col("tick")).otherwise(F.col("up1")).alias("up1"), F.when(later, F.col("up1")).otherwise(F.col("up2")).alias("up2"))


def wal_recycle(files: DataFrame, active: DataFrame, pending: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """gid, first and until of log files that may go: before all active and pending transactions and the last checkpoint.

    files: gid, oldest; active: gid, min_file; pending: gid, pin_file; checkpoints: gid, ckpt_file.
    """
    rows = files.join(active, "gid", "left").join(pending, "gid", "left").join(checkpoints, "gid")
    until = F.least("ckpt_file", F.coalesce("min_file", "ckpt_file"), F.coalesce("pin_file", "ckpt_file"))
    return rows.select("gid", F.col("oldest").alias("first"), until.alias("until")).where("first < until")


def abort_keys(wal: DataFrame, aborted: DataFrame) -> DataFrame:
    """The keys that aborted transactions touched."""
    return wal.where("kind = 'Update'").join(aborted, "txid", "left_semi").select("bucket", "k").distinct()
