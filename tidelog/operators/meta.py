"""Frontiers, intervals and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_frontiers(reports: DataFrame) -> DataFrame:
    """The furthest position of each bucket and group."""
    top = reports.groupBy("bucket_id", "group_id").agg(F.max(F.struct("file_id", "off")).alias("p"))
    return top.select("bucket_id", "group_id", "p.file_id", "p.off")


def frontier_floor(frontiers: DataFrame, pending: DataFrame, fallback: int) -> DataFrame:
    """For each group the least file over all buckets, buckets without pending work (column bucket_id) standing at fallback."""
    rows = frontiers.join(F.broadcast(pending.withColumn("waits", F.lit(True))), "bucket_id", "left")
    return rows.groupBy("group_id").agg(F.min(F.when(F.col("waits"), F.col("file_id")).otherwise(fallback)).alias("floor_file"))


def locate(points: DataFrame, intervals: DataFrame, point: str) -> DataFrame:
    """points within an interval, with its file_id; intervals don't overlap.

    An equi-join on bins of as many widths as there are sizes of intervals: one of at most 2^n addresses lies in one or two
    bins of width 2^n, and a point asks for its bin of each width that occurs (64 at most, a few in practice). A bin holds a
    handful of intervals, since those of its size don't overlap; so long and short ones side by side cost no more.
    """
    level = F.length(F.bin(F.col("hi") - F.col("lo"))).cast("int")
    sized = intervals.select("file_id", "lo", "hi", level.alias("level"))
    levels = F.broadcast(sized.agg(F.collect_set("level").alias("levels")))  # one row of 64 numbers at most
    binned = sized.select("file_id", "lo", "hi", "level", F.explode(F.expr("array_distinct(array(shiftright(lo, level), shiftright(hi, level)))")).alias("bin"))
    asked = points.crossJoin(levels).withColumn("asked_level", F.explode("levels")).drop("levels")
    asked = asked.withColumn("asked_bin", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), asked_level)"))
    met = (F.col("asked_level") == F.col("level")) & (F.col("asked_bin") == F.col("bin")) & (F.col(point) >= F.col("lo")) & (F.col(point) <= F.col("hi"))
    return asked.join(binned, met).drop("asked_level", "asked_bin", "level", "bin", "lo", "hi")


def overlapping(intervals: DataFrame, width: int = 1 << 20) -> DataFrame:
    """file_id of each interval that begins before an earlier one ends, and that one's, which is corruption: none may.

    The largest end before each start is a running maximum, taken over ranges of starts, width each, and then within them.
    """
    bins = intervals.select(F.expr(f"lo DIV {width}").alias("range"), "file_id", "lo", "hi")
    tops = bins.groupBy("range").agg(F.max(F.struct("hi", "file_id")).alias("top"))
    before = tops.withColumn("carried", F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", "carried")
    within = Window.partitionBy("range").orderBy("lo", "hi", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = bins.join(before, "range").withColumn("top", F.greatest("carried", F.max(F.struct("hi", "file_id")).over(within)))
    return rows.where("top.hi >= lo").select("file_id", F.col("top.file_id").alias("other"))


def changed_intervals(intervals: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, lo, hi after changes (lo, hi, file_id; a null file_id removes), the newest of which by seq counts.

    A change names an interval by its lo. insert adds it, update replaces it, upsert does either, remove takes it out.
    """
    last = changes.groupBy("lo").agg(F.max(F.struct("seq", "hi", "file_id")).alias("x")).select("lo", F.col("x.hi").alias("new_hi"), F.col("x.file_id").alias("new_id"), F.lit(True).alias("hit"))
    rows = intervals.join(last, "lo", "full")
    kept = rows.where("hit IS NULL OR new_id IS NOT NULL")
    return kept.select(F.coalesce("new_id", "file_id").alias("file_id"), "lo", F.coalesce("new_hi", "hi").alias("hi"))


def resolve(pages: DataFrame, intervals: DataFrame, relocs: DataFrame) -> DataFrame:
    """pid, addr, file_id, off and len of pages: address to file by interval, then to offset by the file's table."""
    from tidelog.functions.scalars import stored_bytes

    found = locate(pages, intervals, "addr").join(relocs, ["file_id", "addr"])
    return found.select("pid", "addr", "file_id", "off", stored_bytes(F.col("raw_len"), F.col("compressed_len")).alias("len"))


def update_existing(target: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """target with value replaced where changes has the key; changes of absent keys do nothing."""
    new = changes.select(key, F.col(value).alias("new"), F.lit(True).alias("hit"))
    return target.join(new, key, "left").withColumn(value, F.when(F.col("hit"), F.col("new")).otherwise(F.col(value))).drop("new", "hit")


def orphans(staged: DataFrame, published: DataFrame) -> DataFrame:
    """Staged files (file_id) that no manifest lists."""
    return staged.join(published, "file_id", "left_anti")
