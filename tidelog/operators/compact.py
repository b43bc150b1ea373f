"""Version compaction and the merges behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact(versions: DataFrame, safe_txid: int) -> DataFrame:
    """Versions that a snapshot may still need: all above safe_txid, and below it the newest one, unless a tombstone."""
    old = F.col("txid") <= safe_txid
    order = Window.partitionBy("k", old).orderBy(F.desc("txid"), F.desc("cmd"))
    return versions.withColumn("rn", F.row_number().over(order)).where(~old | ((F.col("rn") == 1) & ~F.col("tomb"))).drop("rn")


def compact_dropping(versions: DataFrame, safe_txid: int, aborted: DataFrame) -> DataFrame:
    """compact() of what is left without the versions of these transactions (column txid)."""
    return compact(versions.join(aborted, "txid", "left_anti"), safe_txid)


def merge(delta: DataFrame, base: DataFrame) -> DataFrame:
    """Versions of both sides; one that both have comes from the delta."""
    rows = delta.withColumn("src", F.lit(1)).unionByName(base.withColumn("src", F.lit(0)))
    order = Window.partitionBy("k", "txid", "cmd").orderBy(F.desc("src"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "src")


def fold_pages(updates: DataFrame) -> DataFrame:
    """The address of each page after all updates in order: 0 takes it out, a smaller one than the current is ignored.

    Within a stretch between removals the largest address stands; so it is the maximum after the last removal. Two aggregates
    find it, which thin the updates before they move.
    """
    gone = updates.where("addr = 0").groupBy("pid").agg(F.max("seq").alias("gone"))
    after = updates.where("addr <> 0").join(gone, "pid", "left").where("gone IS NULL OR seq > gone")
    return after.groupBy("pid").agg(F.max("addr").alias("addr"))


def page_frontier(versions: DataFrame) -> DataFrame:
    """For each group the newest version that a page folds in."""
    return versions.groupBy("gid").agg(F.max("txid").alias("newest"), F.count(F.lit(1)).alias("n"))
