"""Facts about transactions and the boundaries that collection and compaction may go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEVER = (1 << 63) - 1
#: Log positions that are counted together.
SLOT = 1 << 16


def states(ops: DataFrame, upto: int) -> DataFrame:
    """Facts of all transactions begun before a time: txid, gid, state, commit_ts, begin_pos."""
    state = F.when(F.col("commit_ts") >= upto, "active").when(F.col("aborted"), "aborted").otherwise("committed")
    rows = ops.where(F.col("txid") < upto).select("txid", "gid", state.alias("state"), "commit_ts", (F.col("seq") * 3).alias("begin_pos"))
    return rows.withColumn("commit_ts", F.when(F.col("state") == "committed", F.col("commit_ts")))


def active_bounds(txns: DataFrame, file_size: int = 512) -> DataFrame:
    """For each group the least log position and file of its active transactions."""
    return txns.where("state = 'active'").groupBy("gid").agg(F.min("begin_pos").alias("min_pos"), F.min(F.floor(F.col("begin_pos") / file_size)).cast("long").alias("min_file"))


def safe_boundary(writers: DataFrame, cut: int, views: tuple[int, ...] = (), before: int = 0, registering: bool = False) -> DataFrame:
    """floor and safe: below safe, a committed version is visible to every snapshot that lives or will.

    Scalar aggregates only. While a registration is pending, the boundary stays where it was.
    """
    bound = min((cut, *views))
    floor = writers.agg(F.least(F.lit(bound), F.coalesce(F.min(F.when((F.col("txid") < cut) & (F.col("commit_ts") >= cut), F.col("txid"))), F.lit(bound))).alias("floor"))
    late = writers.where(F.col("commit_ts") < cut).join(F.broadcast(floor), F.col("commit_ts") >= F.col("floor")).agg(F.min("txid").alias("late"))
    out = floor.join(F.broadcast(late)).select("floor", F.greatest(F.lit(before), F.least("floor", F.coalesce("late", "floor"))).alias("safe"))
    return out.withColumn("safe", F.lit(before)) if registering else out


def compact_safe_txid(safe: int, txns: DataFrame) -> DataFrame:
    """The largest txid that compaction may treat as seen by all: below the boundary and below all retained aborts."""
    floor = F.coalesce(F.min(F.when(F.col("state") == "aborted", F.col("txid"))), F.lit(NEVER))
    return txns.agg(floor.alias("abort_floor")).select("abort_floor", F.greatest(F.lit(0), F.least(F.lit(safe), F.col("abort_floor")) - 1).alias("safe_txid"))


def pruned_facts(txns: DataFrame, safe: int) -> DataFrame:
    """Facts that must stay: those not committed, and those from the boundary on."""
    return txns.where((F.col("state") != "committed") | (F.col("txid") >= safe))


def long_transactions(txns: DataFrame, checkpoints: DataFrame, limit: int) -> DataFrame:
    """Active transactions past limit checkpoints (column pos), which may only be aborted.

    Both sides go into one table by position, cut into slots of SLOT positions: how many checkpoints lie in later slots is a sum
    over slots, those in the own slot are counted by a window within it.
    """
    own = txns.where("state = 'active'").select(F.col("begin_pos").alias("pos"), "txid", F.lit(0).alias("mark"))
    both = own.unionByName(checkpoints.select("pos", F.lit(None).cast("long").alias("txid"), F.lit(1).alias("mark"))).withColumn("slot", F.expr(f"pos DIV {SLOT}"))
    slots = both.groupBy("slot").agg(F.sum("mark").alias("marks"))  # a row for each stretch of the log in use
    later = slots.withColumn("later", F.coalesce(F.sum("marks").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("slot", "later")
    behind = Window.partitionBy("slot").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("here", F.coalesce(F.sum("mark").over(behind), F.lit(0))).where("txid IS NOT NULL").join(later, "slot")
    return rows.select("txid", (F.col("here") + F.col("later")).alias("passed")).where(F.col("passed") >= limit)


def abort_tasks_by_bucket(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("bucket").agg(F.count(F.lit(1)).alias("pending"))


def group_loads(tickets: DataFrame) -> DataFrame:
    """Tickets per chosen group in order of arrival."""
    return tickets.withColumn("load", F.count(F.lit(1)).over(Window.partitionBy("home").orderBy("ticket")))
