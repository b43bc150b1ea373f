"""Outcomes of inserts, updates, upserts and deletes, and conflicts between writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import too_large


def outcomes(ops: DataFrame) -> DataFrame:
    """ops with the state of the key before (live) and the outcome of each operation of a serial log of transactions.

    Each operation sets a key live or dead or leaves it; so the state before one is the last set one, which windows find: in
    its own transaction, else in those before that did not abort. An empty value is a tombstone, and size limits come before
    all else. effect says what an upsert or a put of a new key did: Insert or Replace.
    """
    large = too_large(F.col("k"), F.col("v"))
    effect = F.when(large, None).when(F.col("op") == "del", 0).when(F.col("op").isin("update", "upsert") & (F.col("v") == ""), 0)
    effect = effect.when(F.col("op") == "upsert", 1).when((F.col("op") == "put") & (F.col("v") != ""), 1)
    before = Window.partitionBy("k").orderBy("txid", "cmd").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("k", "txid").orderBy("cmd").rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.withColumn("state", effect)
    live = F.coalesce(F.last("state", True).over(own), F.last(F.when(~F.col("aborted"), F.col("state")), True).over(before), F.lit(0))
    rows = rows.withColumn("live", live)
    outcome = F.when(large, "TooLarge").when((F.col("op") == "put") & (F.col("live") == 1), "Exist").when(F.col("op").isin("update", "del") & (F.col("live") == 0), "NotFound")
    rows = rows.withColumn("outcome", outcome.otherwise("Ok"))
    wrote = (F.col("outcome") == "Ok") & (F.col("state") == 1)
    return rows.withColumn("effect", F.when(wrote & (F.col("live") == 1), "Replace").when(wrote, "Insert")).drop("state")


def versions(ops: DataFrame) -> DataFrame:
    """The versions that successful operations wrote: k, txid, cmd, gid, v, tomb, aborted, commit_ts."""
    return outcomes(ops).where("outcome = 'Ok'").select("k", "txid", "cmd", "gid", "v", (F.col("v") == "").alias("tomb"), "aborted", "commit_ts")


def without_aborted(versions: DataFrame, txns: DataFrame) -> DataFrame:
    """Versions whose transaction did not abort."""
    return versions.join(txns.where("state = 'aborted'").select("txid"), "txid", "left_anti")


def overlaps(writers: DataFrame) -> DataFrame:
    """Pairs of writers of one key of which the second began while the first ran. A superset of real conflicts.

    An interval join by key: each writer is met only by those that begin in the time slots that it covers.
    """
    slot = 256
    a = writers.select("k", F.col("txid").alias("first"), F.col("commit_ts").alias("end"), F.explode(F.sequence(F.floor(F.col("txid") / slot), F.floor(F.col("commit_ts") / slot))).alias("slot"))
    b = writers.select(F.col("k").alias("k2"), F.col("txid").alias("second"), F.floor(F.col("txid") / slot).alias("slot2"))
    met = (F.col("k") == F.col("k2")) & (F.col("slot") == F.col("slot2")) & (F.col("first") < F.col("second")) & (F.col("second") < F.col("end"))
    return a.join(b, met).select("k", "first", "second")


def first_writer_wins(writers: DataFrame) -> DataFrame:
    """k, txid and ok: whether a writer finds no winner before it that had not committed when it began.

    A loser blocks nobody, so the fate of each depends on those before. Each key's log is first cut where no writer spans: the
    first of each piece wins whatever came before, and most pieces are one writer. What is left is a fold over each piece
    with one number of state, inside the JVM; so only writers that overlap in a chain are held together.
    """
    order = Window.partitionBy("k").orderBy("txid")
    until = F.max("commit_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = writers.select("k", "txid", "commit_ts").withColumn("begins", F.when(until >= F.col("txid"), 0).otherwise(1))
    rows = rows.withColumn("piece", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = rows.groupBy("k", "piece").agg(F.sort_array(F.collect_list(F.struct("txid", "commit_ts"))).alias("all"))
    start = F.struct(F.lit(-1).cast("long").alias("held"), F.array().cast("array<long>").alias("won"))

    def step(state, x):
        wins = state["held"] < x["txid"]
        return F.struct(F.when(wins, x["commit_ts"]).otherwise(state["held"]).alias("held"), F.when(wins, F.concat(state["won"], F.array(x["txid"]))).otherwise(state["won"]).alias("won"))

    won = F.when(F.size("all") == 1, F.array(F.get("all", F.lit(0))["txid"])).otherwise(F.aggregate("all", start, step)["won"])
    found = pieces.select("k", "all", won.alias("won"))
    return found.select("k", F.explode(F.transform("all", lambda x: F.struct(x["txid"].alias("txid"), F.array_contains("won", x["txid"]).alias("ok")))).alias("x")).select("k", "x.*")
