"""Analysis and replay of the write-ahead log."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCHEMA = "gid long, file long, pos long, kind string, txid long, cmd long, bucket long, k string, v string, commit_ts long, intact boolean"
_BODY = "gid long, file long, pos long, kind string, txid long, cmd long, bucket long, k string, v string, commit_ts long"


def line(record: dict) -> str:
    """A record as a line of a log: the checksum of its JSON text, and that text."""
    body = json.dumps(record, separators=(",", ":"), sort_keys=True)
    return f"{zlib.crc32(body.encode()):08x} {body}\n"


def records(text: str) -> tuple[list[dict], bool]:
    """The records before the first damaged one, and whether that is all of them."""
    out = []
    for x in text.splitlines(keepends=True):
        if not x.endswith("\n") or x[8:9] != " " or x[:8] != f"{zlib.crc32(x[9:-1].encode()):08x}":
            return out, False
        out.append(json.loads(x[9:]))
    return out, True


def parsed(lines: DataFrame) -> DataFrame:
    """Lines of logs (column value) as records of SCHEMA; keys and values are in hex. A damaged line is not intact, and
    has fields only as far as they can be read."""
    body = F.substring("value", 10, 1 << 30)
    intact = F.lpad(F.lower(F.hex(F.crc32(body.cast("binary")))), 8, "0") == F.substring("value", 1, 8)
    return lines.select(F.from_json(body, _BODY).alias("r"), intact.alias("intact")).select("r.*", F.coalesce("intact", F.lit(False)).alias("intact"))


def readable(wal: DataFrame) -> DataFrame:
    """Records before the first damaged one of their group, over all files; the tail behind it is cut off.

    Groups are writers, of which a store has 128 at most, so what is known of each is broadcast and the log doesn't move.
    """
    first = wal.where(~F.col("intact")).groupBy("gid").agg(F.min("pos").alias("bad"))
    return wal.join(F.broadcast(first), "gid", "left").where("bad IS NULL OR pos < bad").drop("bad")


def corrupt(wal: DataFrame, truncate: bool) -> DataFrame:
    """gid and reason for each group whose log can't be recovered: files missing between others, and unless the log may be
    truncated, a damaged record."""
    missing = gaps(wal.select("gid", "file")).select("gid", F.lit("gap").alias("reason"))
    damaged = wal.where(~F.col("intact")).select("gid", F.lit("damaged").alias("reason"))
    return (missing if truncate else missing.unionByName(damaged)).distinct()


def fates(wal: DataFrame) -> DataFrame:
    """txid and fate: committed if it has a Commit record, else aborted, which also ends those in progress."""
    return wal.groupBy("txid").agg(F.when(F.max((F.col("kind") == "Commit").cast("int")) == 1, "committed").otherwise("aborted").alias("fate"))


def file_ranges(wal: DataFrame) -> DataFrame:
    return wal.groupBy("gid").agg(F.min("file").alias("oldest"), F.max("file").alias("latest"))


def gaps(files: DataFrame) -> DataFrame:
    """gid, from and to of files that are missing between those there (columns gid, file): any is corruption."""
    from pyspark.sql import Window

    after = files.distinct().withColumn("next", F.lead("file").over(Window.partitionBy("gid").orderBy("file")))
    return after.where("next > file + 1").select("gid", (F.col("file") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def redo(wal: DataFrame, frontier: DataFrame, heads: DataFrame, buckets: DataFrame) -> DataFrame:
    """Updates to apply: of committed transactions and known buckets, beyond the durable frontier, newer than what is there.

    frontier: bucket, gid, durable_file, durable (position in it); heads: bucket, k, head, head_cmd (the newest version's txid
    and command); buckets: bucket. Apply in order of (txid, cmd).
    """
    updates = wal.where("kind = 'Update'").join(fates(wal).where("fate = 'committed'").select("txid"), "txid", "left_semi").join(F.broadcast(buckets), "bucket", "left_semi")
    beyond = (F.col("file") > F.col("durable_file")) | ((F.col("file") == F.col("durable_file")) & (F.col("pos") > F.col("durable")))
    gated = updates.join(F.broadcast(frontier), ["bucket", "gid"], "left").where(F.col("durable").isNull() | beyond)
    newer = (F.col("head") < F.col("txid")) | ((F.col("head") == F.col("txid")) & (F.col("head_cmd") < F.col("cmd")))
    return gated.join(heads, ["bucket", "k"], "left").where(F.col("head").isNull() | newer).select("bucket", "gid", "k", "v", "txid", "cmd", "file", "pos")


def next_stamp(wal: DataFrame) -> DataFrame:
    return wal.agg((F.coalesce(F.max("txid"), F.lit(0)) + 1).alias("oracle"))


def finish_recycles(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files that stay after pending removals (gid, stage, from_file, to_file) are finished; again changes nothing."""
    intents = F.broadcast(states.where("stage = 'INTENT'").select(F.col("gid").alias("g"), "from_file", "to_file"))
    gone = (F.col("gid") == F.col("g")) & (F.col("file") >= F.col("from_file")) & (F.col("file") < F.col("to_file"))
    return files.join(intents, gone, "left_anti")
