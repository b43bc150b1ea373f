"""Snapshot reads. Visibility first, then the newest version of each key, then tombstones go: in any other order deleted keys
would come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import KeyRange


def visible(snapshot, owner: int | None = None) -> Column:
    """Whether a version is seen at a snapshot: committed before it began, or its own group's write under its own stamp."""
    s = snapshot if isinstance(snapshot, Column) else F.lit(snapshot)
    committed = (F.col("txid") < s) & ~F.col("aborted") & (F.col("commit_ts") < s)
    return committed if owner is None else committed | ((F.col("txid") == s) & (F.col("gid") == owner) & ~F.col("aborted"))


def newest(versions: DataFrame, *keys: str) -> DataFrame:
    """The newest version by (txid, cmd) of each key; a window group limit thins each partition before the exchange."""
    order = Window.partitionBy(*keys).orderBy(F.desc("txid"), F.desc("cmd"))
    return versions.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def heads(versions: DataFrame, value: bool = True) -> DataFrame:
    """The absolute newest version of each key, whatever its fate; without value that column is not even read."""
    columns = ["k", "txid", "cmd", "gid", "tomb", "aborted", *(["v"] if value else [])]
    return newest(versions.select(*columns), "k")


class View:
    """Reads at one snapshot, as lazy frames. owner: the writer group whose own writes under this stamp are seen."""

    def __init__(self, versions: DataFrame, snapshot: int, owner: int | None = None):
        self.versions, self.snapshot, self.owner = versions, snapshot, owner

    def scan(self, where: Column | None = None) -> DataFrame:
        """k, v and txid of the live keys."""
        rows = self.versions if where is None else self.versions.where(where)
        return newest(rows.where(visible(self.snapshot, self.owner)), "k").where(~F.col("tomb")).select("k", "v", "txid")

    def get(self, key) -> DataFrame:
        return self.scan(F.col("k") == F.lit(key))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The live ones of a frame of keys (column k): versions are thinned by a semi-join before they are ranked."""
        rows = self.versions.join(keys.select("k").distinct(), "k", "left_semi")
        return View(rows, self.snapshot, self.owner).scan()

    def seek(self, prefix) -> DataFrame:
        return self.scan(KeyRange.prefix(prefix).predicate(F.col("k")))

    def range(self, bounds: KeyRange) -> DataFrame:
        return self.scan(bounds.predicate(F.col("k")))

    def keys(self) -> DataFrame:
        return newest(self.versions.select("k", "txid", "cmd", "gid", "tomb", "aborted", "commit_ts").where(visible(self.snapshot, self.owner)), "k").where(~F.col("tomb")).select("k")

    def count(self) -> DataFrame:
        return self.keys().agg(F.count(F.lit(1)).alias("n"))

    def ordered(self, bounds: KeyRange = KeyRange(), reverse: bool = False) -> DataFrame:  # noqa: B008
        """The range in key order, by a distributed sort."""
        return self.range(bounds).orderBy(F.desc("k") if reverse else F.asc("k"))


#: Ranges of keys that are numbered side by side, and keys of the sample that sets their bounds.
RANGES, SAMPLE = 64, 4096


def ranked(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """rows with their place in key order, and n, how many there are.

    Keys are cut into at most RANGES ranges at bounds from a sample of SAMPLE keys (which only sets who does what); each range
    is numbered by itself, and the ranges' sizes, a small table, are broadcast as what stands before each.
    """
    sample = sorted(r["k"] for r in rows.select("k").distinct().orderBy(F.xxhash64("k")).limit(SAMPLE).collect())
    bounds = sorted({sample[len(sample) * i // RANGES] for i in range(1, RANGES)}) if sample else []
    part = F.lit(0)
    for i, bound in enumerate(bounds, 1):
        part = F.when(F.col("k") >= F.lit(bound), i) if i == 1 else F.when(F.col("k") >= F.lit(bound), i).otherwise(part)
    part = F.coalesce(part, F.lit(0)) * (-1 if reverse else 1)
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    all_sizes = sizes.agg(F.collect_list(F.struct("part", "size")).alias("sizes"))  # RANGES entries at most
    order = Window.partitionBy("part").orderBy(F.desc("k") if reverse else F.asc("k"))
    numbered = rows.withColumn("place", F.row_number().over(order).cast("long")).crossJoin(F.broadcast(all_sizes))
    add = lambda use: F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + F.when(use(x), x["size"]).otherwise(0))
    return numbered.withColumn("place", F.col("place") + add(lambda x: x["part"] < F.col("part"))).withColumn("n", add(lambda x: F.lit(True))).drop("part", "sizes")


def both_ends(rows: DataFrame) -> DataFrame:
    """The order in which a range is used up that is taken in turns from its front and its back."""
    n = ranked(rows)
    front = F.col("place") * 2 - 1
    back = (F.col("n") - F.col("place") + 1) * 2
    return n.withColumn("turn", F.least(front, back)).drop("n", "place")


def multi_snapshot(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Live keys at each of a few snapshots (column s). Each version meets only snapshots after its commit."""
    rows = versions.where(~F.col("aborted")).join(F.broadcast(snapshots), (F.col("txid") < F.col("s")) & (F.col("commit_ts") < F.col("s")))
    return newest(rows, "s", "k").where(~F.col("tomb")).select("s", "k", "v", "txid")


def history(versions: DataFrame, key, snapshot: int) -> DataFrame:
    """All versions of a key that a snapshot could see, newest first by rank."""
    rows = versions.where((F.col("k") == F.lit(key)) & visible(snapshot))
    return rows.select("k", "txid", "cmd", "v", "tomb", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("txid"), F.desc("cmd"))).cast("long").alias("age"))
