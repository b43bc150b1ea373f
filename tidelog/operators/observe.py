"""Metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import ewma


def counters(samples: DataFrame) -> DataFrame:
    return samples.where("kind = 'counter'").groupBy("metric").agg(F.sum("value").alias("total"))


def gauges(samples: DataFrame) -> DataFrame:
    return samples.where("kind = 'gauge'").groupBy("metric").agg(F.max_by("value", "seq").alias("value"))


def histograms(samples: DataFrame) -> DataFrame:
    return samples.where("kind = 'histogram'").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def ring(events: DataFrame, size: int) -> DataFrame:
    """The last events by seq, one at least."""
    return events.orderBy(F.desc("seq")).limit(max(1, size))


def snapshot(samples: DataFrame, names: DataFrame) -> DataFrame:
    """Every metric of names (kind, metric) with count, sum and maximum, 0 where nothing was recorded."""
    rows = samples.groupBy("kind", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(names).join(rows, ["kind", "metric"], "left").select("kind", "metric", zero("n"), zero("total"), zero("most"))


def averages(samples: DataFrame, window: int = 1000) -> DataFrame:
    """metric, stretch and the moving average over the samples of each stretch of so many sequence numbers."""
    rows = samples.groupBy("metric", F.floor(F.col("seq") / window).cast("long").alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("s"))
    return rows.select("metric", "stretch", ewma(F.col("s.value")).alias("average"))


def running(samples: DataFrame) -> DataFrame:
    return samples.withColumn("so_far", F.sum("value").over(Window.partitionBy("metric").orderBy("seq")))
