"""The log as a stream: transactions that end in each micro-batch, appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "gid long, file long, pos long, kind string, txid long, k string, v string, bucket long, intact boolean"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New log files of a folder, so many a batch, as back-pressure."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def endings(log: DataFrame) -> DataFrame:
    """txid, gid and fate of each transaction, once its end is read."""
    return log.where("intact AND kind IN ('Commit', 'Abort')").select("txid", "gid", F.when(F.col("kind") == "Commit", "committed").otherwise("aborted").alias("fate"))


def follow(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's endings to target, in a folder of the batch's number: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        endings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
