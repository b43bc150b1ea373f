"""What the training-data operators share: tables, written intermediates, word and hash helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the near-duplicate contracts; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: dict[str, SparkSession] = {}
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[list[bytes], str]:
    """The tokens and the pattern that the queries use."""
    import public_tokenizers

    from tidelog.llm.byte_bpe import read_ranks

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def ship(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from wherever the driver did."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset, the checkpoint folder of the context.

    Without either, one of our own: local if all of Spark is one machine's process, else in the default file system.
    """
    if out := spark.conf.get("spark.checkpoint.dir", None):
        return out.rstrip("/")
    context = spark.sparkContext
    if (out := context._jsc.sc().getCheckpointDir()).isDefined():
        return out.get().rstrip("/")
    if not _own:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            _own.append(f"file://{tempfile.mkdtemp(prefix='tidelog-')}")
        else:
            store = spark._jsparkSession.sessionState().newHadoopConf().get("fs.defaultFS", "file:///")
            if store.startswith("file:"):
                raise ValueError("executors share no folder: set spark.checkpoint.dir")
            _own.append(f"{store.rstrip('/')}/tmp/tidelog-{uuid.uuid4().hex}")
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tidelog_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables of written() that no later result reads."""
    for df in frames:
        if (path := getattr(df, "_tidelog_path", None)) in _written:
            _delete(_written.pop(path), path)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the process does
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> F.Column:
    """The fold of the contracts: crc32 of the id's text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pieces(column, max_bytes: int = 2_000_000):
    """Slices (start, end) of a pyarrow string column with about max_bytes of text each, one row at least."""
    import pyarrow.compute as pc

    n = len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield start, end
        start = end


def lean(run):
    """A function for mapInArrow that gives unused memory back when a task ends, as a worker that waits for more would keep it."""

    def out(batches):
        yield from run(batches)
        tidy()

    return out


def tidy() -> None:
    """Give memory that this process no longer uses back to the system, where its allocators can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), for unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
