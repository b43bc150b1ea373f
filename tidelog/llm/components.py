"""Connected components of an edge table: alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

#: Edges that one call of stars(), and so about one task of a first reduction, holds at once.
BLOCK = 400_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges, but the smallest of its component, with that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        for to in (u, v, label[u], label[v]):
            np.minimum.at(new, to, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forest(batches) -> Iterator:
    import pyarrow as pa

    held, rows = [], 0

    def out():
        u, v = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    # a task's batches are cut so that a block is never larger than BLOCK
    for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
        if rows + batch.num_rows > BLOCK:
            yield out()
            held, rows = [], 0
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        rows += batch.num_rows
    if rows:
        yield out()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("parents")).where("parents > 1").limit(1).isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("p")).distinct(), F.col("u") == F.col("p"), "left_semi").limit(1).isEmpty()


def _reduced(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The stars of each block of a written table, in its place, and whether there was one block only."""
    blocks = max(1, -(-edges.count() // BLOCK))
    out = common.written(edges.coalesce(blocks).mapInArrow(common.lean(_forest), "u long, v long"), "stars")
    common.release(edges)
    return out, blocks == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component: for each node of an edge, but the smallest of its component, the smallest one.

    Edges with a null end are ignored. First, blocks of at most BLOCK edges are reduced to stars, one task each; if there is
    just one block, that is all. Else large-star and small-star rounds run over what is left, until one block holds it or
    nothing changes. Minima are aggregated before they move, and joins are plain equi-joins that AQE may split, so neither
    a hub nor a giant component lands in one task. Repeated edges and loops change nothing; no edge gives an empty table.
    """
    common.ship(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now, single = _reduced(common.written(pairs, "edges"))
    while not single and not _done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = common.written(large, "large")
        least = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = common.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        common.release(now, step)
        now, single = _reduced(then)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._tidelog_path = now._tidelog_path
    return out
