"""Embedding near-duplicates: exact threshold links by a dual traversal of cover trees.

On unit vectors cosine >= t is distance <= sqrt(2 - 2 t). Every vector goes to the nearest of a bounded number of pivots of
its own length, so a pivot's cell is a node at the top of the tree; cells of more than a chunk of rows are split by a hash.
Below, each chunk builds its own levels: nets whose radii halve, each node's centre being a member, with the true covering radius. Pairs of
cells, then of nodes, whose centres lie further apart than both covering radii and the threshold are dropped; pairs that lie
within the threshold as a whole are counted without looking at their members; the others go down a level, where at the end
single vectors meet. Nothing is approximate: the pivots' sample decides only where the work is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, components

#: Radii of the nets below a chunk's root. Above the threshold's own radius nets of high-dimensional vectors prune nothing.
RADII = (0.5, 0.25, 0.125, 0.0625)
#: The pivots are chosen from at most about so many vectors; there are at most so many of them.
SAMPLE_ROWS, MOST_PIVOTS = 2048, 512
#: Rows of a chunk, from (unless bytes bound it) and to, and bytes of its vectors; within that, an eighth of the table.
LEAST_CHUNK, MOST_CHUNK, CHUNK_BYTES = 2048, 1 << 20, 32 << 20
#: Room left for rounding when node pairs are pruned; single pairs are decided by the plain formula.
SLACK = 1e-7


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component is near 1: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def build(x: np.ndarray) -> np.ndarray:
    """For unit vectors, the row of each one's ancestor at each level of RADII; a level's nodes lie within those above."""
    n = len(x)
    out = np.zeros((n, len(RADII)), np.int32)
    groups = [np.arange(n)]
    for level, radius in enumerate(RADII):
        least, then = 1 - radius * radius / 2, []
        if level:
            out[:, level] = np.arange(n)  # single members are their own centre from here on
        for members in groups:
            rest = members
            while len(rest):
                batch = rest[:256]
                near = x[batch] @ x[batch].T >= least
                centres, free = [], np.ones(len(batch), bool)
                for i in range(len(batch)):
                    if free[i]:
                        centres.append(batch[i])
                        free &= ~near[i]
                close = x[centres] @ x[rest].T >= least
                close[np.arange(len(centres)), [int(np.flatnonzero(rest == c)[0]) for c in centres]] = True
                taken = close.any(axis=0)
                of = np.array(centres)[close.argmax(axis=0)]
                for c in centres:
                    of[rest == c] = c
                out[rest[taken], level] = of[taken]
                rest = rest[~taken]
            if len(members) > 1:
                order = members[np.argsort(out[members, level], kind="stable")]
                ends = np.flatnonzero(np.diff(out[order, level])) + 1
                then += [g for g in np.split(order, ends) if len(g) > 1]
        alone = np.ones(n, bool)
        for g in then:
            alone[g] = False
        groups = then
    return out


class Tree:
    """Nodes of every level of a chunk, the last level being the single vectors."""

    def __init__(self, x: np.ndarray, ancestors: np.ndarray):
        n = len(x)
        levels = [np.zeros(n, np.int64), *ancestors.T.astype(np.int64), np.arange(n)]
        self.order = np.lexsort(levels[::-1])
        self.x = x[self.order]
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        #: By level: first and end (of members in order), centre, covering radius.
        self.nodes = []
        for a in levels:
            a = place[a[self.order]]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            centre = a[first]
            cosine = np.einsum("ij,ij->i", self.x, self.x[a])
            far = np.sqrt(np.maximum(0, 2 - 2 * cosine))
            far[np.arange(n) == a] = 0
            self.nodes.append((first, np.append(first[1:], n), centre, np.maximum.reduceat(far, first)))
        self.depth = len(self.nodes)

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to, in the level below, of the nodes there that lie within these."""
        first, end, _, _ = self.nodes[level]
        below = self.nodes[level + 1][0]
        return np.searchsorted(below, first[node]), np.searchsorted(below, end[node])


def _products(na, ea, nb, eb):
    """All pairs of each range na..ea with nb..eb, with equal places of the arrays."""
    wide = eb - nb
    count = (ea - na) * wide
    at = np.repeat(np.arange(len(na)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return na[at] + k // wide[at], nb[at] + k % wide[at]


def dual(p: Tree, q: Tree, threshold: float, same: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Links between members of two trees: ("all", i, j) pairs of nodes as rows (from, to), ("one", i, j) single members.

    With same, p and q are one tree, each pair of members comes once, and none with itself.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))

    def split(level, a, b):
        """What to do with pairs of nodes of a level."""
        ca, ra = p.nodes[level][2][a], p.nodes[level][3][a]
        cb, rb = q.nodes[level][2][b], q.nodes[level][3][b]
        for s in range(0, len(a), 100_000):
            e = slice(s, s + 100_000)
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", p.x[ca[e]], q.x[cb[e]])))
            yield from sort_out(level, a[e], b[e], d, ra[e] + rb[e])

    def sort_out(level, a, b, d, r):
        ok = d <= r + reach + SLACK
        a, b, d, r = a[ok], b[ok], d[ok], r[ok]
        inside = d + r <= reach - SLACK if level < p.depth - 1 else np.zeros(len(a), bool)
        if same:
            inside &= a != b
        if inside.any():
            fa, ea, fb, eb = p.nodes[level][0][a[inside]], p.nodes[level][1][a[inside]], q.nodes[level][0][b[inside]], q.nodes[level][1][b[inside]]
            yield "all", np.stack([fa, ea], 1), np.stack([fb, eb], 1)
        a, b = a[~inside], b[~inside]
        if level == p.depth - 1:
            if same:
                a, b = a[a < b], b[a < b]
            yield "one", a, b
        elif len(a):
            yield "down", a, b

    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if level == p.depth:
            continue
        na, ea = p.children(level, a)
        nb, eb = q.children(level, b)
        sizes = (ea - na) * (eb - nb)
        large = sizes > 20_000
        for k in np.flatnonzero(large):
            found: dict[str, list] = {}
            for s in range(na[k], ea[k], 512):
                rows, cols = np.arange(s, min(s + 512, ea[k])), np.arange(nb[k], eb[k])
                if same and a[k] == b[k]:
                    cols = cols[cols >= rows[0]]
                cosine = p.x[p.nodes[level + 1][2][rows]] @ q.x[q.nodes[level + 1][2][cols]].T
                rp, rq = p.nodes[level + 1][3][rows], q.nodes[level + 1][3][cols]
                most = rp.max() + rq.max() + reach + SLACK if len(cols) else 0.0
                i, j = np.nonzero(cosine >= 1 - most * most / 2 - SLACK)
                if same and a[k] == b[k]:
                    up = rows[i] <= cols[j]
                    i, j = i[up], j[up]
                for kind, u, v in sort_out(level + 1, rows[i], cols[j], np.sqrt(np.maximum(0, 2 - 2 * cosine[i, j])), rp[i] + rq[j]):
                    found.setdefault(kind, []).append((u, v))
            for kind, pairs in found.items():
                u, v = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
                todo.append((level + 1, u, v)) if kind == "down" else None
                if kind != "down":
                    yield kind, u, v
        small = np.flatnonzero(~large)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes[small]) // 500_000)) + 1, [len(small)]])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            some = small[s:e]
            if not len(some):
                continue
            u, v = _products(na[some], ea[some], nb[some], eb[some])
            if same:
                keep = u <= v
                u, v = u[keep], v[keep]
            for kind, i, j in split(level + 1, u, v):
                todo.append((level + 1, i, j)) if kind == "down" else None
                if kind != "down":
                    yield kind, i, j


def links(p: Tree, q: Tree, xp, xq, wp, wq, ids_p, ids_q, threshold: float, same: bool):
    """Per member of p and q the weight it links with, and the stars of all links. xp, wp and so on are in tree order."""
    np_, nq = np.zeros(len(ids_p), np.int64), np.zeros(len(ids_q), np.int64)
    sum_p, sum_q = np.concatenate([[0], np.cumsum(wp)]), np.concatenate([[0], np.cumsum(wq)])
    heads, tails, held = [], [], 0

    def shrink():
        nonlocal heads, tails, held
        if held:
            u, v = components.stars(np.concatenate(heads), np.concatenate(tails))
            heads, tails, held = [u], [v], 0

    for kind, i, j in dual(p, q, threshold, same):
        if kind == "one":
            dot = np.einsum("ij,ij->i", xp[i], xq[j])
            cosine = dot / (np.sqrt(np.einsum("ij,ij->i", xp[i], xp[i])) * np.sqrt(np.einsum("ij,ij->i", xq[j], xq[j])))
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            np.add.at(np_, i, wq[j])
            np.add.at(nq, j, wp[i])
            heads.append(ids_p[i])
            tails.append(ids_q[j])
            held += len(i)
        else:
            for (fa, ea), (fb, eb) in zip(i.tolist(), j.tolist(), strict=True):
                np_[fa:ea] += sum_q[eb] - sum_q[fb]
                nq[fb:eb] += sum_p[ea] - sum_p[fa]
                heads += [ids_p[fa:ea], np.full(eb - fb, ids_p[fa])]
                tails += [np.full(ea - fa, ids_q[fb]), ids_q[fb:eb]]
                held += ea - fa + eb - fb
        if held > 1_000_000:
            shrink()
    shrink()
    return np_, nq, (heads[0] if heads else ids_p[:0]), (tails[0] if tails else ids_p[:0])


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n of the sample's unit vectors, each the one furthest from those before."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def threshold_links(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The id, n_links, component_id and kept of each row of df.

    Two rows link if their vectors have one length and a cosine, in doubles, of at least threshold. A null vector, one with a
    null or non-finite component and one of zeros link with nothing: 0 links, their own id as component. So do rows with a
    null id, whose component is null and kept false. Rows with equal vectors collapse to one that counts as many times; so
    repeated rows link with each other. Vectors of any magnitude are compared. Columns that aren't named are not read; an
    empty table gives an empty one. Where pivots prune nothing, as among random vectors of many dimensions, each chunk meets
    every other, so rows move once for each CHUNK_BYTES of the table.
    """
    spark = df.sparkSession
    common.ship(spark)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    fit = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("size", F.when(fit, F.size("v")))
    rows = rows.withColumns({"k1": F.when(fit, F.xxhash64("v")), "k2": F.when(fit, F.xxhash64(F.lit(7), "v"))})
    usable = rows.where("size is not null")
    classes = common.written(usable.groupBy("size", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    lengths = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()}
    if not lengths:
        common.release(classes)
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    total = sum(lengths.values())
    chunk = {size: max(1, min(MOST_CHUNK, CHUNK_BYTES // (8 * size), max(LEAST_CHUNK, -(-total // 8)))) for size in lengths}
    reps = usable.join(classes.select("rep", "weight", F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("size").alias("c3")), (F.col("id") == F.col("rep")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("size") == F.col("c3")))
    reps = reps.dropDuplicates(["rep", "k1", "k2", "size"]).select("rep", "weight", "v")
    share = min(1.0, SAMPLE_ROWS / total)
    sample = reps.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(4 * SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        sample = reps.select("v").limit(1).toArrow()
    by: dict[int, list] = {}
    for v in sample.column(0).to_pylist():
        by.setdefault(len(v), []).append(v)
    tops, after = {}, 0  # by length: the number of its first cell, and its pivots; any unit vector will do as one
    for size, n in lengths.items():
        found = unit(scaled(np.array(by[size], np.float64))) if size in by else np.eye(1, size)
        tops[size] = after, pivots(found, min(MOST_PIVOTS, max(1, n // chunk[size])))
        after += len(tops[size][1])
    kept = spark.sparkContext.broadcast(tops)

    def assign(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                mixed = batch.slice(start, 4096)
                width = pc.list_value_length(mixed.column("v")).to_numpy()
                for size in np.unique(width).tolist():
                    part = mixed.filter(pa.array(width == size))
                    x = scaled(np.array(part.column("v").flatten(), np.float64).reshape(part.num_rows, -1))
                    base, pivot = kept.value[size]
                    cosine = unit(x) @ pivot.T
                    cell = cosine.argmax(axis=1)
                    far = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(x)), cell]))
                    cell += base
                    yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("weight"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int32()), pa.array(far)], ["rep", "weight", "x", "cell", "far"])

    cells = common.written(reps.mapInArrow(common.lean(assign), "rep long, weight long, x binary, cell int, far double"), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row for each pivot
    count, far = np.zeros(after, np.int64), np.full(after, -np.inf)
    rows_of = np.concatenate([np.full(len(pivot), chunk[size]) for size, (_, pivot) in tops.items()])
    for r in sizes:
        count[r["cell"]], far[r["cell"]] = -(-r["n"] // int(rows_of[r["cell"]])), r["far"]
    base = np.concatenate([[0], np.cumsum(count)])
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    partners = []
    for first, pivot in tops.values():
        apart, own = np.sqrt(np.maximum(0, 2 - 2 * pivot @ pivot.T)), slice(first, first + len(pivot))
        for i in range(len(pivot)):
            near = first + np.flatnonzero((apart[i] <= far[first + i] + far[own] + reach + SLACK) & (count[own] > 0))
            partners.append(np.concatenate([np.arange(base[j], base[j + 1]) for j in near] or [np.zeros(0, np.int64)]))
    plan = spark.sparkContext.broadcast(partners)  # chunk numbers by cell
    number = F.element_at(F.array(*[F.lit(int(c)) for c in count]), F.col("cell") + 1)
    first = F.element_at(F.array(*[F.lit(int(b)) for b in base[:-1]]), F.col("cell") + 1)
    chunks = cells.withColumn("chunk", (first + F.pmod(F.xxhash64("rep"), number)).cast("int"))

    def plant(table):
        import pyarrow as pa

        ancestors = build(unit(_matrix(table.column("x"))))
        table = table.append_column("at", pa.array(np.arange(table.num_rows), pa.int32()))
        return table.append_column("up", pa.array([r.tobytes() for r in ancestors], pa.binary())).select(["rep", "weight", "x", "cell", "chunk", "at", "up"])

    grown = chunks.select("rep", "weight", "x", "cell", "chunk").groupBy("chunk").applyInArrow(plant, "rep long, weight long, x binary, cell int, chunk int, at int, up binary")
    trees = common.written(grown, "trees")

    def deal(batches) -> Iterator:
        import pyarrow as pa

        partners = plan.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                own, cell = part.column("chunk").to_numpy(), part.column("cell").to_numpy()
                to = [partners[c] for c in cell]
                at = np.repeat(np.arange(len(own)), [len(t) for t in to])
                other = np.concatenate(to)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[at], other), pa.int32()), pa.array(np.maximum(own[at], other), pa.int32()), *(part.column(c).take(pa.array(at)) for c in ("rep", "weight", "x", "chunk", "at", "up"))], ["p", "q", "rep", "weight", "x", "chunk", "at", "up"])

    def meet(key, table):
        import pyarrow as pa

        sides = []
        for c in dict.fromkeys(k.as_py() for k in key):
            side = table.filter(pa.array(table.column("chunk").to_numpy() == c)).sort_by("at")
            if side.num_rows:
                x = _matrix(side.column("x"))
                up = np.frombuffer(b"".join(side.column("up").to_pylist()), np.int32).reshape(len(x), -1)
                tree = Tree(unit(x), up)
                ids, weight = (side.column(k).to_numpy()[tree.order] for k in ("rep", "weight"))
                sides.append((tree, x[tree.order], weight, ids))
        if key[0] != key[1] and len(sides) < 2:
            sides = []
        out_ids, out_n, out_low = [], [], []
        if sides:
            (a, xa, wa, ia), (b, xb, wb, ib) = sides[0], sides[-1]
            na, nb, u, v = links(a, b, xa, xb, wa, wb, ia, ib, threshold, len(sides) == 1)
            low = dict(zip(u.tolist(), v.tolist(), strict=True))
            totals = [(ia, na + nb)] if len(sides) == 1 else [(ia, na), (ib, nb)]
            for ids, n in totals:
                ids, n = ids[n > 0], n[n > 0]
                out_ids.append(ids)
                out_n.append(n)
                out_low.append(np.array([low.get(i, i) for i in ids.tolist()], np.int64))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"id": cat(out_ids), "n": cat(out_n), "low": cat(out_low)})

    met = trees.mapInArrow(common.lean(deal), "p int, q int, rep long, weight long, x binary, chunk int, at int, up binary").groupBy("p", "q").applyInArrow(meet, "id long, n long, low long")
    met = common.written(met, "met")
    parts = components.components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    common.release(cells, trees)
    linked = met.groupBy("id").agg(F.sum("n").alias("n")).join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").alias("rep"), "n", "component")
    found = classes.join(linked, "rep", "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("size").alias("c3"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(found, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("size") == F.col("c3")), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
low AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(low.c, e.vec_id) AS component_id, coalesce(low.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.id = e.vec_id
"""
