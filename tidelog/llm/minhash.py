"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. One pass over the texts makes each document's shingle set, its size, a 128-bit key of the set, and a signature of HASHES
   minima. Equal sets collapse to their smallest id; what follows works on these representatives.
2. Each of TREES sorted orders lists the representatives by a label of DEPTH minima. A row's candidates are its NEAR
   predecessors in an order as far as they share any prefix: where the order is sparse, short common prefixes count, where
   it is dense, only long ones, so the depth adapts to the region. Runs of more than NEAR rows with one whole label are also
   listed as regions.
3. Candidates whose signatures could not belong to a similar pair are dropped by one bit of each minimum; the rest are
   confirmed on the full sets, the nearest ones first. Pairs that are linked through others already need no look.
4. The listed regions that still hold more than one component are gone through whole: all members outside the region's
   main component against all members of other components, in blocks. So no cap on neighbours loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, components, words

HASHES, TREES, DEPTH, NEAR = 128, 24, 5, 6
#: Members in a block of step 4 and bytes of their texts, and columns of its matrices that are held at once.
BLOCK, BLOCK_BYTES, COLUMNS = 400, 16 << 20, 8192
#: Of HASHES bits, each equal with probability (1 + J) / 2: at J = 0.8 fewer than these agree in about one pair in 10 million.
AGREE = 98
_FACTOR = common.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signature(members: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least product of a member and each factor."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 512):
        np.minimum(out, (members[start : start + 512, None] * _FACTOR).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sets_table(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), s1 and s2 (key of the set), sig (minima, big-endian) and b1, b2 (a bit of each)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column(1), 500_000):
                n, s1, s2, sigs, bits = [], [], [], [], []
                for members in words.shingle_sets(batch.column(1).slice(start, end - start), shingle):
                    n.append(len(members))
                    s1.append(members.sum(dtype=np.uint64))
                    s2.append(common.mix(members).sum(dtype=np.uint64))
                    sig = signature(members)
                    sigs.append(sig.astype(">u4").tobytes())
                    bits.append(np.packbits(sig & np.uint32(1)).view(np.int64))
                pair = np.array(bits, np.int64).reshape(-1, 2)
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                columns = [batch.column(0).slice(start, end - start), pa.array(n, pa.int64()), long(s1), long(s2), pa.array(sigs, pa.binary()), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "sig", "b1", "b2"])

    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return source.mapInArrow(common.lean(run), "id long, n long, s1 long, s2 long, sig binary, b1 long, b2 long")


def _labels(batches) -> Iterator:
    """A row for each tree and representative: the tree's number and its minima as one sortable label."""
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            rows = part.num_rows
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(rows, HASHES, 4)
            label = np.empty((rows, TREES, 1 + 4 * DEPTH), np.uint8)
            label[:, :, 0] = np.arange(TREES)
            label[:, :, 1:] = sig[:, : TREES * DEPTH].reshape(rows, TREES, 4 * DEPTH)
            offsets = np.arange(rows * TREES + 1, dtype=np.int32) * label.shape[2]
            values = pa.Array.from_buffers(pa.binary(), rows * TREES, [None, pa.py_buffer(offsets), pa.py_buffer(label)])
            take = pa.array(np.repeat(np.arange(rows), TREES))
            yield pa.RecordBatch.from_arrays([values, *(part.column(c).take(take) for c in ("rep", "b1", "b2"))], ["label", "rep", "b1", "b2"])


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of two pairs of columns agree."""
    return HASHES - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _neighbours(batches) -> Iterator:
    """Over sorted labels: pairs (a, b, rank), and members of long runs of one label (a, key; rank -1)."""
    import pyarrow as pa

    width = 1 + 4 * DEPTH
    empty = (np.zeros((0, width), np.uint8), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))
    before = empty

    def emit(label, rep, bits, old):
        cols = {"a": [], "b": [], "rank": []}

        def add(*values):
            for c, v in zip(cols, values, strict=True):
                cols[c].append(v)

        for gap in range(1, NEAR + 1):
            if len(rep) <= gap:
                break
            ok = (label[gap:, :5] == label[:-gap, :5]).all(axis=1) & (_bits(bits[gap:], bits[:-gap]) >= AGREE) & (rep[gap:] != rep[:-gap])
            ok[: max(0, old - gap)] = False  # both rows were here before
            x, y = rep[:-gap][ok], rep[gap:][ok]
            rank = np.where((label[gap:, 0][ok] < 3) & (gap == 1), 0, 1)
            add(np.minimum(x, y), np.maximum(x, y), rank)
        same = (label[1:] == label[:-1]).all(axis=1)
        run = np.concatenate([[0], np.cumsum(~same)])
        sizes = np.bincount(run)
        long = (sizes[run] > NEAR) | (run == run[-1]) | (run == 0)  # a run at either end may go on, even one of a single row
        long[:old] = False
        if long.any():
            add(rep[long], _keys(label[long]), np.full(long.sum(), -1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in cols.values()], list(cols))

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(rows, width)
        rep = batch.column("rep").to_numpy()
        bits = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("b1", "b2")], axis=1)
        old = len(before[1])
        now = tuple(np.concatenate([x, y]) for x, y in zip(before, (label, rep, bits), strict=True))
        yield emit(*now, old)
        before = tuple(x[-NEAR:] for x in now)


def _keys(label: np.ndarray) -> np.ndarray:
    state = np.zeros(len(label), np.uint64)
    for k in range(label.shape[1]):
        state = common.mix(state + label[:, k].astype(np.uint64) + np.uint64(1))
    return state.view(np.int64)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b and linked for each pair: whether 100 x intersection >= percent x union of the full sets. texts: id, text."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column("ta"), 500_000):
                part = batch.slice(start, end - start)
                linked = []
                for x, y in zip(*(words.shingle_sets(part.column(c), shingle) for c in ("ta", "tb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(common.lean(run), "a long, b long, linked boolean")


def _cross(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.where("coalesce(ca, a) <> coalesce(cb, b)").select(*pairs.columns)


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, component_id and kept of each row of df.

    A text's set is that of its distinct shingles of so many words (A-Z lower-cased, split at white space); one with fewer
    words has its whole sequence as the only member. Null texts, and texts without words, have the empty set and link with
    nothing: their component is their own id. Rows with a null id link with nothing and get a null component and kept false.
    Repeated rows each get a row, with the same component. Links between different sets are found with the probability that
    a pair's labels meet in some order (over 0.999 for a lone pair at 0.8, more above it); equal sets always link. Columns
    that aren't named are not read. An empty table gives an empty one.
    """
    spark = df.sparkSession
    common.ship(spark)
    sets = common.written(sets_table(df, shingle, id_col, text_col), "sets")
    key = ["n", "s1", "s2"]
    # written, so that the join below is one of two plain shuffles, which can be split where many sets are equal
    least = common.written(sets.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep")), "least")
    classes = sets.select("id", *key).join(least, key, "left")
    classes = common.written(classes.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "classes")
    chosen = classes.where("id = rep and n > 0").select("rep").distinct()
    reps = sets.join(chosen, sets["id"] == chosen["rep"]).select("rep", "sig", "b1", "b2").dropDuplicates(["rep", "b1", "b2"])
    labels = common.written(reps.mapInArrow(common.lean(_labels), "label binary, rep long, b1 long, b2 long"), "labels")
    ordered = labels.repartitionByRange(common.partitions(spark), "label", "rep").sortWithinPartitions("label", "rep")
    found = common.written(ordered.mapInArrow(common.lean(_neighbours), "a long, b long, rank long"), "neighbours")
    common.release(sets, labels, least)

    candidates = common.written(found.where("rank >= 0").groupBy("a", "b").agg(F.min("rank").alias("rank")), "candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).unionByName(found.where("rank < 0").select(F.col("a").alias("id"))).distinct()
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).join(wanted, "id", "left_semi").dropDuplicates()
    texts = common.written(texts.withColumn("bytes", F.octet_length("text").cast("long")), "texts")

    looked = common.written(confirmed(candidates.where("rank = 0").select("a", "b"), texts, shingle, percent), "first")
    parts = components.components(looked.where("linked"))
    rest = _cross(candidates.where("rank > 0").select("a", "b"), parts)
    more = common.written(confirmed(rest, texts, shingle, percent), "second")
    parts = _joined(parts, more)

    regions = found.where("rank < 0").select(F.col("a").alias("rep"), F.col("b").alias("key")).distinct()
    if not regions.limit(1).isEmpty():
        parts = _joined(parts, _rest(regions, parts, texts, shingle, percent))
    common.release(found, candidates, texts, looked, more)
    out = classes.join(parts, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _rest(regions: DataFrame, parts: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links a, b (linked is true) between components that share a region; see step 4.

    texts: id, text and bytes. Regions with members in common are one family. A family's members outside its main component
    are dealt in blocks of about BLOCK members or BLOCK_BYTES of text, as are all its members; each pair of blocks is one task's work, which compares the full sets by products
    of incidence matrices and gives only a spanning forest of what it finds linked.
    """
    of = regions.join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    of = common.written(of, "regions")
    mixed = of.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("rep").alias("low")).where("x <> y").select("key", "low")
    mixed = common.written(mixed, "mixed")
    members = common.written(of.join(mixed, "key").select("rep", "c", "low").distinct(), "members")
    families = components.components(members.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    members = members.select("rep", "c").distinct().join(families, F.col("rep") == F.col("node"), "left").select("rep", "c", F.coalesce("component", "rep").alias("family"))
    members = common.written(members.join(texts.groupBy(F.col("id").alias("rep")).agg(F.max("bytes").alias("bytes")), "rep"), "families")
    sizes = members.groupBy("family", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("family").agg(F.sum("size").alias("m"), F.sum("bytes").alias("b"), F.max(F.struct("size", "c", "bytes")).alias("main"))
    blocks = lambda size, held: F.greatest(F.ceil(size / BLOCK), F.when(size > 0, F.ceil(held / BLOCK_BYTES)).otherwise(0))
    sizes = sizes.select("family", F.col("main.c").alias("main"), blocks(F.col("m"), F.col("b")).alias("ny"), blocks(F.col("m") - F.col("main.size"), F.col("b") - F.col("main.bytes")).alias("nx"))
    sizes = common.written(sizes, "family-sizes")  # so that the join below is one of two plain shuffles
    dealt = members.join(sizes, "family").withColumn("h", F.xxhash64("rep"))
    x = dealt.where("c <> main").select("family", "rep", "c", F.lit(True).alias("outside"), F.expr("pmod(h, nx)").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
    y = dealt.select("family", "rep", "c", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.expr("pmod(h, ny)").alias("by"))
    blocks = x.unionByName(y).join(texts.select(F.col("id").alias("rep"), "text"), "rep")

    def run(table):
        import pyarrow as pa

        rep, c, outside = (table.column(k).to_numpy() for k in ("rep", "c", "outside"))
        sets = words.shingle_sets(table.column("text"), shingle)
        a, b = linked_blocks(sets, np.flatnonzero(outside), np.flatnonzero(~outside.astype(bool)), c, percent)
        u, v = components.stars(rep[a], rep[b])
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64()), "linked": pa.array(np.ones(len(u), bool))})

    out = common.written(blocks.select("family", "bx", "by", "rep", "c", "outside", "text").groupBy("family", "bx", "by").applyInArrow(run, "a long, b long, linked boolean"), "third")
    common.release(of, mixed, members, families, sizes)
    return out


def linked_blocks(sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray, c: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of sets, one of xs and one of ys with another c, that are similar enough."""
    if not len(xs) or not len(ys):
        return xs[:0], ys[:0]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(xs), len(ys)))
    place = np.full((2, len(sets)), -1)
    place[0, xs], place[1, ys] = np.arange(len(xs)), np.arange(len(ys))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        sides = []
        for side, n in enumerate((len(xs), len(ys))):
            row = place[side, owner[lo:hi]]
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[row >= 0], column[lo:hi][row >= 0] - start] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    size = np.array([len(s) for s in sets], np.float64)
    ok = (both > 0) & (100 * both >= percent * (size[xs][:, None] + size[ys] - both)) & (c[xs][:, None] != c[ys])
    i, j = np.nonzero(ok)
    return xs[i], ys[j]


def _joined(parts: DataFrame, looked: DataFrame) -> DataFrame:
    """The components after further links."""
    links = looked.where("linked").select("a", "b")
    if links.limit(1).isEmpty():
        return parts
    out = components.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    common.release(parts)
    return out
