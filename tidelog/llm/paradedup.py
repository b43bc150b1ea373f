"""Paragraphs and passages that repeat across documents.

Paragraphs are lines of LEAST_WORDS words or more. Equal ones (as sets of 5-word shingles) collapse first; of the rest, BANDS
bands of ROWS MinHash values each are joined (recall over 0.999 at 0.8), colliding paragraphs are confirmed by the exact
Jaccard similarity of their sets, and what links forms components.

A passage that is set into other text shares no paragraph, so each document is also cut by its content: of any GAP + 1
consecutive positions the least hash of the next words is an anchor, and the SPAN words from an anchor on are a unit of their
own with one band, the whole of it: units are confirmed by 96 bits of their words, so they are equal. A passage of SPAN + GAP words or more that two documents share has its first anchor
at the same place in both and so at least one unit in common. Each unit is kept where it stands first; units that touch
merge into one passage of what is kept or of what is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common, components, minhash, words

SHINGLE, PERCENT, LEAST_WORDS = 5, 80, 30
BANDS, ROWS = 10, 3
#: Words of a unit, distance of anchors, words that an anchor's hash covers.
SPAN, GAP, MARK = 32, 16, 8
_FACTOR = common.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def _lines(data: np.ndarray, begin: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First word of each line of each row, with an end; lines without words have none."""
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[begin]
    new = np.zeros(len(begin) + 1, bool)
    new[first] = True
    new[1:-1] |= line[1:] != line[:-1]
    new[-1] = True
    return np.flatnonzero(new)


def paragraph_table(df: DataFrame, least_words: int) -> DataFrame:
    """doc, of, low, high (words from and to), n, s1, s2 (the shingle set's size and key) and bands of each paragraph."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, stop in common.pieces(batch.column(2), 500_000):
                text = batch.column(2).slice(start, stop - start)
                h, first, begin, _, at = words.word_hashes(text, True)
                if not len(h):
                    continue
                edges = _lines(words._bytes(text)[0], begin, first, at)
                edges = edges if edges[0] == 0 else np.concatenate([[0], edges])
                shingles, s_at = words.shingle_hashes(h, edges, SHINGLE)
                rows = []
                docs, of = (batch.column(c).slice(start, stop - start).to_numpy(zero_copy_only=False) for c in (0, 1))
                owner = np.searchsorted(first, edges[:-1], side="right") - 1
                for k in np.flatnonzero(np.diff(edges) >= least_words).tolist():
                    members = np.unique(shingles[s_at[k] : s_at[k + 1]])
                    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
                    for s in range(0, len(members), 2048):
                        np.minimum(least, (members[s : s + 2048, None] * _FACTOR).min(axis=0), out=least)
                    band = np.arange(BANDS, dtype=np.uint64)
                    for j in range(ROWS):
                        band = common.mix(band + least.reshape(BANDS, ROWS)[:, j])
                    low = int(edges[k] - first[owner[k]])
                    rows.append((int(docs[owner[k]]), int(of[owner[k]]), low, low + int(edges[k + 1] - edges[k]), len(members), int(members.sum(dtype=np.uint64).view(np.int64)), int(common.mix(members).sum(dtype=np.uint64).view(np.int64)), band.view(np.int64)))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "of", "low", "high", "n", "s1", "s2", "bands"])

    return df.mapInArrow(common.lean(run), "doc long, of int, low int, high int, n long, s1 long, s2 long, bands array<long>")


def _slide(x: np.ndarray, size: int, fold) -> np.ndarray:
    """fold over each window of so many values."""
    done, out = 1, x
    while done * 2 <= size:
        out = fold(out[: len(out) - done], out[done:])
        done *= 2
    rest = size - done
    return fold(out[: len(out) - rest], out[rest:]) if rest else out


def anchored(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors whose SPAN words lie within their row, and hashes of these words."""
    if len(h) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    state, size, mark = h, 1, None
    while size < SPAN:
        state = common.mix(state[: len(state) - size] * np.uint64(0x9FB21C651E98DF25) + state[size:])
        size *= 2
        mark = state if size == MARK else mark
    end = np.repeat(first[1:], np.diff(first))
    mark = np.where(np.arange(len(mark)) + MARK <= end[: len(mark)], mark, np.iinfo(np.uint64).max)
    if len(mark) <= GAP:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _slide(mark, GAP + 1, np.minimum)
    least[np.arange(len(least)) + GAP >= end[: len(least)]] = 0  # windows over two rows choose nothing
    most = _slide(np.concatenate([np.zeros(GAP, np.uint64), least, np.zeros(GAP, np.uint64)]), GAP + 1, np.maximum)
    at = np.flatnonzero((most[: len(state)] == mark[: len(state)]) & (np.arange(len(state)) + SPAN <= end[: len(state)]))
    return at, state[at]


def _checks(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of the SPAN words from each place on, independent of the hash that anchored() gives."""
    state = np.zeros(len(at), np.uint64)
    for k in range(SPAN):
        state = state * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return (common.mix(state) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_table(df: DataFrame) -> DataFrame:
    """doc, of, low (first word), key and check of each anchored unit."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, stop in common.pieces(batch.column(2), 500_000):
                h, first = words.word_hashes(batch.column(2).slice(start, stop - start))
                at, key = anchored(h, first)
                check = _checks(h, at)
                row = np.searchsorted(first, at, side="right") - 1
                docs, of = (batch.column(c).slice(start, stop - start).to_numpy(zero_copy_only=False) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(docs[row].astype(np.int64)), pa.array(of[row].astype(np.int32)), pa.array((at - first[row]).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(check)], ["doc", "of", "low", "key", "check"])

    return df.mapInArrow(common.lean(run), "doc long, of int, low int, key long, check int")


def _texts(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and text (words joined by spaces) of paragraphs, given as doc, of, low, high and id."""
    listed = wanted.groupBy("doc", "of").agg(F.collect_list(F.struct("id", "low", "high")).alias("parts"))

    def run(batches) -> Iterator:
        import re

        import pyarrow as pa

        find = re.compile(common.WORD).findall
        for batch in batches:
            for text, parts in zip(batch.column("text"), batch.column("parts"), strict=True):
                w, parts = find(text.as_py()), parts.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([p["id"] for p in parts], pa.int64()), pa.array([" ".join(w[p["low"] : p["high"]]) for p in parts], pa.string())], ["id", "text"])

    out = df.join(listed, ["doc", "of"]).select("text", "parts").mapInArrow(common.lean(run), "id long, text string").dropDuplicates(["id"])
    return out.withColumn("bytes", F.octet_length("text").cast("long"))


def similar_paragraphs(df: DataFrame, least_words: int) -> DataFrame:
    """doc, of, low, high and node (equal for paragraphs of one component) of paragraphs that have a partner."""
    paras = common.written(paragraph_table(df, least_words).withColumn("id", F.xxhash64("doc", "of", "low")), "paragraphs")
    classes = common.written(paras.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "classes")
    reps = paras.join(classes.select("rep"), F.col("id") == F.col("rep"), "left_semi").select("id", "doc", "of", "low", "high", "bands").dropDuplicates(["id"])
    buckets = common.written(reps.select("id", "doc", "of", "low", "high", F.explode("bands").alias("key")), "buckets")
    stars = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub <> other").select("key", "hub")
    stars = common.written(stars, "hubs")  # joins of two plain shuffles can be split where a key is hot
    collided = common.written(buckets.join(stars, "key"), "collided")
    texts = common.written(_texts(df, collided.select("doc", "of", "low", "high", "id").distinct()), "paragraph-texts")
    pairs = collided.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    looked = common.written(minhash.confirmed(pairs, texts, SHINGLE, PERCENT), "looked")
    parts = components.components(looked.where("linked"))
    regions = collided.select(F.col("id").alias("rep"), "key")
    if not regions.limit(1).isEmpty():
        parts = minhash._joined(parts, minhash._rest(regions, parts, texts, SHINGLE, PERCENT))
    common.release(buckets, collided, texts, looked)
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("c"), "times")
    sizes = named.groupBy("c").agg(F.sum("times").alias("members")).where("members > 1").select("c")
    named = common.written(named.join(sizes, "c", "left_semi").select("n", "s1", "s2", F.col("c").alias("node")), "named")
    return paras.join(named, ["n", "s1", "s2"]).select("doc", "of", "low", "high", "node")


def shared_passages(df: DataFrame) -> DataFrame:
    """doc, of, low, high, node and kept of passages that stand in several documents; node is equal where runs share units.

    Each unit is kept where it stands first, by document and place, so every one keeps a copy whatever else its run holds.
    Kept units that touch are a passage, and so are the words of other units that no kept unit of their document covers.
    """
    units = common.written(unit_table(df), "units")
    text = F.xxhash64("doc", "of")
    shared = units.groupBy("key", "check").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("key", "check")
    shared = common.written(shared, "shared")
    # repeated rows of a document stay: what follows treats them as one, and an aggregate here would keep a hot key's rows together
    hits = units.join(shared, ["key", "check"]).select("doc", "of", "low", "key", "check")
    order = Window.partitionBy("doc", "of").orderBy("low", "key")
    begins = F.when(F.col("low") - F.lag("low").over(order) <= SPAN, 0).otherwise(1)
    hits = hits.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    hits = common.written(hits.select("doc", "of", "low", "key", "check", F.xxhash64(F.lit("run"), "doc", "of", "run").alias("id")), "hits")
    common.release(units, shared)
    place = F.struct("doc", "of", "low")
    hubs = hits.groupBy("key", "check").agg(F.min("id").alias("hub"), F.min(place).alias("first"))
    hubs = common.written(hubs, "hubs")
    placed = hits.join(hubs, ["key", "check"]).select("doc", "of", "low", "id", "hub", (place == F.col("first")).alias("kept"))
    placed = common.written(placed, "placed")
    common.release(hits, hubs)
    parts = components.components(placed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    held = F.when(F.col("kept"), F.col("low"))
    order = Window.partitionBy("doc", "of").orderBy("low")  # rows of one place are peers of a range, so each sees all of them
    before = F.max(held).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(held).over(order.rangeBetween(Window.currentRow, SPAN))
    start, end = F.greatest("low", before + SPAN), F.least(F.col("low") + SPAN, after)
    spans = placed.withColumns({"start": F.when(F.col("kept"), F.col("low")).otherwise(start), "end": F.when(F.col("kept"), F.col("low") + SPAN).otherwise(end)}).where("start < end")
    order = Window.partitionBy("doc", "of", "kept").orderBy("start", "end")
    begins = F.when(F.col("start") <= F.lag("end").over(order), 0).otherwise(1)
    spans = spans.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order))
    spans = spans.groupBy("id", "doc", "of", "kept", "span").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    return spans.join(parts, F.col("id") == F.col("node"), "left").select("doc", "of", "low", "high", F.coalesce("component", "id").alias("node"), "kept")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """id, kind (paragraph or passage), low, high (words from and to), component, kept and text_hash of what repeats across documents.

    Of paragraphs, the first member of a component by id, then place, is kept. Of passages, each unit is where it stands first,
    so a component that joins several passages keeps a copy of each. What isn't kept is what a dedup removes. What repeats
    within one document only is not returned. least_words is the size from which lines are paragraphs: shorter ones (headings,
    phrases, very short documents) count only as part of a passage; with 1, every line is compared. Null and empty texts and rows with a null id have nothing that
    repeats; repeated rows count as one document, rows with one id and different texts as several, which text_hash tells
    apart. Columns that aren't named are not read; an empty table gives an empty one.
    """
    common.ship(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc"), F.hash(df[text_col]).alias("of"), df[text_col].alias("text")).where("doc is not null and text is not null")
    paras = common.written(similar_paragraphs(docs, least_words).distinct(), "repeats")
    place = F.struct("doc", "of", "low")
    text = F.xxhash64("doc", "of")
    firsts = paras.groupBy("node").agg(F.min(place).alias("first"), F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("node", "first")
    firsts = common.written(firsts, "firsts")  # as above: else the aggregate's partitions would hold a hot node's rows together
    paras = paras.join(firsts, "node").select("doc", "of", "low", "high", "node", (place == F.col("first")).alias("kept"))
    out = paras.withColumn("kind", F.lit("paragraph")).unionByName(shared_passages(docs).withColumn("kind", F.lit("passage")))
    return out.select(F.col("doc").alias(id_col), "kind", "low", "high", F.col("node").alias("component"), "kept", F.col("of").alias("text_hash"))


def remove(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the words of found's rows that aren't kept; the white space between kept words stays."""
    common.ship(df.sparkSession)
    gone = found.where("not kept").groupBy(F.col(id_col).alias("__of"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("low", "high")).alias("__gone"))
    pattern = common.WORD

    @F.pandas_udf("string")
    def cut(texts, gone):
        import re

        out = []
        for text, parts in zip(texts, gone, strict=True):
            if text is not None and parts is not None and len(parts):
                spans = [m.span() for m in re.finditer(pattern, text)]
                drop = sorted((spans[p["low"]][0], spans[min(p["high"], len(spans)) - 1][1]) for p in parts if p["low"] < len(spans))
                kept, at = [], 0
                for a, b in drop:
                    kept.append(text[at : max(at, a)])
                    at = max(at, b)
                text = "".join(kept) + text[at:]
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = df.join(gone, (df[id_col] == F.col("__of")) & (F.hash(df[text_col]) == F.col("__hash")), "left")
    return joined.withColumn(text_col, cut(text_col, "__gone")).drop("__of", "__hash", "__gone")
