"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to BUCKETS and counted over passages of all documents, which gives their inverse document frequency.
2. A randomised SVD of TF-IDF passages gives the latent space: A'A applied to a random matrix, each partition adding up its
   passages' part, determines the leading part of A'A in one pass. It is fitted on all passages, so a word of any source has
   its place in it.
3. Windows of every document, of sizes that fit the items and a few words apart, are candidates for the items whose cosine
   in the latent space is at least COSINE. So are the places that share GRAM consecutive words with an item, whatever their
   cosine: words too rare to weigh in the leading directions hide no verbatim passage. Those around which too few of the
   item's words occur at all to reach step 4's shares, whatever their order, go at once; that drops nothing that step 4 would
   keep.
4. A candidate's words around the windows are held against the item's: the longest common subsequence must cover LCS of the
   item, within any stretch of at most twice its length, and ANSWER of the item's rarest words (what its answer hangs on) must
   be there. So reworded copies are found, and texts that only share a language or a phrase are not. Of items of fewer than
   LEAST_WORDS words all must stand in a row; items of more than MOST_WORDS are looked for in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, words

BUCKETS, RANK = 1 << 15, 64
#: Passages of a task when the latent space is fitted, and tasks at least; words that a task takes at once.
FIT_PASSAGES, FIT_TASKS, FIT_WORDS = 100_000, 8, 1 << 12
#: Words of a passage, of a block of which windows are made, and of windows.
PASSAGE, STEP, WINDOWS = 64, 8, (16, 24, 32, 40, 48, 56, 64)
COSINE, LCS, ANSWER = 0.55, 0.6, 0.5
#: Items of fewer words count only as they are: a reworded phrase of that length turns up by itself.
LEAST_WORDS = 6
#: Words of the parts in which a longer item is looked for.
MOST_WORDS = 1024
#: Items that are looked for at once, and bytes of them; more go in several rounds.
MOST_ITEMS, MOST_BYTES = 20_000, 8 << 20
#: Words of a document that are projected at once.
PART = 1 << 18
#: Consecutive words, packed into 64 bits by their buckets, that make a place a candidate.
GRAM = 4


def hashes(column) -> tuple[np.ndarray, np.ndarray]:
    return words.word_hashes(column, members=words.ALNUM)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.uint16)


def token_table(df: DataFrame) -> DataFrame:
    """id and the buckets of all words of each text."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column(1), 500_000):
                h, first = hashes(batch.column(1).slice(start, end - start))
                data = np.ascontiguousarray(buckets(h))
                tokens = pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), tokens], ["id", "tokens"])

    return df.mapInArrow(common.lean(run), "id long, tokens binary")


def _documents(batches, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, all tokens and each document's first, for some documents at a time."""
    for batch in batches:
        for start, end in common.pieces(batch.column("tokens"), 2 * most):
            part = batch.slice(start, end - start)
            data, at = words._bytes(part.column("tokens"))
            yield part.column("id").to_numpy(zero_copy_only=False), data.view(np.uint16).astype(np.int64), at // 2


def _passages(first: np.ndarray) -> tuple[np.ndarray, int]:
    """The passage of each token, and how many there are."""
    sizes = np.diff(first)
    within = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    count = -(-sizes // PASSAGE)
    return np.repeat(np.cumsum(count) - count, sizes) + within // PASSAGE, int(count.sum())


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each bucket is, and the number of passages."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        out = np.zeros(BUCKETS + 1, np.int64)
        for _, data, first in _documents(batches):
            passage, n = _passages(first)
            key = np.sort(passage * BUCKETS + data)
            out[:BUCKETS] += np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] % BUCKETS if len(key) else key, minlength=BUCKETS)
            out[BUCKETS] += n
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], ["bucket", "n"])

    rows = tokens.mapInArrow(common.lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def latent_space(tokens: DataFrame, idf: np.ndarray, passages: int) -> np.ndarray:
    """RANK columns: the leading right singular vectors of the TF-IDF passages, each by its singular value.

    Division by the singular values lets no direction that all texts of a language share outweigh the others.
    """
    parts = tokens.coalesce(max(FIT_TASKS, passages // FIT_PASSAGES))  # each gives a matrix
    random = np.random.default_rng(11).normal(size=(BUCKETS, RANK + 16))
    sketch = _gram(parts, idf, random)
    # A'A is about sketch (random' sketch)^-1 sketch', exact where its rank is no more than the sketch's
    small = random.T @ sketch
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    used = values > 1e-7 * max(values.max(), 1e-300)
    left, singular, _ = np.linalg.svd(sketch @ (vectors[:, used] / np.sqrt(values[used])), full_matrices=False)
    out = np.zeros((BUCKETS, RANK))
    used = singular[:RANK] > 1e-4 * max(singular.max(initial=0), 1e-300)
    out[:, : len(used)][:, used] = left[:, :RANK][:, used] / singular[:RANK][used]
    return out


def _gram(tokens: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'A times a matrix, A being the TF-IDF rows of all passages, each of unit length."""
    kept = tokens.sparkSession.sparkContext.broadcast((idf, matrix.astype(np.float32)))
    width = matrix.shape[1]

    def run(batches) -> Iterator:
        import pyarrow as pa

        idf, right = kept.value
        right = right * idf[:, None].astype(np.float32)
        out = np.zeros((BUCKETS, width), np.float32)
        seen, place = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
        for _, data, first in _documents(batches, 1 << 15):
            passage, _ = _passages(first)
            for s in range(0, len(data), FIT_WORDS):  # a passage that is cut here counts as two
                mine, of = data[s : s + FIT_WORDS], passage[s : s + FIT_WORDS] - passage[s]
                seen[mine] = True
                used = np.flatnonzero(seen)
                seen[used] = False
                place[used] = np.arange(len(used))
                n = int(of[-1]) + 1
                counts = np.bincount(of * len(used) + place[mine], minlength=n * len(used)).reshape(n, len(used)).astype(np.float32)
                y = counts @ right[used]
                y /= (np.bincount(of, idf[mine] ** 2)[:, None] + 1e-9).astype(np.float32)  # the squared norm, once for each side
                out[used] += counts.T @ y
        out *= idf[:, None].astype(np.float32)
        for k in range(0, BUCKETS, 512):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out[k : k + 512].tobytes()], pa.binary())], ["at", "z"])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(z, np.float32).astype(np.float64) for z in table.column("z").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "z": pa.array([total.tobytes()], pa.binary())})

    rows = tokens.mapInArrow(common.lean(run), "at int, z binary").groupBy("at").applyInArrow(add, "at int, z binary").toArrow()
    z = np.zeros((BUCKETS, width))
    for at, part in zip(rows.column("at").to_pylist(), rows.column("z").to_pylist(), strict=True):
        z[at : at + 512] = np.frombuffer(part).reshape(512, width)
    return z


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The size buckets from each place on as one number."""
    out = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for k in range(size):
        out = out << np.uint64(16) | data[k : k + len(out)].astype(np.uint64)
    return out


class Item:
    """An item, or a part of a long one. key: the text that it is of; total: that one's words."""

    def __init__(self, item_id: int, h: np.ndarray, idf: np.ndarray, key: int = 0, part: int = 0, total: int = 0):
        self.id, self.words, self.key, self.part, self.total = item_id, h, key, part, total or len(h)
        where: dict[int, int] = {}
        for k, w in enumerate(h.tolist()):
            where[w] = where.get(w, 0) | 1 << k
        self.where = where
        distinct = np.unique(h)
        rare = np.argsort(-idf[buckets(distinct)], kind="stable")[: max(1, len(distinct) // 3)]
        self.answer = frozenset(distinct[rare].tolist())


def common_subsequence(item: Item, text: list[int]) -> tuple[int, int, int]:
    """The length of the longest common subsequence, and a stretch of the text (from, to) that holds one."""
    mask = (1 << len(item.words)) - 1
    row, best, end = mask, 0, 0
    for i, w in enumerate(text):
        if (hit := item.where.get(w)) is not None:
            both = row & hit
            row = ((row + both) | (row - both)) & mask
            if (n := (row ^ mask).bit_count()) > best:
                best, end = n, i + 1
    back = {w: sum(1 << (len(item.words) - 1 - k) for k in range(len(item.words)) if m >> k & 1) for w, m in item.where.items()}
    row, start = mask, end
    for i in range(end - 1, -1, -1):
        if (hit := back.get(text[i])) is not None:
            both = row & hit
            row = ((row + both) | (row - both)) & mask
            if (row ^ mask).bit_count() == best:
                start = i
                break
    return best, start, end


def judge(item: Item, text: list[int]) -> tuple[int, float, bool]:
    """LCS length, share of the answer words in the stretch, and whether some stretch of at most 2 item lengths holds the item.

    Where the text's longest common subsequence is spread too far, or its stretch lacks answer words, all stretches of that
    length are gone through. A shorter one that holds the item lies within one of these, which then holds it too.
    """
    if len(item.words) < LEAST_WORDS:
        own = item.words.tolist()
        return (len(own), 1.0, True) if any(text[s : s + len(own)] == own for s, w in enumerate(text) if w == own[0]) else (0, 0.0, False)
    n, start, end = common_subsequence(item, text)
    answer = len(item.answer & set(text[start:end])) / len(item.answer)
    most, least = 2 * len(item.words), LCS * len(item.words)
    if n < least or end - start <= most and answer >= ANSWER:
        return n, answer, n >= least
    found = (0, 0.0)
    own = [w if w in item.where else None for w in text]
    for s in range(max(1, len(text) - most + 1)):
        if own[s] is None and s + most < len(text):
            continue  # the next stretch loses none of the item's words by beginning later
        part = own[s : s + most]
        if len(part) - part.count(None) >= least and (share := len(item.answer.intersection(part)) / len(item.answer)) >= ANSWER:
            found = max(found, (_length(item, part), share))
    return (*found, True) if found[0] >= least else (n, answer, False)


def _length(item: Item, text: list[int | None]) -> int:
    """The length of the longest common subsequence."""
    mask = row = (1 << len(item.words)) - 1
    for w in text:
        if w is not None:
            both = row & item.where[w]
            row = ((row + both) | (row - both)) & mask
    return (row ^ mask).bit_count()


def _search(tokens: DataFrame, items: list[Item], latent: np.ndarray) -> DataFrame:
    """id, item (its place in items), low and high (words from and to) and cosine of each candidate."""
    spark = tokens.sparkSession
    rows, owner, sizes = [], [], []
    for k, item in enumerate(items):
        b = buckets(item.words).astype(np.int64)
        for s in range(0, len(b) if len(b) >= LEAST_WORDS else 0, PASSAGE):
            part = b[s : s + PASSAGE] if len(b) - s >= LEAST_WORDS or not s else b[-PASSAGE:]
            v = latent[part].sum(axis=0)
            rows.append(v / (np.linalg.norm(v) + 1e-9))
            owner.append(k)
            sizes.append(next(w for w in WINDOWS if w >= len(part)))
    of = np.array(sizes)
    rows = np.array(rows, np.float32).reshape(-1, RANK)
    classes = {w: (rows[of == w].T.copy(), np.array(owner)[of == w]) for w in WINDOWS if (of == w).any()}
    kept = spark.sparkContext.broadcast((np.vstack([latent, np.zeros((1, RANK))]).astype(np.float32), classes))
    own = [buckets(i.words).astype(np.int64) for i in items]
    tables = []
    for n in range(1, GRAM + 1):  # shorter items than GRAM as a whole
        some = [k for k, x in enumerate(own) if (len(x) == n if n < GRAM else len(x) >= n)]
        if some:
            listed = [grams(own[k], n) for k in some]
            gram, holder = np.concatenate(listed), np.repeat(some, [len(x) for x in listed])
            place = np.concatenate([np.arange(len(x)) for x in listed])
            order = np.argsort(gram, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[common.mix(gram) >> np.uint64(42)] = True
            tables.append((n, gram[order], holder[order], place[order], seen))
    shared = spark.sparkContext.broadcast(tables)
    answers = [buckets(np.fromiter(i.answer, np.uint64)).astype(np.int64) for i in items]
    rare = np.full((len(items), max(map(len, answers))), BUCKETS)
    for k, x in enumerate(answers):
        rare[k, : len(x)] = x
    parts = spark.sparkContext.broadcast((own, rare, ANSWER * np.array([len(x) for x in answers])))

    def hits(data: np.ndarray, first: np.ndarray):
        """Row, item, low, high, cosine arrays of a few documents."""
        latent, classes = kept.value
        padded = np.append(data, np.zeros(STEP, np.int64))
        count = -(-np.diff(first) // STEP)
        pad = WINDOWS[-1] // STEP
        begin = np.cumsum(count + pad) - (count + pad)
        block = np.zeros((int((count + pad).sum()), RANK), np.float32)
        at = np.repeat(np.arange(len(count)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for s in range(0, len(at), 4096):
            here = first[at[s : s + 4096]] + within[s : s + 4096] * STEP
            ends = first[at[s : s + 4096] + 1]
            total = block[begin[at[s : s + 4096]] + within[s : s + 4096]]
            for k in range(STEP):
                total += latent[np.where(here + k < ends, padded[here + k], BUCKETS)]
            block[begin[at[s : s + 4096]] + within[s : s + 4096]] = total
        places, sums, size = begin[at] + within, block, STEP
        for w in WINDOWS:
            while size < w:
                sums = sums[: len(sums) - 1] + block[size // STEP :]
                size += STEP
            if w not in classes:
                continue
            vectors, owners = classes[w]
            for s in range(0, len(places), 4096):
                x = sums[places[s : s + 4096]]
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                x /= np.maximum(norm, 1e-9)[:, None]
                i, j = np.divmod(np.flatnonzero(x @ vectors >= COSINE), len(owners))
                if len(i):
                    cosine = np.einsum("ij,ij->i", x[i], vectors[:, j].T)
                    yield at[s + i], owners[j], within[s + i] * STEP, within[s + i] * STEP + w, cosine

    def same(data: np.ndarray, first: np.ndarray):
        """As hits, of places that share words with an item; low and high are where the whole item would lie, cosine is -2."""
        own = parts.value[0]
        for n, gram, holder, place, seen in shared.value:
            text = grams(data, n)
            at = np.flatnonzero(seen[common.mix(text) >> np.uint64(42)])
            row = np.searchsorted(first, at, side="right") - 1
            at, row = (x[at + n <= first[row + 1]] for x in (at, row))
            left, right = (np.searchsorted(gram, text[at], side=x) for x in ("left", "right"))
            total = np.cumsum(right - left)
            for s in range(0, int(total[-1]) if len(total) else 0, 1 << 20):
                k = np.arange(s, min(s + (1 << 20), int(total[-1])))
                i = np.searchsorted(total, k, side="right")
                to = left[i] + k - (total[i] - (right - left)[i])
                r, item = row[i], holder[to]
                low = at[i] - first[r] - place[to]
                high = np.minimum(low + np.array([len(own[x]) for x in item.tolist()], np.int64), (first[r + 1] - first[r]))
                low = np.maximum(low, 0)
                _, once = np.unique(np.stack([r, item, low], 1), axis=0, return_index=True)
                yield r[once], item[once], low[once], high[once], np.full(len(once), -2.0)

    def stretches(found, data: np.ndarray, first: np.ndarray):
        """The windows of a document and an item that touch, as one; without those that can't hold enough of the item."""
        row, item, low, high, cosine = (np.concatenate([f[i] for f in found]) for i in range(5))
        order = np.lexsort((low, item, row))
        row, item, low, high, cosine = (x[order] for x in (row, item, low, high, cosine))
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])])
        starts = np.flatnonzero(new)
        row, item, low = row[starts], item[starts], low[starts]
        high, cosine = np.maximum.reduceat(high, starts), np.maximum.reduceat(cosine, starts)
        keep = np.zeros(len(row), bool)
        own, rare, least = parts.value
        held = np.zeros(BUCKETS + 1, bool)
        edges = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            text = data[first[row[a]] : first[row[a] + 1]]
            held[text] = True
            some = a + np.flatnonzero(held[rare[item[a:b]]].sum(axis=1) >= least[item[a:b]])
            held[text] = False
            for k in some.tolist():
                i = item[k]
                around = text[max(0, low[k] - len(own[i])) : high[k] + len(own[i])]
                held[around] = True
                keep[k] = held[own[i]].sum() >= LCS * len(own[i]) and held[rare[i]].sum() >= least[i]
                held[around] = False
                if keep[k] and cosine[k] < -1:
                    x, y = (kept.value[0][w].sum(axis=0) for w in (text[low[k] : high[k]], own[i]))
                    cosine[k] = x @ y / max(float(np.linalg.norm(x) * np.linalg.norm(y)), 1e-9)
        return row[keep], item[keep], low[keep], high[keep], cosine[keep]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for ids, data, first in _documents(batches):
            found = []
            if len(data) <= PART:
                found = [*hits(data, first), *same(data, first)]
            else:  # a single long document
                for s in range(0, len(data), PART - PASSAGE):
                    piece = data[s : s + PART]
                    found += [(r, k, lo + s, hi + s, c) for r, k, lo, hi, c in hits(piece, np.array([0, len(piece)]))]
                found += same(data, first)
            if found:
                r, k, lo, hi, c = stretches(found, data, first)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(k, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(c, pa.float64())], ["id", "item", "low", "high", "cosine"])

    return tokens.mapInArrow(common.lean(run), "id long, item int, low int, high int, cosine double")


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item_id, cosine, lcs (words), lcs_share, answer_share and words (from, to) of each document that holds an item.

    One row a pair, with the best of its stretches (largest lcs, then cosine, then the first). Of an item in several parts, a
    document holds it if the parts that it holds make up LCS of its words; lcs is their sum, answer_share their least, cosine
    their largest. An item that stands in rows of several texts is held if one of them is. Null or empty texts on either
    side hold nothing; rows with a null id on either side are passed over.
    Repeated rows give one row. Columns that aren't named are not read. Without documents or items the result is empty.
    The driver holds about MOST_BYTES of items, or one item, at a time.
    """
    spark = df.sparkSession
    common.ship(spark)
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).where("id is not null and text is not null")
    asked = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text")).where("item_id is not null and text is not null").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    rounds = max(1, -(-size["n"] // MOST_ITEMS), -(-size["bytes"] // MOST_BYTES))
    tokens = common.written(token_table(docs), "tokens")
    counts, passages = frequencies(tokens)
    idf = np.log((1.0 + passages) / (1.0 + counts))
    latent = (latent_space(tokens, idf, passages) * idf[:, None]) if passages else np.zeros((BUCKETS, RANK))
    out = None
    for k in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).withColumn("key", F.xxhash64("text")).orderBy("item_id", "text").toArrow()
        h, first = hashes(block.column("text").combine_chunks())
        items = [x for i, key, a, b in zip(block.column("item_id").to_pylist(), block.column("key").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True) for x in parts_of(i, h[a:b], idf, key)]
        part = _confirm(docs, _search(tokens, items, latent), items) if items and passages else _confirm(docs.limit(0), None, [])
        out = part if out is None else out.unionByName(part)
    out = common.written(out, "leaks")
    common.release(tokens)
    best = F.max(F.struct("lcs", "cosine", (-F.col("low")).alias("first"), "high", "answer_share")).alias("b")
    out = out.groupBy("id", "item_id", "key", "total", "part").agg(best).select("id", "item_id", "key", "total", "b.*")
    out = out.groupBy("id", "item_id", "key", "total").agg(F.sum("lcs").cast("int").alias("lcs"), F.max("cosine").alias("cosine"), F.max("first").alias("first"), F.max("high").alias("high"), F.min("answer_share").alias("answer_share"))
    out = out.withColumn("lcs_share", F.col("lcs") / F.col("total")).where(F.col("lcs_share") >= LCS)
    best = F.max(F.struct("lcs", "cosine", "first", "high", "lcs_share", "answer_share")).alias("b")
    out = out.groupBy("id", "item_id").agg(best)
    return out.select(F.col("id").alias(id_col), "item_id", "b.cosine", "b.lcs", "b.lcs_share", "b.answer_share", (-F.col("b.first")).cast("int").alias("low"), F.col("b.high").alias("high"))


_FOUND = "id long, item_id long, key long, total int, part int, cosine double, lcs int, answer_share double, low int, high int"


def parts_of(item_id: int, h: np.ndarray, idf: np.ndarray, key: int) -> list[Item]:
    """The item, or equal parts of at most MOST_WORDS words; none of an item without words."""
    cuts = np.linspace(0, len(h), -(-len(h) // MOST_WORDS) + 1).astype(int).tolist()
    return [Item(item_id, h[a:b], idf, key, k, len(h)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _confirm(docs: DataFrame, candidates: DataFrame | None, items: list[Item]) -> DataFrame:
    """The candidates that hold, as rows of _FOUND."""
    spark = docs.sparkSession
    if candidates is None:
        return spark.createDataFrame([], _FOUND)
    listed = candidates.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("item", "low", "high", "cosine"))).alias("found"))
    kept = spark.sparkContext.broadcast(items)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column("text"), 500_000):
                part = batch.slice(start, end - start)
                h, first = hashes(part.column("text"))
                rows = []
                for i, found, a, b in zip(part.column("id").to_pylist(), part.column("found").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for f in found:
                        item, lo, hi, cosine = kept.value[f["item"]], f["low"], f["high"], f["cosine"]
                        size = len(item.words)
                        reach = min(hi - lo, 4 * size + 64)  # a long stretch is gone through in parts that overlap
                        for s in range(lo, max(lo + 1, hi - size), max(1, reach - size)) if hi - lo > reach else [lo]:
                            x, y = max(0, s - size), min(b - a, s + reach + size)
                            n, answer, ok = judge(item, h[a + x : a + y].tolist())
                            if ok:
                                rows.append((i, item.id, item.key, item.total, item.part, cosine, n, answer, x, y))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                columns = zip(*rows, strict=True) if rows else [[]] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return docs.join(listed, "id").select("id", "text", "found").mapInArrow(common.lean(run), _FOUND)
