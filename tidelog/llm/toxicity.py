"""Toxic spans and scores by a linear-chain conditional random field.

Tokens are words of letters and digits, and those of a text are one chain. A token's emission is the sum of weights of
its word and of the word's beginnings, hashed to FEATURES; transitions join neighbours. Forward-backward gives each token's
marginal probability of being toxic; a document's score is a logistic function of its largest marginals and their sum, and
runs of tokens that are likelier toxic than not are its spans.

Labels are of documents, so tokens are labelled first: a token is toxic if its document is and one of its features is, with
confidence, many times as frequent among toxic documents as among others. The model is fitted on pieces of CHAIN tokens; when
texts are scored, the messages that pass between pieces are computed too, so that marginals are those of the whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, words

FEATURES, CHAIN = 1 << 18, 64
#: Bytes of the word beginnings that are features.
PREFIXES = (3, 4, 5, 6, 8)
#: The model is fitted on at most about so many labelled documents of each class, chosen by a hash of the id over all of
#: them, and of these on those that come first by that hash until they have so many bytes.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 2000, 4000, 32 << 20
THRESHOLD = 0.3
#: Least log-odds, less 1.64 standard errors, of a feature that labels tokens.
EVIDENCE = 2.0


@dataclass(frozen=True)
class Model:
    """weight by feature, the last the bias; transition[from, to]; coefficients of the score, or a constant score."""

    weight: np.ndarray
    transition: np.ndarray
    score: np.ndarray
    constant: float | None = None


def tokens(column):
    return words.prefix_hashes(column, PREFIXES, words.ALNUM)


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and each row's first token of a whole column, taken a few rows at a time: on the way tokens() holds many times the text."""
    hashes, sizes = [np.zeros((0, 1 + len(PREFIXES)), np.uint64)], [np.zeros(1, np.int64)]
    for start, end in common.pieces(column, 500_000):
        part, first = tokens(column.slice(start, end - start))[:2]
        hashes.append(part)
        sizes.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(sizes))


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each chain, and a matrix of its tokens (-1 where it has ended)."""
    sizes = np.diff(first)
    count = -(-sizes // CHAIN)
    row = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = first[row][:, None] + within[:, None] * CHAIN + np.arange(CHAIN)
    return row, np.where(at < first[row + 1][:, None], at, -1)


def marginals(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, pairs: bool = False, before=None, behind=None):
    """P(toxic) of each token of a batch of chains, by forward-backward; with pairs, also the expected transitions.

    before and behind: the messages that reach the first and the last token from outside, if the chains are pieces.
    """
    n, length = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(transition)
    forward, backward = np.zeros((length, n, 2)), np.ones((length, n, 2))
    forward[0] = np.stack([np.ones(n), e[:, 0]], 1) if before is None else before * np.stack([np.ones(n), e[:, 0]], 1)
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    end = np.ones((n, 2)) if behind is None else behind
    backward[-1] = end
    for k in range(1, length):
        step = forward[k - 1] @ t
        step[:, 1] *= e[:, k]
        step /= step.sum(axis=1, keepdims=True)
        forward[k] = np.where(mask[:, k, None], step, forward[k - 1])
    for k in range(length - 2, -1, -1):
        after = backward[k + 1].copy()
        after[:, 1] *= e[:, k + 1]
        step = after @ t.T
        step /= step.sum(axis=1, keepdims=True)
        backward[k] = np.where(mask[:, k + 1, None], step, end)
    both = forward * backward
    p = (both[:, :, 1] / both.sum(axis=2)).T
    p[~mask] = 0
    if not pairs:
        return p
    expected = np.zeros((2, 2))
    for k in range(length - 1):
        after = backward[k + 1].copy()
        after[:, 1] *= e[:, k + 1]
        joint = forward[k][:, :, None] * t * after[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected += joint[mask[:, k + 1]].sum(axis=0)
    return p, expected


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


def token_labels(hashes: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens count as toxic, for documents of known labels."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    out = np.zeros(len(hashes), bool)
    for k in range(hashes.shape[1]):
        kinds, at = np.unique(hashes[:, k], return_inverse=True)
        seen = np.unique(at.astype(np.int64) * len(toxic) + doc)
        d1 = np.bincount(seen // len(toxic), toxic[seen % len(toxic)], len(kinds))
        d0 = np.bincount(seen // len(toxic), minlength=len(kinds)) - d1
        odds = np.log((d1 + 0.1) / (n1 + 0.2)) - np.log((d0 + 0.1) / (n0 + 0.2))
        odds -= 1.64 * np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))
        out |= (odds >= EVIDENCE)[at]
    return out & (toxic[doc] == 1)


def train_crf(hashes: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient steps on the chains' conditional likelihood: so many, and three rounds at least."""
    features = _buckets(hashes)
    weight, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-2)
    weight[-1] = -3.0
    transition, moved = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    _, at = chains(first)
    rng = np.random.default_rng(3)
    for _ in range(max(3, -(-steps // max(1, -(-len(at) // 256))))):
        order = rng.permutation(len(at))
        for s in range(0, len(order), 256):
            part = at[order[s : s + 256]]
            mask = part >= 0
            f = features[part]
            p, expected = marginals(weight[f].sum(axis=2) + weight[-1], mask, transition, True)
            y = labels[part] & mask
            error = np.where(mask, y - p, 0) / 64
            gradient = np.bincount(f.ravel(), np.repeat(error.ravel(), f.shape[2]), FEATURES + 1)
            gradient[-1] = error.sum()
            gradient -= 1e-5 * weight
            observed = np.zeros((2, 2))
            both = mask[:, 1:]
            np.add.at(observed, (y[:, :-1][both].astype(int), y[:, 1:][both].astype(int)), 1)
            step = (observed - expected) / 64 / 256
            squares += gradient**2
            moved += step**2
            weight += 0.3 * gradient / np.sqrt(squares)
            transition += 0.1 * step / np.sqrt(moved)
    return weight, transition


def messages(emission: np.ndarray, row: np.ndarray, at: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches the first and the last token of each piece of a chain from the pieces before and behind it.

    A piece's matrix takes a message over all its tokens; the products of these matrices along a row give the messages.
    """
    n = len(row)
    t = np.exp(transition)
    before, behind = np.ones((n, 2)), np.ones((n, 2))
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    if n == 0 or sizes.max() == 1:
        return before, behind
    whole = np.zeros((n, 2, 2))  # all pieces but the last of a row are full
    for s in range(0, n, 4096):
        e = np.exp(np.clip(emission[np.maximum(at[s : s + 4096], 0)], -30, 30))
        step = np.tile(np.eye(2), (len(e), 1, 1))
        for k in range(at.shape[1]):
            if k:
                step = step @ t
            step[:, :, 1] *= e[:, k, None]
            step /= step.sum(axis=(1, 2), keepdims=True)
        whole[s : s + 4096] = step
    most = int(sizes.max())
    for k in range(1, most):  # messages to piece k of each row that has one
        i = begins[sizes > k] + k
        step = (before[i - 1, None, :] @ whole[i - 1])[:, 0] @ t
        before[i] = step / step.sum(axis=1, keepdims=True)
    last = begins + sizes - 1
    e = np.exp(np.clip(np.where(at[last] >= 0, emission[np.maximum(at[last], 0)], 0), -30, 30))
    tail = np.ones((len(last), 2))  # from a last piece, which may be short, to its first token
    for k in range(at.shape[1] - 1, -1, -1):
        used = at[last, k] >= 0
        step = tail.copy()
        step[:, 1] *= e[:, k]
        step = step @ t.T  # to the token before, at k = 0 that of the piece before
        tail = np.where(used[:, None], step / step.sum(axis=1, keepdims=True), tail)
    for k in range(2, most + 1):  # from behind: piece size - k of each row
        i = begins[sizes >= k] + sizes[sizes >= k] - k
        if k == 2:
            behind[i] = tail[sizes >= k]
        else:
            step = (whole[i + 1] @ behind[i + 1, :, None])[:, :, 0] @ t.T
            behind[i] = step / step.sum(axis=1, keepdims=True)
    return before, behind


def token_marginals(model: Model, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes))
    emission = model.weight[_buckets(hashes)].sum(axis=1) + model.weight[-1]
    row, at = chains(first)
    before, behind = messages(emission, row, at, model.transition)
    for s in range(0, len(at), 4096):
        part = at[s : s + 4096]
        mask = part >= 0
        out[part[mask]] = marginals(np.where(mask, emission[part], 0), mask, model.transition, before=before[s : s + 4096], behind=behind[s : s + 4096])[mask]
    return out


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A one, the log-odds of the largest and second largest marginal, and the log of one more than their sum."""
    out = np.zeros((len(first) - 1, 4))
    out[:, 0] = 1
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in (1, 2):
        most = np.full(len(first) - 1, 1e-6)
        np.maximum.at(most, row, p)
        most = np.minimum(most, 1 - 1e-6)
        out[:, k] = np.log(most / (1 - most)) / 5
        if k == 1:
            top = np.full(len(first) - 1, -1)
            top[row[p >= most[row]]] = np.flatnonzero(p >= most[row])
            p = p.copy()
            p[top[top >= 0]] = 0
            out[:, 3] = np.log1p(np.bincount(row, p, len(first) - 1) + np.where(top >= 0, most, 0))
    return out


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (y - q)) - 0.1 * b
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the documents that have a label. An id with both labels counts as toxic.

    With labels of one class or none, the score is constant. A third of each class is kept for the score's coefficients; the
    only document of a class is used for both.
    """
    import pyarrow as pa

    common.ship(documents.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    none = Model(np.zeros(FEATURES + 1), np.zeros((2, 2)), np.zeros(4), n1 / max(1, n1 + n0))
    if not n1 or not n0:
        return none
    share = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, TRAIN_TOXIC / n1) * (1 << 30)))).otherwise(int(min(1.0, TRAIN_CLEAN / n0) * (1 << 30)))
    chance = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30))
    sample = known.withColumn("chance", chance).where(F.col("chance") < share)
    texts = documents.select(documents[id_col].alias("of"), documents[text_col].alias("text")).where("text is not null")
    # broadcast: about TRAIN_TOXIC + TRAIN_CLEAN rows of three numbers, here and below
    sizes = texts.join(F.broadcast(sample), F.col("of") == F.col("id")).groupBy("id", "chance", "toxic").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sorted((r["toxic"], r["chance"], r["id"], r["bytes"]) for r in sizes.collect())
    taken = [x for label in (0, 1) for x in _within([s for s in sizes if s[0] == label], TRAIN_BYTES * (1 + label) // 3)]
    if not taken:
        return none
    taken = documents.sparkSession.createDataFrame([(i, label) for label, _, i, _ in taken], known.schema)
    rows = texts.join(F.broadcast(taken), F.col("of") == F.col("id")).select("id", "text", "toxic").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    place = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic)) - 1  # within its class
    alone = np.bincount(toxic, minlength=2)[toxic] == 1
    third = (place % 3 == 0) | alone
    pick = lambda keep: (tokens_of(rows.column("text").combine_chunks().filter(pa.array(keep))), toxic[keep])
    if toxic.min() == toxic.max():
        return none
    (hashes, first), y = pick(~third | alone)
    weight, transition = train_crf(hashes, first, token_labels(hashes, first, y))
    model = Model(weight, transition, np.zeros(4))
    (hashes, first), y = pick(third)
    x = document_features(token_marginals(model, hashes, first), first)
    share1 = n1 / (n1 + n0)
    balance = np.where(y == 1, share1 / y.mean(), (1 - share1) / (1 - y.mean()))
    return Model(weight.astype(np.float32), transition, fit_score(x, y, balance))


def _within(sizes: list[tuple], most: int) -> list[tuple]:
    """The first of these whose bytes, which stand last, add up to no more than most; one at least."""
    total = np.cumsum([s[-1] for s in sizes]) if sizes else np.zeros(0)
    return sizes[: max(1, int(np.searchsorted(total, most, side="right")))]


def tag(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """score, predicted and spans of each whole text, with the id and the columns in keep.

    spans are start, end (characters) and score (mean marginal) of each run of toxic tokens. A null or empty text has no
    spans and the score of a text without tokens. Equal texts get equal results, a null id stays null, an empty table gives
    an empty one, columns that aren't named are not read. The model has a fixed size and is broadcast.
    """
    spark = df.sparkSession
    common.ship(spark)
    kept = spark.sparkContext.broadcast(model)
    df = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *[df[c].alias(f"keep{i}") for i, c in enumerate(keep)])
    rest = [c for c in df.columns if c != "text"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = kept.value
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            for start, stop in common.pieces(batch.column("text"), 500_000):
                part = batch.slice(start, stop - start)
                hashes, first, begin, end, at = tokens(part.column("text"))
                p = token_marginals(model, hashes, first)
                z = document_features(p, first) @ model.score
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model.constant is None else np.full(len(first) - 1, model.constant)
                spans: list[list[dict]] = [[] for _ in range(len(first) - 1)]
                hot = np.flatnonzero(p >= 0.5) if model.constant is None else np.zeros(0, np.int64)
                if len(hot):
                    data, _ = words._bytes(part.column("text"))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    row = np.searchsorted(first, hot, side="right") - 1
                    new = np.concatenate([[True], (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1])])
                    for g in np.split(np.arange(len(hot)), np.flatnonzero(new)[1:]):
                        r = int(row[g[0]])
                        base = chars[at[r]]
                        spans[r].append({"start": int(chars[begin[hot[g[0]]]] - base), "end": int(chars[end[hot[g[-1]]]] - base), "score": float(p[hot[g]].mean())})
                columns = [part.column(c) for c in rest] + [pa.array(scores, pa.float64()), pa.array(scores >= THRESHOLD).cast(pa.int32()), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "score", "predicted", "spans"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest) + ", score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    return df.mapInArrow(common.lean(run), schema).toDF(id_col, *keep, "score", "predicted", "spans")
