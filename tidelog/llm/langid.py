"""Language identification: multinomial naive Bayes over hashed character n-grams.

A model is one matrix of log-probabilities, languages by hash buckets. It is broadcast (its size is languages x BUCKETS doubles,
checked against MOST_MODEL_MB) and each batch of texts is scored as sparse sums over the n-grams' rows in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most about so many labelled rows, chosen by a hash of the id over all of them.
TRAIN_ROWS = 20_000
#: Tasks that count the sample's n-grams.
FIT_TASKS = 8
MOST_MODEL_MB = 256
#: Texts longer than this are scored in parts.
PART = 1_000_000
#: Bytes of texts that are hashed at once.
PIECE = 500_000
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray

    def __post_init__(self):
        if self.log_prob.nbytes > MOST_MODEL_MB << 20:
            raise ValueError(f"the model has {self.log_prob.nbytes >> 20} MB; use fewer buckets")


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def parts(text: str) -> Iterator[str]:
    """The text, or parts of about PART characters that end where a word ends, if one does within the last tenth."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        back = next((i for i in range(cut, cut - PART // 10, -1) if not text[i].isalpha()), cut)
        yield text[at:back]
        at = back
    yield text[at:]


def hashed(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, the buckets of all n-grams and where each text's begin; and the letters in each text.

    Case is dropped, each run of other characters than letters is one space, and a space stands before and after a text.
    """
    lower = [t.lower() for t in texts]
    joined = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.zeros(len(lower) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in lower], out=first[1:])
    is_letter = letters()[joined]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[first[:-1]] = True
    codes = np.where(is_letter, joined, 32)[keep].astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(keep)])[first]
    codes = np.concatenate([codes, np.full(max(ORDERS), 32, np.uint64)])
    n = int(begin[-1])
    inner = np.ones(n, bool)
    inner[begin[1:] - 1] = False  # an n-gram from a text's last space would reach into the next text
    at = np.concatenate([[0], np.cumsum(inner)])[begin]
    out, starts = [], []
    state = np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        state = (state + codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if k + 1 in ORDERS:
            out.append((common.mix(state + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int32)[inner])
            starts.append(at)
    counts = np.add.reduceat(is_letter, first[:-1], dtype=np.int64) if len(lower) else np.zeros(0, np.int64)
    return out, starts, counts


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about train_rows rows with text and label. Without such rows the model knows no language."""
    spark = df.sparkSession
    common.ship(spark)
    df = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[label_col].cast("string").alias("label")).where("text is not null and label is not null")
    total = df.where("label is not null").select("id").count()
    if not total:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    share = int(min(1.0, train_rows / total) * (1 << 30))
    sample = df.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    sample = sample if sample.select("id").limit(1).count() else df
    counts = sample.select("label", "text").repartition(FIT_TASKS).mapInArrow(common.lean(_count), "label string, bucket int, n long")
    rows = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("label").to_pylist()))
    where = {x: i for i, x in enumerate(names)}
    table = np.zeros((len(names), BUCKETS + 1))
    which = np.array([where[x] for x in rows.column("label").to_pylist()], np.int64)
    np.add.at(table, (which, rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    docs, table = table[:, BUCKETS], table[:, :BUCKETS] + 0.1
    return Model(names, np.log(docs / docs.sum()), np.log(table / table.sum(axis=1, keepdims=True)))


def _count(batches) -> Iterator:
    """Per language the n-grams in each bucket, and in a bucket of its own the documents."""
    import pyarrow as pa

    table: dict[str, np.ndarray] = {}
    for batch in batches:
        for start, end in common.pieces(batch.column(1), PIECE):
            labels = batch.column(0).slice(start, end - start).to_pylist()
            texts = batch.column(1).slice(start, end - start).to_pylist()
            for label in sorted(set(labels)):
                mine = [t for t, x in zip(texts, labels, strict=True) if x == label]
                counts = table.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                counts[BUCKETS] += len(mine)
                flat = [p for t in mine for p in parts(t)]
                for some in [flat] if sum(map(len, flat)) <= PART else [[p] for p in flat]:
                    for grams in hashed(some)[0]:
                        counts[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
    for label, counts in table.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["label", "bucket", "n"])


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; und and 0 without letters or languages."""
    split = [list(parts(t or "")) for t in texts]
    flat = [p for ps in split for p in ps]
    owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in split])
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    grams, starts, letters_in = hashed(flat)
    np.add.at(count, owner, letters_in)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    for g, at in zip(grams, starts, strict=True):
        for k in range(len(model.languages)):
            sums = np.add.reduceat(np.append(model.log_prob[k][g], 0.0), at[:-1])
            sums[at[1:] == at[:-1]] = 0  # reduceat gives an empty part the next element
            np.add.at(total[:, k], owner, sums)
    total += model.prior
    top = total.max(axis=1, keepdims=True)
    posterior = np.exp(total - top)
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = posterior.argmax(axis=1)
    known = count > 0
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, posterior[np.arange(len(texts)), best], 0.0)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score of each whole text, with the id and the columns in keep as they are.

    und and score 0 if the text is null or has no letter; equal texts get equal results, ties go to the first language in
    alphabetical order; a null id stays null; an empty table gives an empty one; columns that aren't named are not read.
    """
    spark = df.sparkSession
    common.ship(spark)
    kept = spark.sparkContext.broadcast(model)
    df = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *[df[c].alias(f"keep{i}") for i, c in enumerate(keep)])
    rest = [c for c in df.columns if c != "text"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column("text"), PIECE):
                part = batch.slice(start, end - start)
                names, scores = score(kept.value, part.column("text").to_pylist())
                columns = [part.column(c) for c in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "lang_pred", "score"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest) + ", lang_pred string, score double"
    return df.mapInArrow(common.lean(run), schema).toDF(id_col, *keep, "lang_pred", "score")
