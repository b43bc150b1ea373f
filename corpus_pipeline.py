"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Language ID drops documents without a language; line dedup deletes runs of lines that stood earlier, and documents of which
nothing is left; MinHash near-dedup keeps one document of each group (five-word shingles, similarity of 0.8 or more);
decontamination drops documents that hold a benchmark item; the last stage encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, decontam, langid, linededup, minhash
from tidelog.llm.common import held_out, table, vocabulary, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior probability of the likeliest language.
LEAST_SCORE = 0.5
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or a clear language. Null and empty texts go."""
    model = langid.fit(docs.where(~held_out()))
    kept = langid.identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines; a document of which only white space is left goes. n_chars is counted anew."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group; rows without an id stay."""
    gone = minhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    held = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return byte_bpe.encode_decode(docs, *vocabulary(), digests=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
