"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, covertree, decontam, langid, linededup, minhash, paradedup, tokencount, toxicity, warc
from tidelog.llm.common import held_out, new_path, table, vocabulary


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(documents.where("not held_out"))
    return langid.identify(documents, model, keep=("held_out",))


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.tag(documents, model, keep=("held_out",))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.threshold_links(table(spark, sf_dir, "embeddings"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.repeats(table(spark, sf_dir, "documents"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(documents)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), *vocabulary())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), *vocabulary(), digests=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, "op1_language_id": op1_language_id, "op2_toxic_spans": op2_toxic_spans, "op3_cover_tree": op3_cover_tree, "op4_paragraph_dedup": op4_paragraph_dedup, "op5_latent_decontamination": op5_latent_decontamination, "op6_line_dedup": op6_line_dedup, "op7_token_count": op7_token_count, "op8_byte_bpe": op8_byte_bpe, "op9_warc": op9_warc, "op10_minhash_forest": op10_minhash_forest}


def oracle_sql() -> dict[str, str]:
    return {"op3_cover_tree": covertree.ORACLE, "op6_line_dedup": linededup.ORACLE, "op9_warc": warc.ORACLE}
