import hashlib
import struct

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_decontam import plain
from tests.llm.test_linededup import brute as brute_lines
from tidelog.llm import byte_bpe
from tidelog.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), name)
        rows = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            after = {i: r.text for i, r in rows.items()}
        if k == 0:
            want = {i: t for i, t in before.items() if any(c.isalpha() for c in t)}
            assert set(after) <= set(want) and len(after) >= 0.98 * len(want)
        elif k == 1:
            cut = brute_lines(list(before.items()))
            want = {i: t for i, (t, _, gone) in cut.items() if not gone or t.strip()}
            assert after == want
            assert all(rows[i].n_chars == len(t) for i, t in want.items() if cut[i][2])
        elif k == 2:
            groups = brute.near_duplicates(list(before.items()), 5)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif k == 3:
            held = {i for i, t in before.items() if any(x in plain(t) for x in items)}
            assert held and not held & set(after) and len(set(before) - held - set(after)) <= 2
        else:
            ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
            tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            for i, t in before.items():
                ids = tik.encode_ordinary(t)
                assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        before = after


def test_nulls_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, "and the other thing", "en", None, 3), (9001, None, None, "x", None), (9002, "", "en", None, 0), (9003, "the\nother", None, "x", 5)], docs.schema))
    for frame in (odd.withColumn("score", F.lit(1)).withColumn("id", F.lit("clash")), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, SF), name)
        frame.collect()
