import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import langid
from tidelog.llm.common import held_out, table
from tidelog.llm.queries import op1_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert got.count() == truth.count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_nulls_empty_long_repeated_and_clashing(spark):
    rows = [(1, "the thing and other", "en"), (2, "der die das über", "de"), (3, None, "en"), (4, "", None), (5, "123 *** 4", "de"), (6, "the other " * 200_000, None), (None, "die der", "de"), (2, "der die das über", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1))
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de")}
    assert langid.identify(df, model).count() == len(rows)
    empty = langid.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, empty).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0), model).count() == 0


def test_scores_do_not_depend_on_neighbours(spark):
    texts = ["Ouan eneau", "x", "the\nand", "ß", " é-è "]
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], np.log([0.5, 0.5]), np.log(rng.random((2, langid.BUCKETS)) + 0.1))
    alone = [langid.score(model, [t])[1][0] for t in texts]
    assert np.allclose(langid.score(model, texts)[1], alone)


def test_long_texts_are_cut_between_words():
    text = "word " * 500_000
    cut = list(langid.parts(text))
    assert "".join(cut) == text and len(cut) > 2 and max(map(len, cut)) <= langid.PART
    assert all(not p[0].isalpha() for p in cut[1:])


def test_scores_against_brute_force():
    def bucket(gram):
        codes = np.array([ord(c) for c in gram], np.uint64)
        state = np.zeros(1, np.uint64)
        for c in codes:
            state = (state + c) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
        return int((langid.common.mix(state + np.uint64(len(codes) - 1)) & np.uint64(langid.BUCKETS - 1))[0])

    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.log([0.5, 0.3, 0.2]), np.log(rng.random((3, langid.BUCKETS)) + 0.1))
    for text in ("Ab cd", "x", "é-è  12 ZZ top", "one two\nthree"):
        full = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        full = f" {full} "
        padded = [(full + "   ")[i : i + n] for n in langid.ORDERS for i in range(len(full) - 1)]
        total = model.prior + sum(model.log_prob[:, bucket(g)] for g in padded)
        p = np.exp(total - total.max())
        p /= p.sum()
        names, scores = langid.score(model, [text])
        assert names == [model.languages[int(p.argmax())]] and np.isclose(scores[0], p.max())
