import itertools

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import toxicity
from tidelog.llm.common import table
from tidelog.llm.queries import op2_toxic_spans


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(3, 6)), rng.normal(size=(2, 2))
    mask = np.array([[True] * 6, [True] * 4 + [False] * 2, [True] + [False] * 5])
    p, pairs = toxicity.marginals(emission, mask, transition, True)
    expected = np.zeros((2, 2))
    for row in range(3):
        n = mask[row].sum()
        total, one = 0.0, np.zeros(6)
        moves = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emission[row, k] for k in range(n) if y[k]) + sum(transition[a, b] for a, b in itertools.pairwise(y)))
            total += w
            one[:n] += w * np.array(y)
            for a, b in itertools.pairwise(y):
                moves[a, b] += w
        assert np.allclose(p[row], one / total)
        expected += moves / total
    assert np.allclose(pairs, expected)


def test_pieces_give_the_marginals_of_the_whole_chain():
    rng = np.random.default_rng(4)
    weight = np.concatenate([rng.normal(size=toxicity.FEATURES), [0.0]])
    sizes = [130, 0, 64, 65, 1, 700, 63, 128]
    first = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 2**63, (first[-1], 6)).astype(np.uint64)
    model = toxicity.Model(weight, np.array([[2.5, -2.0], [-2.0, 2.5]]), np.zeros(4))
    got = toxicity.token_marginals(model, hashes, first)
    emission = weight[toxicity._buckets(hashes)].sum(axis=1)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            want = toxicity.marginals(emission[None, a:b], np.ones((1, b - a), bool), model.transition)[0]
            assert np.abs(got[a:b] - want).max() < 1e-9


def test_few_labels_long_texts_and_conflicts(spark):
    rows = [(i, f"good words {i} and more of them") for i in range(60)] + [(100, "moron stupid " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 100)) for i, _ in rows] + [(100, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)  # one toxic document, of more than 50,000 characters, with both labels
    assert model.constant is None
    got = {r.doc_id: r.score for r in toxicity.tag(df, model).collect()}
    assert got[100] > max(got[i] for i in range(60))


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op2_toxic_spans(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert len(rows) > 800
    assert hit >= 0.95 * sum(r.toxic == 1 for r in rows)
    assert hit >= 0.95 * sum(r.predicted == 1 for r in rows)


def test_spans_and_cases(spark):
    clean = [(i, f"good words {i} and more of them é here") for i in range(120)]
    toxic = [(i, f"é good {['stupid', 'stupidly', 'moron'][i % 3]} moron words {i}") for i in range(200, 280)]
    rows = [*clean, *toxic]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("of", F.lit(1))
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int").withColumn("id", F.lit(2))
    model = toxicity.fit(df, labels)
    asked = spark.createDataFrame([(1, "é a stupid moron"), (2, "good words"), (3, None), (4, ""), (5, "good words " * 100_000 + "moron stupid"), (2, "good words"), (None, "good")], "doc_id long, text string")
    got = toxicity.tag(asked, model).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[k].predicted for k in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got) and by[3].score == by[4].score and by[3].spans == []
    assert [(s.start, s.end) for s in by[1].spans] == [(4, 16)]
    assert toxicity.tag(asked.limit(0), model).count() == 0
    none = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.tag(asked, none).collect()} == {0.0}
