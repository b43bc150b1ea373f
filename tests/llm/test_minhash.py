import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidelog.llm import minhash
from tidelog.llm.common import table
from tidelog.llm.components import components
from tidelog.llm.queries import op10_minhash_forest


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute.near_duplicates(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash_forest(spark, sf).collect()}
    assert got == want


def test_cases(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 120):  # a group of near copies, some of them near only through others
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, "\n".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "One\x0btwo"), (207, "x " * 300_000), (208, "x x"), (209, "É é"), (210, "é é")]
    df = spark.createDataFrame([*rows, (205, "one two"), (None, "one two")], "doc_id long, text string")
    df = df.withColumn("n", F.lit(1)).withColumn("id", F.lit(2)).withColumn("rep", F.lit(3))
    got = minhash.near_duplicates(df, 2).collect()
    assert len(got) == len(rows) + 2
    want = brute.near_duplicates(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    (null,) = [r for r in got if r.doc_id is None]
    assert null.component_id is None and null.kept is False
    assert minhash.near_duplicates(df.limit(0), 2).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2000)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, 9000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(17)).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_group_with_isolated_members(spark):
    """Variants around the threshold, more than the neighbours looked at, in several components."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(4000)}"
        rows.append((i * 3, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2).collect()}
    want = brute.near_duplicates(rows, 2)
    assert 1 < len({c for _, c in want.values()}) < 700
    assert got == want
