import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidelog.llm import covertree as ct


def clouds(rng, n, d=16):
    x = rng.normal(size=(n, d))
    for _ in range(n // 2):
        i, j = rng.integers(0, n, 2)
        x[i] = x[j] + rng.normal(size=d) * rng.choice([0, 0.01, 0.05, 0.12])
    return x


def wanted(ids, x, t=0.9):
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        cosine = x @ x.T / (norm[:, None] * norm)
    ok = np.nan_to_num(cosine, nan=-1) >= t
    np.fill_diagonal(ok, False)
    i, j = np.nonzero(ok)
    c = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)])
    return {k: (int(n), c[k]) for k, n in zip(ids, ok.sum(axis=1), strict=True)}


@pytest.mark.parametrize("n,d", [(1, 4), (300, 3), (1500, 16), (1200, 64)])
def test_dual_traversal_finds_each_pair_once(n, d):
    rng = np.random.default_rng(n)
    x, y = clouds(rng, n, d), clouds(rng, max(1, n // 2), d)
    y[: n // 10] = x[: n // 10] + 0.001
    for a, b, same in ((x, x, True), (x, y, False)):
        p, q = (ct.Tree(ct.unit(m), ct.build(ct.unit(m))) for m in (a, b))
        got = []
        for kind, i, j in ct.dual(p, q, 0.9, same):
            if kind == "one":
                ok = np.einsum("ij,ij->i", p.x[i], q.x[j]) >= 0.9
                got += zip(i[ok].tolist(), j[ok].tolist(), strict=True)
            else:
                got += [(u, v) for (fa, ea), (fb, eb) in zip(i.tolist(), j.tolist(), strict=True) for u in range(fa, ea) for v in range(fb, eb)]
        assert len(got) == len(set(got))
        i, j = np.nonzero(p.x @ q.x.T >= 0.9)
        assert {(min(g), max(g)) if same else g for g in got} == {(u, v) for u, v in zip(i.tolist(), j.tolist(), strict=True) if not same or u < v}


def test_table(spark, monkeypatch):
    monkeypatch.setattr(ct, "LEAST_CHUNK", 300)
    monkeypatch.setattr(ct, "MOST_CHUNK", 300)
    rng = np.random.default_rng(7)
    x = clouds(rng, 2000, 12).astype(np.float32)
    x[500:800] = x[500]
    x[900:1200] = x[900] + rng.normal(size=(300, 12)).astype(np.float32) * 0.02
    ids = [int(i) for i in rng.permutation(2000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ct.threshold_links(df).collect()}
    assert got == wanted(ids, x.astype(np.float64))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in ct.threshold_links(df).collect()]
    want = [(None, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in range(3, 11))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert ct.threshold_links(df.limit(0)).count() == 0


def test_each_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(ct, "LEAST_CHUNK", 100)
    monkeypatch.setattr(ct, "MOST_CHUNK", 100)
    rng = np.random.default_rng(9)
    parts, at = [(clouds(rng, n, d), n) for n, d in ((500, 12), (400, 7), (30, 3), (2, 1))], 0
    parts[-1] = np.array([[2.0], [3.0]]), 2
    rows, want = [], {}
    for x, n in parts:
        ids = list(range(at, at + n))
        at += n
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want |= wanted(ids, x)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ct.threshold_links(df).collect()}
    assert got == want and all(want[i][0] for i in (at - 1, at - 2))


def test_any_magnitude(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1e-200, 0.0]), (4, [1e200, 1e199]), (5, [5e-324, 0.0]), (6, [0.0, -1e308]), (7, [1.0, 0.0, 0.0]), (8, [1e-300, 0.0, 1e-301]), (9, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ct.threshold_links(df).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}
