import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tidelog.llm import paradedup
from tidelog.llm.common import table
from tidelog.llm.queries import op4_paragraph_dedup


def test_shared_passages_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, brute.words(r.text)) for r in table(spark, sf, "documents").collect()]
    by = {}
    for d, w in rows:
        for i in range(len(w) - 50):
            by.setdefault(hash(tuple(w[i : i + 51])), set()).add(d)
    want = {d for ds in by.values() if len(ds) > 1 for d in ds}
    by = {}
    for d, w in rows:
        for i in range(len(w) - 22):
            by.setdefault(hash(tuple(w[i : i + 23])), set()).add(d)
    most = {d for ds in by.values() if len(ds) > 1 for d in ds}
    got = op4_paragraph_dedup(spark, sf).collect()
    assert want and want <= {r.doc_id for r in got} <= most


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(31, 70))] for _ in range(30)]
    rows, lines = [], []
    for d in range(120):
        mine = []
        for _ in range(rng.randint(1, 3)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append((len(lines), d, " ".join(w)))
            mine.append(" ".join(w))
        rows.append((d, "\n\n".join([*mine, "short line"])))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, "z " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("low", F.lit(1))
    got = paradedup.repeats(df).where("kind = 'paragraph'").collect()
    want = {k: c for k, (_, c) in brute.near_duplicates([(k, t) for k, _, t in lines], 5).items()}
    groups = {}
    for k, d, _ in lines:
        groups.setdefault(want[k], []).append(d)
    expected = sorted(sorted(ds) for ds in groups.values() if len(set(ds)) > 1)
    found = {}
    for r in got:
        found.setdefault(r.component, []).append(r)
    assert sorted(sorted(r.doc_id for r in rs) for rs in found.values()) == expected
    assert all(sum(r.kept for r in rs) == 1 and min((r.doc_id, r.low) for r in rs) == next((r.doc_id, r.low) for r in rs if r.kept) for rs in found.values())
    assert paradedup.repeats(df.limit(0)).count() == 0


def test_passage_is_set_into_other_text_and_removed(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(40):
        passage = text(51)
        rows += [(2 * k, f"{text(33)} {passage} {text(9)}"), (2 * k + 1, f"{text(7)} {passage}\n{text(50)}")]
    rows += [(1000 + k, text(120)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paradedup.repeats(df)
    got = found.where("kind = 'passage'").collect()
    assert {r.doc_id for r in got} == set(range(80)) and {r.doc_id for r in got if r.kept} == set(range(0, 80, 2))
    left = {r.doc_id: r.text for r in paradedup.remove(df, found).collect()}
    assert all(left[d] == t for d, t in rows if d % 2 == 0 or d >= 1000)
    assert all(len(left[d].split()) <= 57 + 51 - 32 for d in range(1, 80, 2))


def test_each_of_joined_passages_keeps_a_copy(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"j{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(10):
        p, q = text(90), text(90)
        bodies = (f"{text(20)} {p} {text(20)}", f"{text(15)} {q} {text(20)}", f"{text(10)} {p} {q} {text(5)}", f"{p} {q}")
        rows += [(4 * k + j, body) for j, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paradedup.repeats(df).where("kind = 'passage'")
    left = {r.doc_id: r.text for r in paradedup.remove(df, found).collect()}
    assert all(left[d] == t for d, t in rows if d % 4 < 2)
    assert all(len(left[d].split()) < 150 for d in range(2, 40, 4)) and all(len(left[d].split()) <= 2 * 16 for d in range(3, 40, 4))
    kept, gone = ({(r.doc_id, w) for r in found.collect() if r.kept == k for w in range(r.low, r.high)} for k in (True, False))
    assert kept and gone and not kept & gone


def test_short_documents_and_ids_with_two_texts(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"s{rng.randrange(10**6)}" for _ in range(n))
    same, short, p, q = text(29), "two words", text(60), text(60)
    rows = [(i, same) for i in range(20)] + [(30, short), (31, short), (32, f"{short}\n{text(20)}")]
    rows += [(40, p), (40, q), (41, f"{text(9)} {p}"), (42, f"{text(9)} {q}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paradedup.repeats(df)
    got = paradedup.repeats(df, least_words=1).where("kind = 'paragraph' and doc_id < 40").collect()
    assert sorted(r.doc_id for r in got) == [*range(20), 30, 31, 32] and sorted(r.doc_id for r in got if r.kept) == [0, 30]
    by = {}
    for r in found.where("kind = 'passage'").collect():
        by.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, by.values())) == [[40, 41], [40, 42]]
    left = sorted((r.doc_id, r.text) for r in paradedup.remove(df, found).collect() if r.doc_id == 40)
    assert left == sorted([(40, p), (40, q)])


def test_anchors_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (5, 100, 31, 400, 0, 60)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    at, key = paradedup.anchored(np.concatenate(parts), first)
    alone = [paradedup.anchored(p, np.array([0, len(p)])) for p in parts]
    assert at.tolist() == [int(a + f) for (xs, _), f in zip(alone, first, strict=False) for a in xs]
    assert key.tolist() == [int(k) for _, ks in alone for k in ks]
