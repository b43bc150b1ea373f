import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import decontam
from tidelog.llm.common import table
from tidelog.llm.queries import op5_latent_decontamination


def plain(text):
    return " ".join(re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", text)).lower()


def test_finds_the_items_that_documents_hold(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain(r.text) for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: plain(r.text) for r in table(spark, sf, "benchmark").collect()}
    held = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    rows = op5_latent_decontamination(spark, sf).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(held & got) >= 0.95 * len(held)
    assert len(got - held) <= 0.1 * len(held) + 1
    assert len(got) == len(rows)


def test_paraphrases_fragments_and_cases(spark):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((12, 20, 35, 60, 150))] + [(50, "two words"), (None, "a b c d e f g h"), (51, None), (52, "")]
    rows, want = [], set()
    for k in range(5):
        words = items[k][1].split()
        exact, changed, part = list(words), list(words), words[: len(words) // 3]
        for i in range(0, len(words), 6):
            changed[i] = rng.choice(vocab)
        for j, mid in enumerate((exact, changed, part, text(30))):
            rows.append((10 * k + j, ", ".join([*text(40), *mid, *text(70)])))
            if j < 2:
                want.add((10 * k + j, k))
    rows += [(100, None), (101, ""), (None, items[1][1]), (0, rows[0][1]), (102, "x " * 300_000 + items[2][1])]
    want.add((102, 2))
    rows += [(1000 + i, " ".join(text(300))) for i in range(300)]  # a latent space needs a corpus
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_finds_items_of_a_rare_source(spark):
    rng = random.Random(3)
    usual, rare = [f"u{i}" for i in range(2000)], [f"r{i}" for i in range(400)]
    pick = lambda words, n: [words[min(int(rng.paretovariate(0.7)), len(words)) - 1] for _ in range(n)]
    rows = [(k, " ".join(pick(usual, 60))) for k in range(30_000)]  # several times the documents of the former sample
    items, want = [], set()
    for k in range(20):
        words = [rng.choice(rare) for _ in range(14 + k)]
        items.append((k, " ".join(words)))
        rows.append((100_000 + k, " ".join([*pick(usual, 33), *words, *pick(usual, 30)])))
        want.add((100_000 + k, k))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(-1 <= r.cosine <= 1.001 for r in rows)


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randint(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        item = decontam.Item(1, np.array(a, np.uint64), np.ones(decontam.BUCKETS))
        n, start, end = decontam.common_subsequence(item, b)
        assert n == best[-1][-1] and decontam.common_subsequence(item, b[start:end])[0] == n


def test_stray_words_around_a_copy_do_not_hide_it():
    words = list(range(100, 120))
    item = decontam.Item(1, np.array(words, np.uint64), np.ones(decontam.BUCKETS))
    copy = [w if k % 4 else 7 for k, w in enumerate(words)]  # 15 of 20 words, in one stretch
    text = [*words[:1], *[5] * 20, *copy, *[6] * 20, *words[-1:]]
    n, start, end = decontam.common_subsequence(item, text)
    assert n == 16 and end - start > 40
    n, answer, held = decontam.judge(item, text)
    assert held and n >= 15 and answer >= decontam.ANSWER
    spread = [x for w in words for x in (w, 5, 6, 5)]
    assert not decontam.judge(item, spread)[2]


def test_judge_tries_every_short_stretch():
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randint(6, 14)
        words = [rng.randrange(20) for _ in range(size)]
        text = [rng.choice(words) if rng.random() < 0.35 else 50 for _ in range(rng.randint(1, 60))]
        item = decontam.Item(1, np.array(words, np.uint64), np.ones(decontam.BUCKETS))
        parts = [text[s : s + 2 * size] for s in range(max(1, len(text) - 2 * size + 1))]
        want = any(decontam.common_subsequence(item, p)[0] >= decontam.LCS * size and len(item.answer & set(p)) >= decontam.ANSWER * len(item.answer) for p in parts)
        assert decontam.judge(item, text)[2] == want


def test_short_and_very_long_items(spark):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = text(60_000)
    items = [(1, "alpha"), (2, "alpha beta"), (3, "gamma delta epsilon"), (4, "one two three four five"), (5, long)]
    changed = [w if i % 7 else "other" for i, w in enumerate(long.split())]
    rows = [
        (1, f"{text(20)} Alpha, beta {text(20)}"), (2, f"{text(20)} beta alpha {text(20)}"), (3, "gamma delta epsilon"), (4, "gamma delta x epsilon"),
        (5, f"{text(30)} one two three four five {text(9)}"), (6, f"one two three four {text(9)} five"), (7, long), (8, " ".join(changed)), (9, " ".join(changed[:20_000])),
    ]
    rows += [(1000 + i, text(300)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 3), (5, 4), (7, 5), (8, 5)}
    assert got[7, 5].lcs == 60_000 and 0.85 <= got[8, 5].lcs_share <= 0.87


def test_recall_against_the_rule_on_all_pairs(spark):
    """Documents and items for which judge() holds, over all pairs and without any candidate search."""
    rng = random.Random(12)
    usual = [f"w{i}" for i in range(2500)]
    pick = lambda n: [rng.choice(usual[:30] if rng.random() < 0.3 else usual) for _ in range(n)]
    items = [(k, pick(rng.randint(12, 45))) for k in range(40)]
    docs = {}
    for k, words in items:
        for j, share in enumerate((0, 0.15, 0.25, 0.35)):
            copy = [rng.choice(usual) if rng.random() < share else w for w in words]
            docs[10 * k + j] = [*pick(60), *copy, *pick(50)]
    docs |= {1000 + i: pick(150) for i in range(200)}
    import pyarrow as pa

    hashed = lambda words: decontam.hashes(pa.array([" ".join(words)]))[0]
    counts = np.zeros(decontam.BUCKETS)
    for words in docs.values():
        for s in range(0, len(words), decontam.PASSAGE):
            counts[np.unique(decontam.buckets(hashed(words[s : s + decontam.PASSAGE])))] += 1
    passages = sum(-(-len(w) // decontam.PASSAGE) for w in docs.values())
    idf = np.log((1.0 + passages) / (1.0 + counts))
    want = set()
    for k, words in items:
        item = decontam.Item(k, hashed(words), idf)
        want |= {(d, k) for d, text in docs.items() if decontam.judge(item, hashed(text).tolist())[2]}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
