import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import tokencount
from tidelog.llm.common import table, vocabulary
from tidelog.llm.queries import op7_token_count


def greedy(word, entries, longest):
    at = n = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in entries)
        n += 1
    return n


def test_small_vocabularies():
    rng = random.Random(1)
    for _ in range(40):
        entries = [bytes([b]) for b in range(256)] + list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 7))) for _ in range(25)})
        automaton, known, longest = tokencount.Automaton(entries), set(entries), max(map(len, entries))
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
        want = [greedy(w, known, longest) for w in words]
        assert [automaton.count(w) for w in words] == want
        assert automaton.counts(words).tolist() == want
    with pytest.raises(ValueError):
        tokencount.Automaton([b"a"])


def test_whole_table(spark):
    import regex

    tokens, pattern = vocabulary()
    known, longest = set(tokens), max(map(len, tokens))
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = {}
    for r in rows:
        words = regex.findall(pattern, r.text)
        want[r.doc_id] = (len(words), sum(greedy(w.encode(), known, longest) for w in words))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op7_token_count(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_cases(spark):
    tokens, pattern = vocabulary()
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (3, "the the"), (None, "the"), (4, "你好 \u0000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n_words", F.lit("clash"))
    got = tokencount.count_tokens(df, tokens, pattern).collect()
    assert len(got) == 6 and {(r.n_words, r.n_tokens) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    known, longest = set(tokens), max(map(len, tokens))
    assert max(r.n_tokens for r in got) == greedy(b"x" * 100_000, known, longest)
    assert tokencount.count_tokens(df.limit(0), tokens, pattern).count() == 0
