import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tidelog.llm import byte_bpe


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocabulary(tokens):
    return byte_bpe.Vocabulary(tokens)


@pytest.fixture(scope="module")
def tik(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


TEXTS = ["", " ", "Hello, world!", "naïve ßtraße 你好 🙂🙂", "a" * 500, "ab" * 300, "  \n\n\t x  y", "don't we'll 12345678 ***$$$", "é" * 77, "\u0000\u0001", "x" * 5000 + "é" + "zq" * 1000, "<|endoftext|>"]


def test_matches_the_library(spark, tokens, tik):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdefgh éß\n1.,你") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "null id", 1), (7, None, 2), (7, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = byte_bpe.encode_decode(df, tokens, public_tokenizers.PATTERN)
    want = {(i, t): tik.encode_ordinary(t or "") for i, t, _ in rows}
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in rows) == sorted([(i or -1, tuple(w)) for (i, _), w in want.items()] + [(7, ())])
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert sorted(bytes(r.decoded) for r in rows) == sorted([*(t.encode() for t in texts), b"null id", b"", b""])


def test_digests_and_empty_table(spark, tokens, tik):
    df = spark.createDataFrame([(1, "Das ist größer.")], "doc_id long, text string")
    (r,) = byte_bpe.encode_decode(df, tokens, public_tokenizers.PATTERN, digests=True).collect()
    ids = tik.encode_ordinary("Das ist größer.")
    assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256("Das ist größer.".encode()).hexdigest()
    assert byte_bpe.encode_decode(df.limit(0), tokens, public_tokenizers.PATTERN).count() == 0


def test_appends_and_edits(vocabulary):
    rng = random.Random(5)
    encoder = byte_bpe.PrefixEncoder(vocabulary)
    for _ in range(300):
        if rng.random() < 0.5:
            encoder.append("".join(rng.choice("theraonwiß") for _ in range(rng.randint(0, 9))).encode())
        else:
            start = rng.randint(0, len(encoder.data))
            end = rng.randint(start, min(len(encoder.data), start + 6))
            encoder.replace(start, end, "".join(rng.choice("theraonwi") for _ in range(rng.randint(0, 6))).encode())
        assert encoder.last == vocabulary.prefixes(encoder.data)
        assert encoder.ids == vocabulary.encode(encoder.data)
    long = byte_bpe.PrefixEncoder(vocabulary, b"the other thing in the long run " * 200)
    assert long.replace(40, 41, b"zz") < 1000
    assert long.last == vocabulary.prefixes(long.data)
