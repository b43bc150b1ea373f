"""Byte-level BPE by prefix dynamic programming.

For a byte string b, ``last[i]`` is the one token that ends the encoding of ``b[:i + 1]``. It is the suffix token t of that
prefix for which (last token of what stands before t, t) is a pair that BPE would leave apart. A prefix's entry depends on
no later byte, so appending only adds entries, and after an edit only entries from there on are computed anew, until as many
in a row as the longest token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidelog.llm import common

#: Distinct pieces whose ids a worker remembers, and token pairs of which it knows whether they stay apart.
CACHE_ROWS, PAIR_ROWS = 300_000, 200_000
_NONE = 1 << 62


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    return [tokens[i] for i in range(len(tokens))]


class Vocabulary:
    """Tokens, what each is merged from, and which neighbours BPE leaves apart."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=1)
        self.known: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.ids.get(t[:cut], _NONE), self.ids.get(t[cut:], _NONE)
                if a < i and b < i and self.apart(a, b):
                    self.left[i], self.right[i] = a, b
                    self.pairs[a, b] = i
                    break
        self.lengths = [len(t) for t in tokens]
        self._automaton()

    def _automaton(self) -> None:
        """The trie of all tokens with failure links: its node after a prefix knows which tokens are suffixes of it."""
        self.moves: dict[int, int] = {}
        end, parents = {}, [(0, 0)]
        for i, t in enumerate(self.tokens):
            node = 0
            for byte in t:
                if (to := self.moves.get(node << 8 | byte)) is None:
                    to = self.moves[node << 8 | byte] = len(parents)
                    parents.append((node, byte))
                node = to
            if len(t) == 1 or self.left[i] != i:  # a token that no merge makes ends no prefix
                end[node] = i
        self.fail = [0] * len(parents)
        self.suffixes: list[tuple[int, ...]] = [()] * len(parents)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            parent, byte = parents[node]
            if parent:
                self.fail[node] = self._fall(self.fail[parent], byte)
            self.suffixes[node] = ((end[node],) if node in end else ()) + self.suffixes[self.fail[node]]
        self.falls: dict[int, int] = {}

    def _fall(self, node: int, byte: int) -> int:
        while (to := self.moves.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return to

    def apart(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these two."""
        left, right, pairs, limit = self.left, self.right, self.pairs, _NONE
        while True:
            if pairs.get((a, b), _NONE) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def extend(self, data: bytes, nodes: list[int], last: list[int], most: int = _NONE) -> None:
        """Add the automaton's node and the last token of each further prefix of data, at most so many."""
        moves, falls, known, lengths, suffixes = self.moves, self.falls, self.known, self.lengths, self.suffixes
        node = nodes[-1] if nodes else 0
        for i in range(len(last), min(len(data), len(last) + most)):
            key = node << 8 | data[i]
            if (to := moves.get(key)) is None and (to := falls.get(key)) is None:
                if len(falls) >= PAIR_ROWS:
                    falls.clear()
                to = falls[key] = self._fall(node, data[i])
            node = to
            for token in suffixes[node]:
                before = i - lengths[token]
                if before < 0:
                    break
                pair = last[before] << 32 | token
                if (apart := known.get(pair)) is None:
                    if len(known) >= PAIR_ROWS:
                        known.clear()
                    apart = known[pair] = self.apart(last[before], token)
                if apart:
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            nodes.append(node)
            last.append(token)

    def prefixes(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, [], last)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids that a list of last tokens stands for."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= self.lengths[last[i - 1]]
        return out[::-1]

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of pieces in byte order: what a piece shares with the one before it is not computed again."""
        before, nodes, last = b"", [], []
        for piece in pieces:
            if (token := self.ids.get(piece)) is not None:
                yield [token]
                continue
            shared = len(os.path.commonprefix((before, piece)))
            del nodes[shared:], last[shared:]
            self.extend(piece, nodes, last)
            before = piece
            yield self.walk(last)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece: a token if it is one, as encoders of this kind look first, else the BPE encoding."""
        token = self.ids.get(piece)
        return [token] if token is not None else self.walk(self.prefixes(piece))


class PrefixEncoder:
    """The encoding of one piece that grows at its end and may be edited anywhere."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.nodes: list[int] = []
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.nodes, self.last)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put data in the place of bytes start to end; returns how many entries were computed."""
        nodes, old, shift = self.nodes, self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.nodes, self.last, agreed, done = nodes[:start], old[:start], 0, 0
        for i in range(start, len(self.data)):
            self.vocabulary.extend(self.data, self.nodes, self.last, 1)
            done += 1
            was = i - shift
            agreed = agreed + 1 if was >= end and old[was] == self.last[i] else 0
            if agreed >= self.vocabulary.longest:
                self.nodes += nodes[was + 1 :]
                self.last += old[was + 1 :]
                break
        return done

    @property
    def ids(self) -> list[int]:
        token = self.vocabulary.ids.get(self.data)
        return [token] if token is not None else self.vocabulary.walk(self.last)


class _Pieces(dict):
    """Ids of pieces as little-endian bytes, and in decoded what these ids decode to; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.decoded: dict[str, bytes] = {}
        self.long: list[str] = []

    def learn(self, pieces: set[str]) -> None:
        """Make sure that these pieces are known. Long ones stay until others are asked for."""
        for piece in self.long:
            self.pop(piece, None)
            self.decoded.pop(piece, None)
        if len(self) >= CACHE_ROWS:
            self.clear()
            self.decoded.clear()
        token = self.vocabulary.tokens
        new = sorted((p.encode(), p) for p in pieces if p not in self)
        self.long = [p for _, p in new if len(p) > 64]
        for (_, piece), ids in zip(new, self.vocabulary.encode_sorted([b for b, _ in new]), strict=True):
            self[piece] = struct.pack(f"<{len(ids)}I", *ids)
            self.decoded[piece] = b"".join([token[i] for i in ids])


_ready: dict[bytes, _Pieces] = {}


def _pieces(tokens: list[bytes]) -> _Pieces:
    key = hashlib.sha1(b"\0".join(tokens)).digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = _Pieces(Vocabulary(tokens))
    return _ready[key]


def encode_decode(df: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns the id, n_tokens, ids (array of int) and decoded (binary) of each row; with digests, ids_sha256 and
    decoded_sha256 (lower-case hex) stand for the last two. A null text counts as empty: no tokens, digests of nothing.
    Repeated rows give repeated results, a null id stays null, an empty table gives an empty one; columns beside
    the two named ones are not read, so their names may clash with nothing. Memory is bounded by one text and the
    piece cache. tokens is a vocabulary of fixed size and travels in the task.
    """
    common.ship(df.sparkSession)
    kept = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches) -> Iterator:
        import pyarrow as pa
        import regex

        cache = _pieces(kept.value)
        find = regex.compile(pattern).findall
        for batch in batches:
            for start, end in common.pieces(batch.column(1)):
                counts, first, second = [], [], []
                found = [find(text or "") for text in batch.column(1).slice(start, end - start).to_pylist()]
                cache.learn(set().union(*found))
                for pieces in found:
                    ids = b"".join(map(cache.__getitem__, pieces))
                    decoded = b"".join(map(cache.decoded.__getitem__, pieces))  # what a piece's ids decode to, however often it stands
                    counts.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                    second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                columns = [batch.column(0).slice(start, end - start), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    pair = "string" if digests else "array<int>"
    out = source.mapInArrow(common.lean(run), f"id {kind}, n_tokens long, ids {pair}, decoded {'string' if digests else 'binary'}")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return out.toDF(id_col, "n_tokens", *names)
