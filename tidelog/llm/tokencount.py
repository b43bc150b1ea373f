"""Token counts by a linear longest-match automaton.

Greedy longest match takes, from the left, the longest vocabulary entry that a word goes on with. The automaton is the
entries' trie; a node's failure link leads to where matching goes on once no edge fits, and its number of popped tokens says
how many entries are complete by then. So a word is counted in one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidelog.llm import common

#: Distinct words whose counts a worker remembers; words of more bytes are counted one by one and not remembered.
CACHE_ROWS, LONG = 500_000, 128


class Automaton:
    """Edges as sorted keys (node x 256 + byte), failure links and popped-token counts of a vocabulary with all single bytes."""

    def __init__(self, tokens: list[bytes]):
        edges: dict[int, int] = {}
        parents, is_token = [(0, 0)], [False]
        for t in tokens:
            node = 0
            for byte in t:
                to = edges.setdefault(node << 8 | byte, len(parents))
                if to == len(parents):
                    parents.append((node, byte))
                    is_token.append(False)
                node = to
            if node:
                is_token[node] = True
        if any(not is_token[edges.get(b, 0)] for b in range(256)):
            raise ValueError("each single byte must be an entry")
        self.edges = edges
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            parent, byte = parents[node]
            if is_token[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            z, pops = self.fail[parent], self.pops[parent]
            while (to := edges.get(z << 8 | byte)) is None:
                pops += self.pops[z]
                z = self.fail[z]
            self.fail[node], self.pops[node] = to, pops
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.fails, self.popped = np.array(self.fail), np.array(self.pops)

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = out = 0
        for byte in word:
            while (to := edges.get(node << 8 | byte)) is None:
                out += pops[node]
                node = fail[node]
            node = to
        while node:
            out += pops[node]
            node = fail[node]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of many words: all step together, each by an edge, or by a failure link where none fits."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        out, node, which = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        while len(which):
            key = node << 8 | data[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[k] == key) & (at < end)
            out[which[~fits]] += self.popped[node[~fits]]
            node = np.where(fits, self.to[k], self.fails[node])
            at = at + fits
            going = (at < end) | (node > 0)
            which, node, at, end = which[going], node[going], at[going], end[going]
        return out


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        return self.automaton.count(word.encode())

    def learn(self, words: set[str]) -> None:
        if len(self) >= CACHE_ROWS:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= LONG]
        self.update(zip(new, self.automaton.counts([w.encode() for w in new]).tolist(), strict=True))


_ready: dict[bytes, _Counts] = {}


def _counts(tokens: list[bytes]) -> _Counts:
    key = hashlib.sha1(b"\0".join(tokens)).digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = _Counts(Automaton(tokens))
    return _ready[key]


def count_tokens(df: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words (matches of pattern) and n_tokens (greedy longest-match tokens of them all) of each whole text.

    A null or empty text has none of either. Repeated rows give repeated results, a null id stays null, an empty table gives
    an empty one, and columns that aren't named are not read. The vocabulary has a fixed size and travels as a broadcast.
    """
    common.ship(df.sparkSession)
    kept = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches) -> Iterator:
        import pyarrow as pa
        import regex

        cache, find = _counts(kept.value), regex.compile(pattern).findall
        for batch in batches:
            for start, end in common.pieces(batch.column(1)):
                found = [find(t or "") for t in batch.column(1).slice(start, end - start).to_pylist()]
                cache.learn(set().union(*found))
                totals = [sum(map(cache.__getitem__, words)) for words in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([len(w) for w in found], pa.int64()), pa.array(totals, pa.int64())], ["id", "n_words", "n_tokens"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(common.lean(run), f"id {kind}, n_words long, n_tokens long").toDF(id_col, "n_words", "n_tokens")
