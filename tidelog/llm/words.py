"""Words and word shingles of Arrow string columns as 64-bit hashes, without a Python string for each."""

from __future__ import annotations

import numpy as np

from tidelog.llm.common import mix

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix(np.arange(1, (1 << 14) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words where punctuation doesn't count: ASCII letters and digits, and all others than ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NEXT = np.uint64(0x9FB21C651E98DF25)


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each row's begin; a null has none."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(column, breaks: bool = False, members: np.ndarray = _IN_WORD):
    """A hash of each word (A-Z lower-cased, split at white space) and the index of each row's first word, with an end.

    members: which bytes words are made of, if not all but white space.
    With breaks, also the byte at which each word begins within its row, its byte after the last, and the bytes' start.
    """
    data, at = _bytes(column)
    inside = members[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    counted = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=counted[1:])
    first = counted[at]
    begin = np.flatnonzero(starts)
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), first, empty, empty, at) if breaks else (np.zeros(0, np.uint64), first)
    used = data[inside]
    owner_end = np.cumsum(inside)
    offset = np.concatenate([[0], owner_end])[begin]
    sizes = np.diff(np.append(offset, len(used)))
    place = np.arange(len(used)) - np.repeat(offset, sizes)
    if sizes.max() <= len(_PLACE):
        weight = _PLACE[place]
    else:
        weight = mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    out = np.add.reduceat(_BYTE[_LOWER[used]] * weight, offset)
    out = mix(out + sizes.astype(np.uint64) * _NEXT)
    return (out, first, begin, begin + sizes, at) if breaks else (out, first)


def prefix_hashes(column, sizes: tuple[int, ...], members: np.ndarray = _IN_WORD):
    """For each word a hash of it and of its first so many bytes (a column each); the rest as word_hashes with breaks."""
    whole, first, begin, end, at = word_hashes(column, True, members)
    data, _ = _bytes(column)
    out = np.empty((len(whole), 1 + len(sizes)), np.uint64)
    out[:, 0] = whole
    if len(whole):
        length = end - begin
        most = max(sizes)
        head = np.minimum(length, most)
        offset = np.cumsum(head) - head
        place = np.arange(head.sum()) - np.repeat(offset, head)
        value = _BYTE[_LOWER[data[np.repeat(begin, head) + place]]] * _PLACE[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        for k, n in enumerate(sizes, 1):
            out[:, k] = mix(total[offset + np.minimum(head, n)] - total[offset] + np.minimum(length, n).astype(np.uint64) * _NEXT + np.uint64(n))
    return out, first, begin, end, at


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles, in order and with repeats; of a row with fewer words, of its whole sequence."""
    total = len(hashes)
    counts = np.diff(first)
    state = hashes.copy()
    for k in range(1, n):
        if total > k:
            state[: total - k] = mix(state[: total - k] * _NEXT + hashes[k:])
    keep = np.ones(total, bool)
    row_end = np.repeat(first[1:], counts)
    keep[np.arange(total) + n > row_end] = False
    short = np.flatnonzero((counts > 0) & (counts < n))
    for row in short:
        whole = hashes[first[row]]
        for h in hashes[first[row] + 1 : first[row + 1]]:
            whole = mix(np.array([whole]) * _NEXT + h)[0]
        state[first[row]] = mix(np.array([whole]) + np.uint64(counts[row]))[0]
        keep[first[row]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return state[keep], kept[first]


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    shingles, at = shingle_hashes(*word_hashes(column), n)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
