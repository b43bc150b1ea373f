"""Byte keys: prefix bounds, key ranges as predicates, encoded sizes and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest packed key, and largest key with value, in bytes.
MAX_KEY_BYTES, MAX_PAIR_BYTES = 64 << 10, 1 << 30
#: Bytes of the version that a packed key carries.
VERSION_BYTES = 12


def prefix_upper(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def varint_bytes(n: Column) -> Column:
    """Bytes of a number in seven-bit groups."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(n >= F.lit(1 << 7 * k), 1).otherwise(0)
    return out.cast("long")


def packed_key_bytes(key: Column) -> Column:
    """Bytes of a key with its version and length."""
    size = F.octet_length(key).cast("long") + VERSION_BYTES
    return size + varint_bytes(size)


def too_large(key: Column, value: Column) -> Column:
    packed = packed_key_bytes(key)
    return (packed > MAX_KEY_BYTES) | (packed + F.octet_length(value).cast("long") > MAX_PAIR_BYTES)


@dataclass(frozen=True)
class KeyRange:
    """Bounds of keys, as bytes or text like the key column; None is unbounded."""

    low: bytes | str | None = None
    high: bytes | str | None = None
    low_inclusive: bool = True
    high_inclusive: bool = False

    @classmethod
    def prefix(cls, prefix: bytes | str) -> KeyRange:
        """Keys that begin with prefix; all keys for the empty one."""
        if isinstance(prefix, str):
            # in UTF-8 the next code point is the next prefix; what can't be a bound is left to the low side
            for cut in range(len(prefix), 0, -1):
                code = ord(prefix[cut - 1]) + 1
                code = 0xE000 if code == 0xD800 else code
                if code < 0x110000:
                    return cls(prefix, prefix[: cut - 1] + chr(code))
            return cls(prefix or None, None)
        return cls(prefix or None, prefix_upper(prefix))

    @property
    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or (self.low == self.high and not (self.low_inclusive and self.high_inclusive))

    def predicate(self, key: Column) -> Column:
        """Comparisons that reach the scan; a literal false for an inverted range, which prunes the scan away."""
        if self.empty:
            return F.lit(False)
        out = F.lit(True)
        if self.low is not None:
            out = out & (key >= F.lit(self.low) if self.low_inclusive else key > F.lit(self.low))
        if self.high is not None:
            out = out & (key <= F.lit(self.high) if self.high_inclusive else key < F.lit(self.high))
        return out
