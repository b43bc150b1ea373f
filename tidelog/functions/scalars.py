"""Scalar formulas of the store as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def storage(value: Column, inline_size: int = 4096) -> Column:
    """Whether a value, with its one group byte, is kept inline or as a blob."""
    return F.when(F.octet_length(value) + 1 >= inline_size, "blob").otherwise("inline")


def stored_bytes(raw: Column, compressed: Column) -> Column:
    """Stored length; 0 compressed bytes mean that the record is raw."""
    return F.when(compressed == 0, raw).otherwise(compressed)


def compresses(raw: Column, compressed: Column) -> Column:
    """Whether compression pays: from 1 KiB on, and if it saves more than 16 bytes."""
    return (raw >= 1024) & (compressed + 16 < raw)


def sampled(seed: Column, shift: int = 6) -> Column:
    """One of 2^shift seeds; none from a shift of 63 on."""
    return F.lit(False) if shift >= 63 else seed.bitwiseAND(F.lit((1 << shift) - 1)) == 0


def two_choices(ticket: Column, groups: int) -> tuple[Column, Column]:
    """The two writer groups that a ticket may go to."""
    home = (ticket % groups).cast("int")
    if groups == 1:
        return home, home
    offset = F.lit(1) + F.floor(ticket / groups) % (groups - 1)
    return home, ((home + offset) % groups).cast("int")


def decline_rate(active_size: Column, total_size: Column, active_elems: Column, up2: Column, now: int) -> Column:
    """(active / free)^2 / (live elements x age); null where it would be infinite."""
    free = total_size - active_size
    age = F.lit(now) - up2
    rate = F.pow(active_size.cast("double") / free, 2) / (F.greatest(active_elems, F.lit(1)).cast("double") * age)
    return F.when((free != 0) & (age != 0), rate)


MIB = 1 << 20


def admission_burst(pool: Column, unit: Column) -> Column:
    limit = F.greatest(pool, F.lit(1))
    floor = F.least(F.greatest(F.floor(limit / 64), F.lit(MIB)), limit)
    return F.least(F.greatest(F.least(unit, F.floor(limit / 8)), floor), limit)


def admission_wake(burst: Column) -> Column:
    return F.least(F.greatest(F.floor(F.greatest(burst, F.lit(1)) / 8), F.lit(MIB)), F.greatest(burst, F.lit(1)))


def admitted(pool: Column, unit: Column, dirty: Column, progress: Column, reserved: Column, write: Column) -> Column:
    """Whether a write is let in at once. Beyond the pool's capacity a burst is, and a share of what a checkpoint has done."""
    limit, burst = F.greatest(pool, F.lit(1)), admission_burst(pool, unit)
    most = F.when(dirty >= limit, limit + burst + F.least(progress, burst * 3)).otherwise(limit)
    own = F.greatest(F.least(write, limit), F.lit(1))
    return (write == 0) | (F.greatest(dirty - progress, F.lit(0)) + reserved + own <= most)


def ewma(samples: Column) -> Column:
    """The integer average after an ordered array of samples: 20 % weight on a rise, 5 % on a fall; zeros are passed over."""
    step = lambda a, x: F.when(x == 0, a).when(a == 0, x).otherwise(F.call_function("div", a * (100 - F.when(x >= a, 20).otherwise(5)) + x * F.when(x >= a, 20).otherwise(5), F.lit(100)))
    return F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: step(a, x).cast("long"))
