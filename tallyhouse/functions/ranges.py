"""Range lookups by equality.

An integer axis is covered by nested blocks: block ``i`` of level ``v`` holds
the values ``[i * 2**(b*v), (i+1) * 2**(b*v))``, where ``b`` is the number of
bits per level. A value lies in one block per level (:func:`blocks_of`); a
closed range is the disjoint union of a few blocks (:func:`blocks_covering`).
A range condition between two tables thereby turns into an equi-join on the
block number, whose size grows with the logarithm of the axis instead of with
the number of matching pairs. The level is stored in the high bits of the
block number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL_SHIFT = 48


def blocks_of(value: Column, levels: int, bits: int = 1) -> Column:
    """The blocks of levels ``0..levels`` that contain ``value``."""
    v = value.cast("long")
    return F.array(*[F.shiftright(v, bits * k) + (k << LEVEL_SHIFT) for k in range(levels + 1)])


def blocks_covering(low: Column, high: Column, levels: int, bits: int = 1) -> Column:
    """Disjoint blocks whose union is ``[low, high]``; empty if ``low > high``.

    A range longer than a block of the top level takes several of those.
    """
    none = F.array().cast("array<bigint>")
    up = 1 << bits

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def run(first: Column, end: Column, base: Column) -> Column:
        return F.when(first < end, F.sequence(base + first, base + end - 1)).otherwise(none)

    def at(level: Column, size: Column, low: Column, past: Column) -> Column:
        """Blocks of one level, less those inside whole blocks of the next."""
        base = level.cast("long") * (1 << LEVEL_SHIFT)
        first = div(low + size - 1, size)
        end = F.greatest(div(past, size), first)
        up_first = div(low + size * up - 1, size * up)
        up_end = div(past, size * up)
        split = (up_first < up_end) & (level < levels)
        return F.when(
            split, F.concat(run(first, up_first * up, base), run(up_end * up, end, base)),
        ).otherwise(run(first, end, base))

    sizes = F.array(*[F.lit(1 << (bits * k)).cast("long") for k in range(levels + 1)])
    ends = F.array(F.struct(low.cast("long").alias("low"), (high.cast("long") + 1).alias("past")))
    found = F.transform(ends, lambda e: F.flatten(F.transform(
        sizes, lambda size, level: at(level, size, e["low"], e["past"]))))[0]
    return F.when(low <= high, found).otherwise(none)


def levels_for(values: int, bits: int = 1) -> int:
    """Levels needed so that the top block holds ``values`` distinct values."""
    level = 0
    while (1 << (bits * level)) < max(values, 1):
        level += 1
    return level
