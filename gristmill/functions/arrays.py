"""Running totals within arrays, in linear work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries whose totals are taken together.
BLOCK = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], deep: int = 1) -> Column:
    """What add makes, from zero, of all values before each one.

    Totals of blocks are taken first, and those of blocks of blocks, so each entry adds a bounded number of values; the type of zero is
    that of the totals.
    """
    of = lambda i: F.floor(i / BLOCK).cast("int")
    total = lambda xs: F.aggregate(xs, zero, add)

    def blocks(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), of(F.size(n) - 1)), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        base = running(sums, zero, add, deep - 1) if deep else bound(sums, lambda m: F.transform(m, lambda _, i: total(F.slice(m, F.lit(1), i))))
        within = lambda i: total(F.slice(n, of(i) * BLOCK + 1, i % BLOCK))
        return bound(base, lambda before: F.transform(n, lambda _, i: add(before[of(i)], within(i))))

    return bound(values, lambda n: F.when(F.size(n) > 0, blocks(n)).otherwise(F.slice(F.array(zero), 1, 0)))
