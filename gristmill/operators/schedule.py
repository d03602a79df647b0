"""Blockwise commit schedules: which masked positions of a sequence are committed at which step.

A sequence is cut into blocks. In a block, steps are taken until no position is masked or the cap is reached; each step looks
at the confidences that are supplied for it. With a threshold, all masked positions that reach it are committed, or else the
most confident one, and the cap is twice the requested steps. Without one, every step commits a fixed number: the masked
positions over the steps, the remainder going to the first steps. Ties go to the first position.

Blocks don't depend on each other once their confidences are given, so each is a row of its own; the steps are a fold over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<done:array<int>,used:int>"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _best(done: Column, confidence: Column, k: Column) -> Column:
    """The k masked positions of the highest confidence; the first of equal ones."""
    masked = F.filter(F.transform(done, lambda d, j: F.struct((-confidence[j]).alias("c"), j.alias("j"), d.alias("d"))), lambda s: s["d"].isNull())
    return F.transform(F.slice(F.array_sort(masked), 1, k), lambda s: s["j"])


def _committed(done: Column, confidence: Column, chosen: Column, step: Column) -> Column:
    return _bound(chosen, lambda c: F.transform(done, lambda d, j: F.when(d.isNull() & F.array_contains(c, j), step).otherwise(d)))


def _reached(done: Column, confidence: Column, threshold: float) -> Column:
    at = F.transform(done, lambda d, j: F.when(d.isNull() & (confidence[j] >= threshold), j))
    return F.array_compact(at)


def committed(masked: Column, confidences: Column, steps: int, threshold: float | None = None) -> Column:
    """struct<committed: array<int>, iterations, remaining_masks> of a block.

    masked: array<boolean>; confidences: an array for each step, of the block's positions; the last one stands for all later
    steps. committed: the step (from 0) at which a position was committed; -1 for one that wasn't masked, null for one left masked.
    """
    cap = steps * 2 if threshold is not None else steps
    first = F.transform(masked, lambda m: F.when(~m, F.lit(-1)))
    total = F.size(F.filter(masked, lambda m: m))

    def step(acc, i):
        done = acc["done"]
        conf = F.element_at(confidences, F.least(i + 1, F.size(confidences)))
        if threshold is None:
            k = F.floor(total / steps).cast("int") + F.when(i < total % steps, 1).otherwise(0)
            new = _bound(conf, lambda c: _committed(done, c, _best(done, c, k), i))
            return F.struct(new.alias("done"), (acc["used"] + 1).alias("used"))
        over = _bound(conf, lambda c: _bound(_reached(done, c, threshold), lambda r: _committed(done, c, F.when(F.size(r) > 0, r).otherwise(_best(done, c, F.lit(1))), i)))
        left = F.exists(done, lambda d: d.isNull())
        return F.struct(F.when(left, over).otherwise(done).alias("done"), F.when(left, acc["used"] + 1).otherwise(acc["used"]).alias("used"))

    start = F.struct(first.alias("done"), F.lit(0).alias("used")).cast(STATE)
    end = F.aggregate(F.sequence(F.lit(0), F.lit(cap - 1)), start, lambda acc, i: step(acc, i).cast(STATE))
    return _bound(end, lambda e: F.struct(e["done"].alias("committed"), e["used"].alias("iterations"), F.size(F.filter(e["done"], lambda d: d.isNull())).alias("remaining_masks")))


def block_schedule(rows: DataFrame, key: str, masked: str, confidences: str, block: int, steps: int, threshold: float | None = None) -> DataFrame:
    """key, block, strategy, requested_steps, iterations, remaining_masks, committed: a row for each block of a sequence.

    masked: array<boolean> of the whole sequence, of which block must be a divisor; steps: those of the whole sequence, dealt evenly.
    """
    n = F.size(masked)
    check = F.when(n % block == 0, F.floor(n / block).cast("int")).otherwise(F.raise_error(F.lit(f"sequences must be whole blocks of {block}")).cast("int"))
    cut = rows.select(key, masked, confidences, F.when(check > 0, check).otherwise(0).alias("_n")).filter("_n > 0")
    cut = cut.select(key, "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.struct(
        F.slice(masked, b * block + 1, block).alias("masked"), F.transform(confidences, lambda c: F.slice(c, b * block + 1, block)).alias("confidences")
    ))).alias("block", "own"))
    counts = [r["_n"] for r in cut.select("_n").distinct().limit(2).collect()]
    if len(counts) > 1:
        raise ValueError("sequences must have the same number of blocks")
    own_steps = steps // counts[0] if counts else steps
    if counts and (own_steps < 1 or steps % counts[0]):
        raise ValueError(f"{steps} steps can't be dealt to {counts[0]} blocks")
    done = cut.select(key, "block", committed(F.col("own.masked"), F.col("own.confidences"), own_steps, threshold).alias("s"))
    strategy = "fixed_steps" if threshold is None else "confidence_threshold"
    return done.select(key, "block", F.lit(strategy).alias("strategy"), F.lit(own_steps).alias("requested_steps"), "s.iterations", "s.remaining_masks", "s.committed")
