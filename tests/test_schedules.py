"""Weighted orders and commit schedules against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.operators import sampling as P
from gristmill.operators import schedule as C


def test_shares_hold_at_every_prefix(spark):
    sizes, weights = {"a": 3000, "b": 900, "c": 300, "d": 50, "e": 10}, {"a": 1.0, "b": 3.0, "c": 2.0, "d": 0.0}
    rows = spark.createDataFrame([(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)], "key string, g string")
    out = P.interleaved(rows, "g", weights, 5, "key")
    assert out.filter("at is null").groupBy("g").count().collect() != [] and out.filter("at is null and g not in ('d', 'e')").count() == 0
    order = [r.g for r in out.filter("at is not null").orderBy("at", "key").collect()]
    assert Counter(order) == {g: sizes[g] for g in "abc"}
    left, expected, seen, spread = dict(sizes), dict.fromkeys("abc", 0.0), Counter(), 0.0
    for g in order:
        total = sum(weights[x] for x in "abc" if left[x])
        for x in "abc":
            expected[x] += weights[x] / total if left[x] else 0
        spread += 0.25
        seen[g] += 1
        left[g] -= 1
        assert all(abs(seen[x] - expected[x]) <= 4.5 * spread**0.5 + 3 for x in "abc")
    again = [r.g for r in P.interleaved(rows.repartition(7), "g", weights, 5, "key").filter("at is not null").orderBy("at", "key").collect()]
    assert again == order and [r.g for r in P.interleaved(rows, "g", weights, 6, "key").filter("at is not null").orderBy("at", "key").collect()] != order
    with pytest.raises(ValueError):
        P.interleaved(rows, "g", {"a": 0.0}, 5, "key")


def test_null_groups_and_empty_tables(spark):
    rows = spark.createDataFrame([("x", None), ("y", "a")], "key string, g string")
    assert {r.key: r["at"] is None for r in P.interleaved(rows, "g", {"a": 1.0}, 1, "key").collect()} == {"x": True, "y": False}
    assert P.interleaved(rows.limit(0), "g", {"a": 1.0}, 1, "key").collect() == []


def plain(masked, confidences, steps, threshold):
    done = [None if m else -1 for m in masked]
    total, used = sum(masked), 0
    for i in range(steps * 2 if threshold is not None else steps):
        c = confidences[min(i, len(confidences) - 1)]
        open_ = sorted((j for j, d in enumerate(done) if d is None), key=lambda j: (-c[j], j))
        if threshold is None:
            chosen = open_[: total // steps + (i < total % steps)]
        elif not open_:
            break
        else:
            chosen = [j for j in open_ if c[j] >= threshold] or open_[:1]
        used += 1
        for j in chosen:
            done[j] = i
    return done, used, sum(d is None for d in done)


@pytest.mark.parametrize("threshold", [None, 0.9, 0.3, 2.0])
def test_equals_a_plain_loop(spark, threshold):
    r = random.Random(3)
    rows = []
    for i in range(60):
        masked = [r.random() < r.choice([0.0, 0.5, 1.0]) for _ in range(24)]
        rows.append((i, masked, [[r.choice([0.1, 0.3, 0.5, 0.9, 0.95]) for _ in range(24)] for _ in range(r.randrange(1, 8))]))
    df = spark.createDataFrame(rows, "k int, m array<boolean>, c array<array<double>>")
    for block, steps in ((8, 9), (24, 5), (12, 10)):
        got = {(x.k, x.block): (x.committed, x.iterations, x.remaining_masks) for x in C.block_schedule(df, "k", "m", "c", block, steps, threshold).collect()}
        for k, masked, confidences in rows:
            for b in range(24 // block):
                cut = slice(b * block, (b + 1) * block)
                assert got[k, b] == plain(masked[cut], [c[cut] for c in confidences], steps // (24 // block), threshold)
        assert len(got) == 60 * 24 // block


def test_odd_sequences(spark):
    df = spark.createDataFrame([(1, [True] * 5, [[0.1] * 5])], "k int, m array<boolean>, c array<array<double>>")
    with pytest.raises(Exception, match="whole blocks"):
        C.block_schedule(df, "k", "m", "c", 4, 4).collect()
    with pytest.raises(ValueError, match="steps"):
        C.block_schedule(df, "k", "m", "c", 1, 4)
    empty = df.select("k", F.array().cast("array<boolean>").alias("m"), "c")
    assert C.block_schedule(empty, "k", "m", "c", 4, 4).collect() == [] == C.block_schedule(df.limit(0), "k", "m", "c", 4, 4).collect()
