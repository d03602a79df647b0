"""Deterministic samples, repeats, shards and orders, by stable hashes.

Numbers along the whole order of a table are taken in two steps, ranks within hash ranges and the sums of the
ranges before, so that no single task orders the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.hashing import stable_hex, uniform

#: Hex digits that name a range: 65,536 of them.
DIGITS = 4


def numbered(rows: DataFrame, order: list[str | Column], hex_column: str, name: str = "index") -> DataFrame:
    """Adds each row's place in the order of a hex hash, ties by ``order``."""
    dealt = rows.withColumn("_range", F.substring(hex_column, 1, DIGITS))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # The one task of this window has a row for each range, however many rows there are.
    base = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_base"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(hex_column, *order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(base), "_range").withColumn(name, F.col("_own") + F.col("_base")).drop("_range", "_own", "_base")


def stable_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows first by hash of seed and key."""
    hashed = rows.withColumn("_h", stable_hex(seed, F.col(key)))
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def balanced_repeat(rows: DataFrame, n: int, seed: int, key: str, tag: str = "selection") -> DataFrame:
    """n rows: each key comes once before any comes twice. Adds ``variant``, the number of the round."""
    hashed = rows.withColumn("_h", stable_hex(seed, tag, F.col(key)))
    placed = numbered(hashed, [key], "_h", "_i")
    total = placed.agg(F.count("*")).first()[0]
    if not total:
        raise ValueError("there is nothing to repeat")
    times = F.floor((n - 1 - F.col("_i")) / total).cast("int")
    return placed.filter(F.col("_i") < n).withColumn("variant", F.explode(F.sequence(F.lit(0), times))).drop("_h", "_i")


def top_up(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """All rows as variant 0, then rounds in an order of their own until there are n rows."""
    total = rows.count()
    if not total or n < total:
        raise ValueError(f"{n} rows can't be made of {total}")
    rounds = -(-n // total)
    every = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    hashed = every.withColumn("_h", stable_hex(seed, F.col("variant"), F.col(key)))
    last = hashed.filter(F.col("variant") == rounds - 1).orderBy("_h", key).limit(n - total * (rounds - 1))
    return hashed.filter(F.col("variant") < rounds - 1).union(last).drop("_h")


def priority_fill(first: DataFrame, rest: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """All of the first rows, and the rest by hash until there are n."""
    have = first.count()
    if have > n:
        raise ValueError(f"{have} rows come first, {n} are wanted")
    return first.unionByName(stable_sample(rest, n - have, seed, key))


def first_per_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def runs(rows: DataFrame, group: str, order: list[str], value: str, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal values within a group."""
    w = W.partitionBy(group).orderBy(*order)
    return rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def mixture(rows: DataFrame, weights: dict[str, float], seed: int, key: str) -> DataFrame:
    """Adds ``mix``: a group by hash, in proportion to the weights, the first whose cumulated share exceeds u."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    u, at, choice = uniform(seed, F.col(key)), 0.0, None
    for name, weight in weights.items():
        at += weight
        choice = F.when(u < at / total, name) if choice is None else choice.when(u < at / total, name)
    return rows.withColumn("mix", choice.otherwise(next(iter(weights))))


#: Units of an interleaving time for a weight of 1; times are whole numbers, so their sums don't depend on the order of adding.
TICKS = 1_000_000


def running_total(rows: DataFrame, group: str, order: list[str | Column], hex_column: str, value: str, name: str) -> DataFrame:
    """Adds the sum of a whole-number column over a group's rows up to each, in the order of a hex hash; ties by ``order``.

    Summed within hash ranges first, so no task orders a whole group.
    """
    dealt = rows.withColumn("_range", F.substring(hex_column, 1, DIGITS))
    sums = dealt.groupBy(group, "_range").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    own = F.sum(value).over(W.partitionBy(group, "_range").orderBy(hex_column, *order).rowsBetween(W.unboundedPreceding, 0))
    joined = dealt.withColumn("_own", own).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_range", "_own", "_base", "_g", "_r")


def interleaved(rows: DataFrame, group: str, weights: dict[str, float], seed: int, key: str) -> DataFrame:
    """Adds ``at``: the order of ``at`` and ``key`` takes, at every place, a row of each group that has rows left with a chance in
    proportion to its weight, whatever their numbers; a group's own rows come in a seeded order.

    A group's rows arrive like calls at a rate of its weight: the gaps between them are exponential, -ln(1 - u) over the weight.
    Merged by time, the next row of all is a group's with the chance of its share of the weights of those groups that have rows left,
    and an exhausted group leaves its share to the others. Rows of groups without a weight get null.
    """
    if not any(w > 0 for w in weights.values()):
        raise ValueError("a weight must be above 0")
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col(group) == name, float(w)).otherwise(weight) if w > 0 else weight
    gap = F.floor(-F.log(1 - uniform(seed, "gap", F.col(key))) * TICKS / F.col("_w")).cast("long")
    drawn = rows.withColumn("_w", weight).withColumns({"_h": stable_hex(seed, "order", F.col(key)), "_gap": gap})
    out = running_total(drawn.filter("_w IS NOT NULL"), group, [key], "_h", "_gap", "at").drop("_w", "_h", "_gap")
    return out.unionByName(drawn.filter("_w IS NULL").drop("_w", "_h", "_gap").withColumn("at", F.lit(None).cast("long")))


def shard(index: Column, world: int) -> Column:
    return F.pmod(index, F.lit(world)).cast("int")


def contiguous_shard(index: Column, total: Column, world: int, drop_rest: bool = False) -> Column:
    """Equal runs of places: rounded up, or rounded down with the rest in none."""
    if not drop_rest:
        return F.floor(index / F.ceil(total / world)).cast("int")
    size = F.floor(total / world)
    at = F.floor(index / size).cast("int")
    return F.when((size > 0) & (at < world), at)
