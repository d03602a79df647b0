"""Generation benchmarks: rules over detected objects, questions with dependencies, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import broad_category, detailed_category

# Fixed values of the benchmark.
THRESHOLD, COUNTING_THRESHOLD, MAX_OBJECTS, POSITION_THRESHOLD = 0.3, 0.9, 16, 0.1


def pixel_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes whose borders belong to them; 0 without any area."""
    side = lambda low, high: F.greatest(high - low + 1, F.lit(0.0))
    area = lambda c: side(c[0], c[2]) * side(c[1], c[3])
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = area(a) + area(b) - both
    return F.when(union != 0, both / union).otherwise(0.0)


def top_objects(detections: DataFrame, keys: list[str], score: str, counting: str | None = None, n: int = MAX_OBJECTS) -> DataFrame:
    """Detections above the threshold (of counting prompts, if the column says so), the n best of each class."""
    bound = F.when(F.col(counting), COUNTING_THRESHOLD).otherwise(THRESHOLD) if counting else F.lit(THRESHOLD)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), *[c for c in detections.columns if c not in keys and c != score]))
    return detections.filter(F.col(score) > bound).withColumn("rank", rank).filter(F.col("rank") <= n)


def suppressed(detections: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Greedy suppression within each key, best rank first: a box that overlaps a kept one by the threshold or more goes.

    Groups hold at most MAX_OBJECTS rows of a class (top_objects), so a fold over an array of them stays small. A
    threshold of 1 keeps all.
    """
    if threshold == 1:
        return detections
    rest = [c for c in detections.columns if c not in keys and c != "rank"]
    ranked = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("_all"))
    apart = lambda kept, x: F.forall(kept, lambda k: pixel_iou(k["box"], x["box"]) < threshold)
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ranked.select(*keys, F.explode(kept).alias("_x")).select(*keys, "_x.*").select(*detections.columns)


def relative(a: Column, b: Column) -> Column:
    """Where box a lies of box b: an array of sides, none if they are too close."""
    middle = lambda c, i: (c[i] + c[i + 2]) / 2
    extent = lambda c, i: F.abs(c[i + 2] - c[i])
    off = [middle(a, i) - middle(b, i) for i in (0, 1)]
    rest = [F.greatest(F.abs(o) - POSITION_THRESHOLD * (extent(a, i) + extent(b, i)), F.lit(0.0)) * F.signum(o) for i, o in enumerate(off)]
    length = F.sqrt(off[0] * off[0] + off[1] * off[1])
    dx, dy = (F.try_divide(r, length) for r in rest)
    side = lambda name, holds: F.when(holds, F.lit(name))
    sides = F.array_compact(F.array(side("left of", dx < -0.5), side("right of", dx > 0.5), side("above", dy < -0.5), side("below", dy > 0.5)))
    near = (F.abs(rest[0]) < 1e-3) & (F.abs(rest[1]) < 1e-3)
    return F.when(near, F.slice(sides, 1, 0)).otherwise(sides)


def judged_rules(objects: str, include: str, exclude: str) -> Column:
    """struct correct, reason: whether all clauses hold, by a fold over the clauses in order.

    objects: array<struct<class,box,color>>, best first. Clauses: array<struct<class,count,color,side,of>>, where of is the
    place (from 0) of an earlier clause. One with a side holds if all its objects lie so of all objects of the clause
    it names; if that clause failed, so does this one. Excluded classes must have fewer than their count.
    """
    word = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    all_of = lambda name: F.filter(objects, lambda o: o["class"] == name)

    def step(acc, c):
        found = F.slice(all_of(c["class"]), 1, c["count"])
        colored = F.size(F.filter(found, lambda o: o["color"] == c["color"]))
        target = F.get(acc["groups"], c["of"])
        beside = F.exists(found, lambda o: F.exists(target["found"], lambda t: ~F.array_contains(relative(o["box"], t["box"]), c["side"])))
        problem = (
            F.when(F.size(found) < c["count"], word("expected ", c["class"], ">=", number(c["count"]), ", found ", number(F.size(found))))
            .when(c["color"].isNotNull() & (colored < c["count"]), word("expected ", c["color"], " ", c["class"], ">=", number(c["count"]), ", found ", number(colored), " ", c["color"]))
            .when(c["side"].isNotNull() & ~F.coalesce(target["ok"], F.lit(False)), word("no target for ", c["class"], " to be ", c["side"]))
            .when(c["side"].isNotNull() & beside, word("expected ", c["class"], " ", c["side"], " target"))
        )
        group = F.struct(problem.isNull().alias("ok"), found.alias("found"))
        problems = F.when(problem.isNull(), acc["problems"]).otherwise(F.concat(acc["problems"], F.array(problem)))
        return F.struct(F.concat(acc["groups"], F.array(group)).alias("groups"), problems.alias("problems"))

    none = F.slice(F.transform(objects, lambda o: F.struct(F.lit(True).alias("ok"), F.array(o).alias("found"))), 1, 0)
    start = F.struct(none.alias("groups"), F.array().cast("array<string>").alias("problems"))
    wanted = F.aggregate(include, start, step, lambda acc: acc["problems"])
    unwanted = F.array_compact(F.transform(exclude, lambda c: F.when(
        F.size(all_of(c["class"])) >= c["count"], word("expected ", c["class"], "<", number(c["count"]), ", found ", number(F.size(all_of(c["class"]))))
    )))
    problems = F.concat(wanted, unwanted)
    return F.struct((F.size(problems) == 0).alias("correct"), F.array_join(problems, "\n").alias("reason"))


def gated(rows: DataFrame, item: str, order: str = "order") -> DataFrame:
    """rows: item, order, question, score, parents array<int>. Adds gated, by a fold over an item's questions in order.

    The fold carries the questions that stand at 0, at first those scored 0: one with such a parent joins them. Parent 0
    is none; one that the item doesn't have is an error.
    """
    rest = [c for c in rows.columns if c not in (item, order)]
    asked = rows.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_all"))
    wrong = F.transform(F.filter("_all", lambda q: q["score"] == 0), lambda q: q["question"])
    known = F.transform("_all", lambda q: q["question"])
    other = lambda p: F.when(F.array_contains(known, p), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("no question "), p.cast("string"))).cast("boolean"))
    falls = lambda zero, q: F.exists(q["parents"], lambda p: F.when(p == 0, F.lit(False)).when(F.array_contains(zero, p), F.lit(True)).otherwise(other(p)))
    zero = F.aggregate("_all", wrong, lambda acc, q: F.when(falls(acc, q), F.concat(acc, F.array(q["question"]))).otherwise(acc))
    each = asked.select(item, zero.alias("_zero"), F.explode("_all").alias("_q"))
    value = F.when(F.array_contains("_zero", F.col("_q.question")), 0.0).otherwise(F.col("_q.score").cast("double"))
    return each.select(item, "_q.*", value.alias("gated")).select(*rows.columns, "gated")


def questions(csv: DataFrame, index: str = "row_index", item: str = "item_id") -> DataFrame:
    """Without data row 0; of an item whose rows come in several runs, the last run."""
    kept = csv.filter(F.col(index) > 0)
    # A row opens a run if the row before it is another item's; rows of one item are numbered by runs.
    before = kept.select((F.col(index) + 1).alias(index), F.col(item).alias("_before"))
    opened = kept.join(before, index, "left").withColumn("_open", (~F.col(item).eqNullSafe(F.col("_before"))).cast("int"))
    w = W.partitionBy(item).orderBy(index)
    numbered = opened.withColumn("_run", F.sum("_open").over(w))
    return numbered.withColumn("_last", F.max("_run").over(W.partitionBy(item))).filter("_run = _last").drop("_before", "_open", "_run", "_last")


def category_rollup(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Means by broad and detailed category in one pass; the broad ones pool rows, not means."""
    named = rows.select(broad_category(F.col(label)).alias("l1"), detailed_category(F.col(label)).alias("l2"), F.col(score).cast("double").alias("s"))
    return named.rollup("l1", "l2").agg(F.avg("s").alias("mean_score"), F.count("*").alias("n"))


def tag_summary(rows: DataFrame, tag: str, prompt: str, correct: str, order: str) -> DataFrame:
    """Per tag, in order of first appearance: share of correct images and of prompts with any correct one."""
    by_prompt = rows.groupBy(tag, prompt).agg(
        F.count("*").alias("n"), F.count_if(F.col(correct)).alias("good"), F.bool_or(F.col(correct)).cast("int").alias("any"), F.min(order).alias("first")
    )
    return by_prompt.groupBy(tag).agg(
        F.sum("n").alias("images"), (F.sum("good") / F.sum("n")).alias("image_share"), F.avg("any").alias("prompt_share"), F.min("first").alias("first_seen")
    )


def overall(rows: DataFrame, tag: str, prompt: str, correct: str) -> DataFrame:
    """One row: images, prompts, their shares of correct ones, and the mean of the tags' shares, each tag counting alike.

    A prompt is correct if any of its images is; prompts that tags share are counted once.
    """
    c = F.coalesce(F.col(correct), F.lit(False))
    by_both = rows.select(F.col(tag).alias("_t"), F.col(prompt).alias("_p"), c.alias("_c")).groupBy("_t", "_p").agg(F.count("*").alias("n"), F.count_if("_c").alias("good"))
    tags = by_both.groupBy("_t").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    score = tags.agg(F.sum("n").alias("images"), (F.sum("good") / F.sum("n")).alias("image_share"), F.avg(F.col("good") / F.col("n")).alias("task_mean"))
    prompts = by_both.groupBy("_p").agg(F.max((F.col("good") > 0).cast("int")).alias("any")).agg(F.count("*").alias("prompts"), F.avg("any").alias("prompt_share"))
    return score.crossJoin(prompts)  # a row each
