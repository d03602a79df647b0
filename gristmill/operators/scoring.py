"""Scores of predictions against targets, coverage, latency blocks, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions.actions import ACTIONS, parsed_prediction


def judged(rows: DataFrame, has_parsed: bool = False) -> DataFrame:
    """Adds predicted, error, action_hit, point_hit and joint_hit.

    rows: target_action, target_box and prediction, or, with has_parsed, predicted_action, predicted_box and
    parse_error, where nulls count as a prediction that couldn't be parsed.
    """
    if has_parsed:
        action, box = F.lower("predicted_action"), F.col("predicted_box")
        good = action.isin(*ACTIONS) & (F.size(box) == 4) & F.forall(box, lambda v: (v >= 0) & (v <= 1000)) & (box[2] > box[0]) & (box[3] > box[1])
        error = F.when(~F.coalesce(good, F.lit(False)), F.coalesce(F.nullif(F.col("parse_error"), F.lit("")), F.lit("invalid_parsed_prediction")))
    else:
        rows = rows.withColumn("_parsed", parsed_prediction(F.col("prediction")))
        action, box, error = F.col("_parsed.action"), F.col("_parsed.box"), F.col("_parsed.error")
    out = rows.select("*", action.alias("predicted"), error.alias("error"), box.alias("_box")).drop("_parsed")
    x, y = (F.col("_box")[0] + F.col("_box")[2]) / 2.0, (F.col("_box")[1] + F.col("_box")[3]) / 2.0
    hit = F.coalesce(F.col("error").isNull() & G.point_in_box(x, y, F.col("target_box")), F.lit(False))
    same = F.coalesce(F.col("predicted") == F.lower("target_action"), F.lit(False))
    return out.select("*", same.alias("action_hit"), hit.alias("point_hit"), (same & hit).alias("joint_hit")).drop("_box")


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def f1(label: str) -> Column:
    target, own = F.coalesce(F.lower("target_action") == label, F.lit(False)), F.coalesce(F.col("predicted") == label, F.lit(False))
    tp, either = F.count_if(target & own), F.count_if(target) + F.count_if(own)
    return F.when(either == 0, 0.0).otherwise(2.0 * tp / either)


def score_columns() -> list[Column]:
    """Aggregates over judged rows."""
    per_label = [f1(a) for a in ACTIONS]
    present = [F.count_if(F.lower("target_action") == a) > 0 for a in ACTIONS]
    over = sum((F.when(p, v).otherwise(0.0) for p, v in zip(present, per_label, strict=True)), F.lit(0.0))
    labels = sum((p.cast("int") for p in present), F.lit(0))
    return [
        F.count("*").alias("num_samples"),
        F.count_if(F.col("error").isNull()).alias("num_parsed"),
        _share(F.col("error").isNull()).alias("parse_rate"),
        _share(F.col("action_hit")).alias("action_accuracy"),
        (sum(per_label, F.lit(0.0)) / len(ACTIONS)).alias("macro_all"),
        F.when(labels > 0, over / labels).otherwise(0.0).alias("macro_present"),
        _share(F.col("point_hit")).alias("ssr_point_only"),
        _share(F.col("joint_hit")).alias("joint_success"),
    ]


def finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def value_block(c: str) -> list[Column]:
    """count, mean, p50, p95, min, max of the finite values; percentiles are exact, by linear interpolation."""
    v = finite(c)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("p50"),
        F.percentile(v, F.lit(0.95)).alias("p95"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def runtime_block(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A value block for each field, as rows."""
    long = rows.unpivot([], fields, "field", "value")
    return long.groupBy("field").agg(*value_block("value"))


def throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds)


def coverage(targets: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One row: targets, predictions, joined, missing, unexpected, by one full join of distinct keys."""
    a = targets.select(key).distinct().withColumn("_t", F.lit(1))
    b = predictions.select(key).distinct().withColumn("_p", F.lit(1))
    both = a.join(b, key, "full")
    t, p = F.col("_t").isNotNull(), F.col("_p").isNotNull()
    return both.agg(
        F.count_if(t).alias("targets"), F.count_if(p).alias("predictions"), F.count_if(t & p).alias("joined"),
        F.count_if(t & ~p).alias("missing"), F.count_if(p & ~t).alias("unexpected"),
    )


def require_coverage(targets: DataFrame, predictions: DataFrame, key: str, allow_partial: bool = False) -> dict[str, int]:
    """Raises on unexpected keys and, unless partial results are allowed, on missing ones."""
    c = coverage(targets, predictions, key).first().asDict()
    if c["unexpected"] or (c["missing"] and not allow_partial):
        raise ValueError(f"{c['missing']} missing and {c['unexpected']} unexpected keys")
    return c


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; raises if a key comes twice."""
    twice = rows.groupBy(key).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[r[key] for r in twice]}")
    return rows


def percent_change(new: Column, old: Column) -> Column:
    return F.when(old != 0, 100.0 * (new - old) / old)
