"""Queries on scores, coverage, latency and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions.actions import ACTIONS, parse_prediction, render_action, replace_box
from gristmill.operators import scoring as S
from gristmill.plans.synth import h, predictions, scored_rows, sql_h, table, targets, with_sql

ROUND = 9


def _rounded(df, *keep):
    return df.select(*keep, *(F.round(c, ROUND).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep))


_F1 = """coalesce(2.0 * count(*) FILTER (target_action = '{a}' AND predicted = '{a}') / nullif(count(*) FILTER (target_action = '{a}') + count(*) FILTER (predicted = '{a}'), 0), 0)"""
_N = "(count(*) FILTER (target_action = '{a}') > 0)::INT"
_ALL = " + ".join(_F1.format(a=a) for a in ACTIONS)
_PRESENT = " + ".join(f"{_F1.format(a=a)} * {_N.format(a=a)}" for a in ACTIONS)
_LABELS = " + ".join(_N.format(a=a) for a in ACTIONS)
SCORE_SQL = f"""count(*) AS num_samples, count(*) FILTER (error IS NULL) AS num_parsed, round(avg((error IS NULL)::INT), 9) AS parse_rate,
 round(avg(action_hit::INT), 9) AS action_accuracy, round(({_ALL}) / 3, 9) AS macro_all, round(({_PRESENT}) / nullif({_LABELS}, 0), 9) AS macro_present,
 round(avg(point_hit::INT), 9) AS ssr_point_only, round(avg((action_hit AND point_hit)::INT), 9) AS joint_success"""


def score_overall(spark, d):
    return _rounded(S.judged(scored_rows(spark, d)).agg(*S.score_columns()))


def score_by_split(spark, d):
    return _rounded(S.judged(scored_rows(spark, d)).groupBy("event_type").agg(*S.score_columns()), "event_type")


def score_grouping_sets(spark, d):
    j = S.judged(scored_rows(spark, d)).withColumn("bucket", F.when(F.col("value") < 50, "low").otherwise("high"))
    g = j.groupingSets([[], ["event_type"], ["bucket"]], "event_type", "bucket")
    return _rounded(g.agg(*S.score_columns()), "event_type", "bucket")


def score_parsed_fields(spark, d):
    p = parse_prediction(F.col("prediction"))
    rows = scored_rows(spark, d).withColumns({"predicted_action": p["action"], "predicted_box": p["box"], "parse_error": p["error"]})
    return _rounded(S.judged(rows, has_parsed=True).agg(*S.score_columns()))


def score_per_label_f1(spark, d):
    j = S.judged(scored_rows(spark, d)).agg(*(S.f1(a).alias(a) for a in ACTIONS))
    return _rounded(j.unpivot([], list(ACTIONS), "label", "f1"), "label")


def parse_error_histogram(spark, d):
    return S.judged(scored_rows(spark, d)).filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n"))


def latency_percentiles(spark, d):
    return _rounded(table(spark, d, "events").groupBy("event_type").agg(*S.value_block("value")), "event_type")


def runtime_unpivot(spark, d):
    e = table(spark, d, "events").select(
        F.col("value").alias("seconds"), (h(F.col("event_id"), 9) % 5000).cast("double").alias("tokens"), F.when(h(F.col("event_id"), 10) % 3 > 0, F.col("value") * 2).alias("prefill")
    )
    e = e.withColumn("per_second", S.throughput(F.col("tokens"), F.col("seconds")))
    return _rounded(S.runtime_block(e, ["seconds", "tokens", "prefill", "per_second"]), "field")


def _partial(spark, d):
    """Predictions of the events whose user is a customer with an order."""
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    kept = table(spark, d, "events").join(buyers, "user_id", "left_semi").select("event_id")
    return predictions(spark, d).join(kept, "event_id", "left_semi")


def coverage_missing(spark, d):
    return targets(spark, d).join(_partial(spark, d), "event_id", "left_anti").select("event_id", "target_action")


def coverage_unexpected(spark, d):
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    return o.join(s, o.o_custkey == s.s_suppkey, "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


def coverage_struct(spark, d):
    return S.coverage(targets(spark, d).filter("value >= 5"), _partial(spark, d), "event_id")


def macro_average_nulls(spark, d):
    per = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(F.col("event_type") != "click", F.col("value"))).alias("latency"), F.avg("value").alias("score"))
    return _rounded(per.agg(F.avg("latency").alias("latency"), F.avg("score").alias("score"), F.count("*").alias("benchmarks")))


def context_bucket_metrics(spark, d):
    t = table(spark, d, "documents").select((F.col("n_chars") * 20).alias("tokens"))
    b = t.withColumn("bucket", G.context_bucket(F.col("tokens")))
    return _rounded(b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("tokens").alias("mean_tokens"), F.max("tokens").alias("max_tokens")), "bucket")


def paired_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("b"))
    both = S.unique(o, "o_orderkey").join(li, o.o_orderkey == li.l_orderkey)
    return _rounded(both.agg(F.count("*").alias("pairs"), F.avg((F.col("a") > F.col("b")).cast("double")).alias("share")))


def run_comparison(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 2).alias("run"))
    mean = lambda r: F.avg(F.when(F.col("run") == r, F.col("o_totalprice")))
    both = o.groupBy("o_orderpriority").agg(mean(0).alias("base"), mean(1).alias("new"))
    return both.select("o_orderpriority", F.round("base", 6).alias("base"), F.round("new", 6).alias("new"), F.round(S.percent_change(F.col("new"), F.col("base")), 6).alias("change"))


def sweep_gap(spark, d):
    j = S.judged(scored_rows(spark, d)).withColumn("step", (F.col("user_id") % 4 + 1) * 250)
    s = j.groupBy("step").agg((100 * F.avg(F.col("point_hit").cast("double"))).alias("ssr"))
    return _rounded(s.select("step", (F.col("step") / 100.0).alias("epochs"), "ssr", (F.col("ssr") - 83.31).alias("gap")), "step")


def primary_row(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n"))
    return o.select("o_custkey", "latest", "n")


def capacity_split(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(n <= 2000).alias("accepted"), F.count_if(n > 2000).alias("rejected"))


def action_round_trip(spark, d):
    t = targets(spark, d)
    text = render_action(F.col("target_action"), F.col("target_box"), F.lit("  see a@b.cd now "))
    t = t.select("event_id", text.alias("answer"))
    p = parse_prediction(F.col("answer"))
    moved = replace_box(F.col("answer"), F.array(*(F.lit(v) for v in (1, 2, 3, 4))))
    return t.select("event_id", "answer", p["action"].alias("action"), F.array_join(p["box"].cast("array<int>"), "/").alias("box"), p["value"].alias("value"), moved.alias("moved"))


QUERIES = {f.__name__: f for f in (
    score_overall, score_by_split, score_grouping_sets, score_parsed_fields, score_per_label_f1, parse_error_histogram, latency_percentiles,
    runtime_unpivot, coverage_missing, coverage_unexpected, coverage_struct, macro_average_nulls, context_bucket_metrics, paired_join,
    run_comparison, sweep_gap, primary_row, capacity_split, action_round_trip,
)}

_BLOCK = "count(v) AS n, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.95), 9) AS p95, round(min(v), 9) AS min, round(max(v), 9) AS max"
ORACLE = {
    "score_overall": with_sql(f"SELECT {SCORE_SQL} FROM judged"),
    "score_by_split": with_sql(f"SELECT event_type, {SCORE_SQL} FROM judged GROUP BY 1"),
    "score_grouping_sets": with_sql(
        f"SELECT event_type, bucket, {SCORE_SQL} FROM b GROUP BY GROUPING SETS ((), (event_type), (bucket))",
        "b AS (SELECT *, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS bucket FROM judged)",
    ),
    "score_parsed_fields": with_sql(f"SELECT {SCORE_SQL} FROM judged"),
    "score_per_label_f1": with_sql(" UNION ALL ".join(f"SELECT '{a}' AS label, round({_F1.format(a=a)}, 9) AS f1 FROM judged" for a in ACTIONS)),
    "parse_error_histogram": with_sql("SELECT error, count(*) AS n FROM judged WHERE error IS NOT NULL GROUP BY 1"),
    "latency_percentiles": f"SELECT event_type, {_BLOCK} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1",
    "runtime_unpivot": f"""WITH e AS (SELECT value AS seconds, ({sql_h("event_id", 9)} % 5000)::DOUBLE AS tokens, CASE WHEN {sql_h("event_id", 10)} % 3 > 0 THEN value * 2 END AS prefill FROM events),
      f AS (SELECT *, CASE WHEN seconds > 0 THEN tokens / seconds END AS per_second FROM e),
      l AS (SELECT 'seconds' AS field, seconds AS v FROM f UNION ALL SELECT 'tokens', tokens FROM f UNION ALL SELECT 'prefill', prefill FROM f UNION ALL SELECT 'per_second', per_second FROM f)
      SELECT field, {_BLOCK} FROM l GROUP BY 1""",
    "coverage_missing": with_sql("SELECT event_id, target_action FROM targets WHERE user_id NOT IN (SELECT o_custkey FROM orders)"),
    "coverage_unexpected": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "coverage_struct": """SELECT count(*) FILTER (t) AS targets, count(*) FILTER (p) AS predictions, count(*) FILTER (t AND p) AS joined, count(*) FILTER (t AND NOT p) AS missing,
      count(*) FILTER (p AND NOT t) AS unexpected FROM (SELECT coalesce(value >= 5, false) AS t, coalesce(user_id IN (SELECT o_custkey FROM orders), false) AS p FROM events)""",
    "macro_average_nulls": """SELECT round(avg(latency), 9) AS latency, round(avg(score), 9) AS score, count(*) AS benchmarks FROM
      (SELECT event_type, avg(CASE WHEN event_type <> 'click' THEN value END) AS latency, avg(value) AS score FROM events GROUP BY 1)""",
    "context_bucket_metrics": """SELECT CASE WHEN t <= 32768 THEN '16k_32k' WHEN t <= 49152 THEN '32k_48k' WHEN t <= 65536 THEN '48k_64k' ELSE 'over_64k' END AS bucket, count(*) AS n,
      round(avg(t), 9) AS mean_tokens, max(t) AS max_tokens FROM (SELECT n_chars * 20 AS t FROM documents) GROUP BY 1""",
    "paired_join": """SELECT count(*) AS pairs, round(avg((o_totalprice > b)::INT), 9) AS share FROM orders JOIN
      (SELECT l_orderkey, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "run_comparison": """WITH a AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS base, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS new FROM orders GROUP BY 1)
      SELECT o_orderpriority, round(base, 6) AS base, round(new, 6) AS new, round(100 * (new - base) / base, 6) AS change FROM a""",
    "sweep_gap": with_sql(
        "SELECT step, round(step / 100.0::DOUBLE, 9) AS epochs, round(ssr, 9) AS ssr, round(ssr - 83.31::DOUBLE, 9) AS gap FROM s",
        "s AS (SELECT (user_id % 4 + 1) * 250 AS step, 100 * avg(point_hit::INT) AS ssr FROM judged GROUP BY 1)",
    ),
    "primary_row": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS n FROM orders GROUP BY 1",
    "capacity_split": "SELECT lang, count(*) FILTER (n_chars <= 2000) AS accepted, count(*) FILTER (n_chars > 2000) AS rejected FROM documents GROUP BY 1",
    "action_round_trip": with_sql(
        """SELECT event_id, target_action || ' [' || c || ']' || v AS answer, target_action AS action, replace(c, ',', '/') AS box, CASE WHEN v = '' THEN '' ELSE 'see' END AS value,
        target_action || ' [1,2,3,4]' || v AS moved FROM r""",
        "r AS (SELECT *, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS c, CASE WHEN target_action = 'type_in' THEN ' see <EMAIL> now' ELSE '' END AS v FROM targets)",
    ),
}
