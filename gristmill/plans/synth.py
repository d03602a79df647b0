"""Inputs made from the tables by hashes, in Spark and, for comparison, in SQL.

Every event is a target (an action and a box) with a prediction as text, which may be empty, malformed, out of
range, another action or beside the box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(key: Column, i: int) -> Column:
    """The i-th group of four hex digits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 4 * i + 1, 4), 16, 10).cast("int")


def sql_h(key: str, i: int) -> str:
    return f"('0x' || substr(sha256(CAST({key} AS VARCHAR)), {4 * i + 1}, 4))::INT"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    x1, y1 = h(k, 1) % 800, h(k, 2) % 800
    box = F.array(*(v.cast("double") for v in (x1, y1, x1 + 1 + h(k, 3) % 150, y1 + 1 + h(k, 4) % 150)))
    return e.select(
        "event_id", "event_type", "value", "user_id",
        F.element_at(F.array(*map(F.lit, ("lclick", "hover", "type_in"))), h(k, 0) % 3 + 1).alias("target_action"), box.alias("target_box"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, box = F.col("event_id"), F.col("target_box")
    t = targets(spark, sf_dir)
    other = F.element_at(F.array(*map(F.lit, ("lclick", "hover", "type_in"))), (h(k, 0) + 1) % 3 + 1)
    action = F.when(h(k, 6) % 5 == 0, other).otherwise(F.col("target_action"))
    move = F.when(h(k, 7) % 4 == 0, 170).otherwise(h(k, 8) % 5)
    coords = F.concat_ws(", ", *((box[i].cast("int") + (move if i % 2 == 0 else 0)).cast("string") for i in range(4)))
    text = F.concat(action, F.lit(" ["), coords, F.lit("]"), F.when(action == "type_in", " some words").otherwise(""))
    kind = h(k, 5) % 20
    spoiled = (
        F.when(kind == 0, "").when(kind == 1, "nothing to click").when(kind == 2, "lclick [10, 20, 10, 30]")
        .when(kind == 3, "hover [0, 0, 1001, 5]").when(kind == 4, F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(text)
    )
    return t.select("event_id", spoiled.alias("prediction"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).join(predictions(spark, sf_dir), "event_id")


#: targets, predictions, parsed and judged, as common table expressions over events.
SQL = f"""
targets AS (
  SELECT event_id, event_type, value, user_id, ['lclick','hover','type_in'][{sql_h("event_id", 0)} % 3 + 1] AS target_action,
         ['lclick','hover','type_in'][({sql_h("event_id", 0)} + 1) % 3 + 1] AS other_action,
         {sql_h("event_id", 1)} % 800 AS x1, {sql_h("event_id", 2)} % 800 AS y1,
         {sql_h("event_id", 1)} % 800 + 1 + {sql_h("event_id", 3)} % 150 AS x2, {sql_h("event_id", 2)} % 800 + 1 + {sql_h("event_id", 4)} % 150 AS y2,
         {sql_h("event_id", 5)} % 20 AS kind, {sql_h("event_id", 6)} % 5 AS swap,
         CASE WHEN {sql_h("event_id", 7)} % 4 = 0 THEN 170 ELSE {sql_h("event_id", 8)} % 5 END AS move
  FROM events),
texts AS (
  SELECT *, CASE WHEN swap = 0 THEN other_action ELSE target_action END AS said FROM targets),
predictions AS (
  SELECT *, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'nothing to click' WHEN 2 THEN 'lclick [10, 20, 10, 30]' WHEN 3 THEN 'hover [0, 0, 1001, 5]'
    ELSE (CASE WHEN kind = 4 THEN '<s>' ELSE '' END) || said || ' [' || (x1 + move) || ', ' || y1 || ', ' || (x2 + move) || ', ' || y2 || ']'
      || (CASE WHEN said = 'type_in' THEN ' some words' ELSE '' END) || (CASE WHEN kind = 4 THEN '</s>' ELSE '' END) END AS prediction
  FROM texts),
matched AS (
  SELECT *, regexp_extract(prediction, '(?i)(^|[^A-Za-z0-9_])(lclick|hover|type_in)\\s*\\[\\s*([-+]?[0-9.]+)\\s*,\\s*([-+]?[0-9.]+)\\s*,\\s*([-+]?[0-9.]+)\\s*,\\s*([-+]?[0-9.]+)\\s*\\](\\s+([^\\r\\n<]*))?',
    ['pre','action','a','b','c','d','gap','said_value']) AS m FROM predictions),
parsed AS (
  SELECT *, nullif(lower(m.action), '') AS predicted, try_cast(m.a AS DOUBLE) AS px1, try_cast(m.b AS DOUBLE) AS py1, try_cast(m.c AS DOUBLE) AS px2, try_cast(m.d AS DOUBLE) AS py2
  FROM matched),
errors AS (
  SELECT *, CASE WHEN trim(prediction) = '' THEN 'empty_prediction' WHEN predicted IS NULL THEN 'action_or_bbox_not_found'
    WHEN least(px1, py1, px2, py2) < 0 OR greatest(px1, py1, px2, py2) > 1000 THEN 'bbox_out_of_range'
    WHEN px2 <= px1 OR py2 <= py1 THEN 'degenerate_bbox' END AS error FROM parsed),
judged AS (
  SELECT *, coalesce(predicted = target_action, false) AS action_hit,
    coalesce(error IS NULL AND (px1 + px2) / 2 BETWEEN x1 AND x2 AND (py1 + py2) / 2 BETWEEN y1 AND y2, false) AS point_hit FROM errors)
"""


def with_sql(select: str, more: str = "") -> str:
    return f"WITH {SQL}{', ' + more if more else ''} {select}"
