"""Queries on boxes, windows, tiles and token arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions import twister as K
from gristmill.functions.hashing import stable_hex
from gristmill.operators.spatial import near_pairs
from gristmill.plans.synth import h, sql_h, table


def _boxes(spark, d):
    """Raw boxes that may be turned, empty or outside an image of 1280 x 720, and a second box."""
    e, k = table(spark, d, "events"), F.col("event_id")
    v = [h(k, i) % 1600 - 100 for i in range(8)]
    return e.select("event_id", F.array(*(x.cast("double") for x in v[:4])).alias("a"), F.array(*(x.cast("double") for x in v[4:])).alias("b"), F.lit(1280).alias("w"), F.lit(720).alias("h"))


_BOXES = f"b AS (SELECT event_id, {', '.join(f'({sql_h("event_id", i)} % 1600 - 100)::DOUBLE AS v{i}' for i in range(8))} FROM events)"
_show = lambda c: F.array_join(c, "/")


def bbox_normalize(spark, d):
    return _boxes(spark, d).select("event_id", _show(G.normalize_box(F.col("a"), F.col("w"), F.col("h"))).alias("box"))


def bbox_scale_repair(spark, d):
    a = F.col("a")
    return _boxes(spark, d).select("event_id", _show(G.scale_unit_box(F.array(*(a[i] / 1000.0 for i in range(4))))).alias("box"))


def bbox_unscale(spark, d):
    u = G.unscale(F.col("a"), F.col("w"), F.col("h"))
    return _boxes(spark, d).select("event_id", *(F.round(u[i], 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def bbox_overlap(spark, d):
    s = lambda c: F.array(F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3]))
    x = _boxes(spark, d).withColumns({"a": s(F.col("a")), "b": s(F.col("b"))})
    a, b = F.col("a"), F.col("b")
    return x.select(
        "event_id", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.iou(a, b, 1), 9).alias("pixel_iou"), F.round(G.edge_distance(a, b, F.col("w"), F.col("h")), 9).alias("distance"),
        G.point_in_box(G.center(a)[0], G.center(a)[1], b).alias("inside"), G.valid_box(a).alias("valid"),
    )


def match_scores(spark, d):
    k = F.col("event_id")
    s, dist, c, o = (h(k, i) % 1000 / F.lit(1000.0) for i in range(4))
    return table(spark, d, "events").select("event_id", F.round(G.match_score(s, dist, c, o), 9).alias("score"), G.allowed_distance(s).alias("allowed"))


def tile_layout(spark, d):
    k = F.col("page_id")
    t = table(spark, d, "pages").select("page_id", (h(k, 0) % 3000 + 1).alias("w"), (h(k, 1) % 6000 + 1).alias("h"))
    t = t.select("page_id", F.explode(G.tile_layout(F.col("w"), F.col("h"))).alias("t"))
    return t.select("page_id", "t.index", F.array_join("t.box_xyxy", "/").alias("box"), "t.patch_tokens")


def sequence_lengths(spark, d):
    t = tile_layout(spark, d).groupBy("page_id").agg(F.count("*").alias("tiles"), F.sum("patch_tokens").alias("patches"))
    total = G.sequence_tokens(F.col("patches"), F.col("tiles"), F.lit(30))
    return t.select("page_id", total.alias("tokens"), G.context_bucket(total).alias("bucket"))


def crop_window(spark, d):
    k = F.col("event_id")
    lo, size = h(k, 0) % 1000, F.lit(1400)
    start, length = G.crop_axis(lo.cast("double"), (lo + 1 + h(k, 1) % 380).cast("double"), size, 500)
    return table(spark, d, "events").select("event_id", start.alias("start"), length.alias("length"))


def seeded_crops(spark, d):
    """Windows of 500 that hold a target, at a seeded place of those that are possible along either axis."""
    k = F.col("event_id")
    x, y = h(k, 0) % 1000, h(k, 1) % 700
    box = F.array(*(v.cast("double") for v in (x, y, x + 1 + h(k, 2) % 380, y + 1 + h(k, 3) % 350)))
    rows = table(spark, d, "events").select("event_id", box.alias("box"))
    crop = K.seeded_crop(F.col("box"), F.lit(1400), F.lit(1100), 500, stable_hex(42, k, "crop", 0))
    return rows.select("event_id", F.array_join("box", ",").alias("box"), crop.alias("crop")).select("event_id", "box", F.array_join("crop", ",").alias("crop"))


def near_boxes(spark, d):
    """For every event's box the others of the same user within a twentieth of the diagonal: their number and the nearest."""
    k = F.col("event_id")
    x, y = h(k, 0) % 1200, h(k, 1) % 680
    box = F.array(*(v.cast("double") for v in (x, y, x + 10 + h(k, 2) % 60, y + 5 + h(k, 3) % 30)))
    rows = table(spark, d, "events").select("user_id", "event_id", box.alias("box"))
    pairs = near_pairs(rows.withColumns({"width": F.lit(1280), "height": F.lit(720)}), rows.select("user_id", F.col("event_id").alias("other"), F.col("box").alias("other_box")), "user_id", 0.05)
    found = pairs.filter("event_id <> other").groupBy("event_id").agg(F.count("*").alias("n"), F.min_by("other", F.struct(F.round("distance", 9), "other")).alias("nearest"))
    return found.select("event_id", "n", "nearest")


def resize_dims(spark, d):
    k = F.col("page_id")
    r = G.resize_dims(h(k, 0) % 3000 + 50, h(k, 1) % 3000 + 50, 1024, 512, 16, 600_000)
    return table(spark, d, "pages").select("page_id", r[0].alias("width"), r[1].alias("height"), G.image_tokens(r[0], r[1], 16).alias("tokens"))


def relative_position(spark, d):
    k = F.col("event_id")
    box = lambda i: F.array(*(x.cast("double") for x in (h(k, i) % 500, h(k, i + 1) % 500, h(k, i) % 500 + 10 + h(k, i + 2) % 90, h(k, i + 1) % 500 + 10 + h(k, i + 3) % 90)))
    return table(spark, d, "events").select("event_id", F.array_join(G.relative_positions(box(0), box(4)), " and ").alias("where"))


def loss_weights(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", *(F.round(G.length_weight(n, m), 9).alias(m) for m in ("token", "sample", "square")))


def power_pad(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", G.next_power_of_two(n).alias("padded"))


def chunk_split(spark, d):
    from gristmill.functions.hashing import uniform

    n = F.col("n_chars")
    t = table(spark, d, "documents").select("doc_id", n, G.chunk_count(n, uniform("split", F.col("doc_id"))).alias("k"))
    s = G.even_split(n, F.col("k"))
    return t.select("doc_id", F.col("k").alias("chunks"), F.array_max(s).alias("largest"), F.array_min(s).alias("smallest"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def timestep_schedule(spark, d):
    t = table(spark, d, "region").select("r_regionkey", F.posexplode(G.timesteps(8, 3.0)).alias("i", "t"))
    return t.select("r_regionkey", "i", F.round("t", 9).alias("t"))


QUERIES = {f.__name__: f for f in (
    bbox_normalize, bbox_scale_repair, bbox_unscale, bbox_overlap, match_scores, tile_layout, sequence_lengths, crop_window, seeded_crops, near_boxes, resize_dims, relative_position,
    loss_weights, power_pad, chunk_split, timestep_schedule,
)}


def _axis_sql(lo: str, hi: str) -> str:
    a, b = (f"round_even(least(1000, greatest(0, {v})), 0)::INT" for v in (lo, hi))
    return (
        f"(CASE WHEN {b} <= {a} AND {a} >= 1000 THEN 999 ELSE {a} END)",
        f"(CASE WHEN {b} <= {a} AND {a} >= 1000 THEN 1000 WHEN {b} <= {a} THEN {a} + 1 ELSE {b} END)",
    )


def _box_sql(x1, y1, x2, y2):
    (a, c), (b, e) = _axis_sql(x1, x2), _axis_sql(y1, y2)
    return f"{a} || '/' || {b} || '/' || {c} || '/' || {e}"


_c = lambda v, top: f"least({top}, greatest(0, {v}))"
_TILES = f"""p AS (SELECT page_id, {sql_h("page_id", 0)} % 3000 + 1 AS w, {sql_h("page_id", 1)} % 6000 + 1 AS h FROM pages),
 g AS (SELECT *, ceil(w / 980)::INT AS cols, ceil(h / 980)::INT AS rows FROM p),
 i AS (SELECT *, unnest(range(cols * rows))::INT AS index FROM g),
 t AS (SELECT page_id, index, (index % cols) * 980 AS x, (index // cols) * 980 AS y, least(980, w - (index % cols) * 980) AS tw, least(980, h - (index // cols) * 980) AS th FROM i),
 tiles AS (SELECT page_id, index, x || '/' || y || '/' || (x + tw) || '/' || (y + th) AS box, (ceil(tw / 14) * ceil(th / 14))::INT AS patch_tokens FROM t)"""
_SORTED = "s AS (SELECT event_id, least(v0,v2) AS a0, least(v1,v3) AS a1, greatest(v0,v2) AS a2, greatest(v1,v3) AS a3, least(v4,v6) AS b0, least(v5,v7) AS b1, greatest(v4,v6) AS b2, greatest(v5,v7) AS b3 FROM b)"


def _iou_sql(p: int) -> str:
    area = lambda x1, y1, x2, y2: f"(greatest({x2} - {x1} + {p}, 0) * greatest({y2} - {y1} + {p}, 0))"
    both = area("greatest(a0,b0)", "greatest(a1,b1)", "least(a2,b2)", "least(a3,b3)")
    union = f"({area('a0', 'a1', 'a2', 'a3')} + {area('b0', 'b1', 'b2', 'b3')} - {both})"
    return f"round(CASE WHEN {union} > 0 THEN {both} / {union} ELSE 0 END, 9)"


_hs = lambda i, k="event_id": sql_h(k, i)
_STEP = lambda v: f"greatest(16, round_even({v} / 16, 0)::INT * 16)"
ORACLE = {
    "bbox_normalize": f"""WITH {_BOXES}, n AS (SELECT event_id, least({_c("v0", 1280)}, {_c("v2", 1280)}) AS x1, greatest({_c("v0", 1280)}, {_c("v2", 1280)}) AS x2,
      least({_c("v1", 720)}, {_c("v3", 720)}) AS y1, greatest({_c("v1", 720)}, {_c("v3", 720)}) AS y2 FROM b),
      q AS (SELECT event_id, x2 > x1 AND y2 > y1 AS ok, 1000 * x1 / 1280 AS x1, 1000 * y1 / 720 AS y1, 1000 * x2 / 1280 AS x2, 1000 * y2 / 720 AS y2 FROM n)
      SELECT event_id, CASE WHEN ok THEN {_box_sql("x1", "y1", "x2", "y2")} END AS box FROM q""",
    "bbox_scale_repair": f"WITH {_BOXES}, q AS (SELECT event_id, v0 / 1000 * 1000 AS x1, v1 / 1000 * 1000 AS y1, v2 / 1000 * 1000 AS x2, v3 / 1000 * 1000 AS y2 FROM b) SELECT event_id, {_box_sql('x1', 'y1', 'x2', 'y2')} AS box FROM q",
    "bbox_unscale": f"WITH {_BOXES} SELECT event_id, round(v0 * 1280 / 1000, 6) AS x1, round(v1 * 720 / 1000, 6) AS y1, round(v2 * 1280 / 1000, 6) AS x2, round(v3 * 720 / 1000, 6) AS y2 FROM b",
    "bbox_overlap": f"""WITH {_BOXES}, {_SORTED} SELECT event_id, {_iou_sql(0)} AS iou, {_iou_sql(1)} AS pixel_iou,
      round(sqrt(pow(greatest(b0 - a2, a0 - b2, 0), 2) + pow(greatest(b1 - a3, a1 - b3, 0), 2)) / sqrt(1280.0::DOUBLE * 1280 + 720 * 720), 9) AS distance,
      (a0 + a2) / 2 BETWEEN b0 AND b2 AND (a1 + a3) / 2 BETWEEN b1 AND b3 AS inside, a2 > a0 AND a3 > a1 AS valid FROM s""",
    "match_scores": f"""WITH m AS (SELECT event_id, {_hs(0)} % 1000 / 1000.0::DOUBLE AS s, {_hs(1)} % 1000 / 1000.0::DOUBLE AS d, {_hs(2)} % 1000 / 1000.0::DOUBLE AS c, {_hs(3)} % 1000 / 1000.0::DOUBLE AS o FROM events),
      n AS (SELECT *, CASE WHEN s >= 0.92 THEN 0.22::DOUBLE * 1.5::DOUBLE ELSE 0.22::DOUBLE END AS allowed FROM m)
      SELECT event_id, round(0.72::DOUBLE * s + 0.18::DOUBLE * greatest(0, 1 - d / allowed) + 0.07::DOUBLE * c + 0.03::DOUBLE * least(1, o * 4), 9) AS score, allowed FROM n""",
    "tile_layout": f"WITH {_TILES} SELECT * FROM tiles",
    "sequence_lengths": f"""WITH {_TILES}, q AS (SELECT page_id, sum(patch_tokens) + 2 * count(*) + 32 + 64 AS tokens FROM tiles GROUP BY 1)
      SELECT page_id, tokens::BIGINT AS tokens, CASE WHEN tokens <= 32768 THEN '16k_32k' WHEN tokens <= 49152 THEN '32k_48k' WHEN tokens <= 65536 THEN '48k_64k' ELSE 'over_64k' END AS bucket FROM q""",
    "crop_window": f"""WITH t AS (SELECT event_id, {_hs(0)} % 1000 AS lo, {_hs(0)} % 1000 + 1 + {_hs(1)} % 380 AS hi FROM events),
      l AS (SELECT *, least(1400, greatest(500, hi - lo + 64)) AS length FROM t)
      SELECT event_id, round_even((greatest(0, hi - length) + least(lo, 1400 - length)) / 2.0::DOUBLE, 0)::INT AS start, length FROM l""",
    "near_boxes": f"""WITH b AS (SELECT user_id, event_id, {_hs(0)} % 1200 AS x, {_hs(1)} % 680 AS y, 10 + {_hs(2)} % 60 AS w, 5 + {_hs(3)} % 30 AS h FROM events),
      p AS (SELECT a.event_id, c.event_id AS other, sqrt(pow(greatest(c.x - a.x - a.w, a.x - c.x - c.w, 0), 2) + pow(greatest(c.y - a.y - a.h, a.y - c.y - c.h, 0), 2)) / sqrt(1280.0::DOUBLE * 1280 + 720 * 720) AS distance
        FROM b a JOIN b c ON a.user_id = c.user_id AND a.event_id <> c.event_id)
      SELECT event_id, count(*) AS n, arg_min(other, (round(distance, 9), other)) AS nearest FROM p WHERE distance <= 0.05 GROUP BY 1""",
    "resize_dims": f"""WITH p AS (SELECT page_id, ({_hs(0, "page_id")} % 3000 + 50)::DOUBLE AS w, ({_hs(1, "page_id")} % 3000 + 50)::DOUBLE AS h FROM pages),
      a AS (SELECT *, greatest(least(1024 / greatest(w, h), 1), 512 / least(w, h)) AS s FROM p),
      b AS (SELECT page_id, {_STEP("w * s")} AS w, {_STEP("h * s")} AS h FROM a),
      c AS (SELECT page_id, CASE WHEN w * h > 600000 THEN {_STEP("w * sqrt(600000.0::DOUBLE / (w * h))")} ELSE w END AS w, CASE WHEN w * h > 600000 THEN {_STEP("h * sqrt(600000.0::DOUBLE / (w * h))")} ELSE h END AS h FROM b),
      e AS (SELECT *, CASE WHEN greatest(w, h) > 1024 THEN 1024.0::DOUBLE / greatest(w, h) ELSE 1.0 END AS k FROM c),
      f AS (SELECT page_id, {_STEP("w * k")} AS width, {_STEP("h * k")} AS height FROM e) SELECT page_id, width, height, (width * height // 256)::BIGINT AS tokens FROM f""",
    "relative_position": f"""WITH v AS (SELECT event_id, {_hs(0)} % 500 AS ax, {_hs(1)} % 500 AS ay, 10 + {_hs(2)} % 90 AS aw, 10 + {_hs(3)} % 90 AS ah, {_hs(4)} % 500 AS bx, {_hs(5)} % 500 AS by0, 10 + {_hs(6)} % 90 AS bw, 10 + {_hs(7)} % 90 AS bh FROM events),
      o AS (SELECT *, (ax + aw / 2.0::DOUBLE) - (bx + bw / 2.0::DOUBLE) AS ox, (ay + ah / 2.0::DOUBLE) - (by0 + bh / 2.0::DOUBLE) AS oy FROM v),
      r AS (SELECT event_id, ox, oy, greatest(abs(ox) - 0.1::DOUBLE * (aw + bw), 0) * sign(ox) AS rx, greatest(abs(oy) - 0.1::DOUBLE * (ah + bh), 0) * sign(oy) AS ry FROM o),
      n AS (SELECT event_id, CASE WHEN abs(rx) < 0.001 AND abs(ry) < 0.001 THEN 0 ELSE rx / sqrt(ox * ox + oy * oy) END AS dx, CASE WHEN abs(rx) < 0.001 AND abs(ry) < 0.001 THEN 0 ELSE ry / sqrt(ox * ox + oy * oy) END AS dy FROM r)
      SELECT event_id, concat_ws(' and ', CASE WHEN dx < -0.5 THEN 'left of' END, CASE WHEN dx > 0.5 THEN 'right of' END, CASE WHEN dy < -0.5 THEN 'above' END, CASE WHEN dy > 0.5 THEN 'below' END) AS where FROM n""",
    "loss_weights": "SELECT doc_id, 1.0::DOUBLE AS token, round(CASE WHEN n_chars = 0 THEN 0 ELSE 1.0::DOUBLE / n_chars END, 9) AS sample, round(CASE WHEN n_chars = 0 THEN 0 ELSE 1.0::DOUBLE / sqrt(n_chars) END, 9) AS square FROM documents",
    "power_pad": "SELECT doc_id, CASE WHEN n_chars <= 0 THEN 1 ELSE (1::BIGINT << length(ltrim(to_binary(n_chars), '0'))::INT) END AS padded FROM documents",
    "chunk_split": f"""WITH u AS (SELECT doc_id, n_chars AS n, ('0x' || substr(sha256('split' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
      k AS (SELECT *, list_filter(list_transform(range(0, 41), lambda i: pow(2.0::DOUBLE, i)), lambda k: k >= n / 512 AND k <= n / 16) AS ks FROM u),
      w AS (SELECT *, list_sum(list_transform(ks, lambda k: 1 / (2 * k))) AS total FROM k),
      c AS (SELECT doc_id, n, CASE WHEN n <= 16 THEN 1 ELSE coalesce(list_filter(ks, lambda k: u * total < list_sum(list_transform(list_filter(ks, lambda j: j <= k), lambda j: 1 / (2 * j))))[1], ks[-1]) END::INT AS k FROM w)
      SELECT doc_id, k AS chunks, (n // k + (n % k > 0)::INT)::BIGINT AS largest, (n // k)::BIGINT AS smallest, n AS total FROM c""",
    "timestep_schedule": "SELECT r_regionkey, i::INT AS i, round(3.0::DOUBLE * (1 - i / 8.0::DOUBLE) / (1 + 2.0::DOUBLE * (1 - i / 8.0::DOUBLE)), 9) AS t FROM region, range(9) r(i)",
}
