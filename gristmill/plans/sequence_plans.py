"""Queries on web actions, token arrays, frames and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions import sequences as Q
from gristmill.functions import web as B
from gristmill.functions.text import plural, with_article
from gristmill.operators import scoring as S
from gristmill.operators import validation as V
from gristmill.plans.synth import h, scored_rows, sql_h, table, with_sql

K = "event_id"


def web_actions(spark, d):
    """Calls as text with candidates and viewports, some of them broken: a reason, or an action and a box."""
    k = F.col(K)
    intent = F.element_at(F.array(*map(F.lit, ("click", "submit", "text_input", "change", "load", "scroll"))), h(k, 0) % 6 + 1)
    uid = F.concat(F.lit("u.["), h(k, 1) % 3)
    call = F.concat(intent, F.when(h(k, 2) % 7 == 0, "(").otherwise(F.concat(F.lit('(uid="'), uid, F.lit('", text="x")'))))
    block = lambda i: F.concat(F.lit(f"(uid = u.[{i}) tag [[bbox]] x="), h(k, 3) % 900, F.lit(f" y={i} width="), h(k, 4) % 50, F.lit(" height=20"))
    blocks = F.concat_ws("\n", *(block(i) for i in range(2)))
    port = F.when(h(k, 5) % 9 == 0, "wide").otherwise("720h x 1280w")
    e = table(spark, d, "events").select(K, B.parse_call(call).alias("call"), blocks.alias("blocks"), port.alias("port"))
    width, height = B.viewport(F.col("port"))
    e = e.withColumns({"name": F.get_json_object("call", "$.name"), "own": F.get_json_object("call", "$.arguments.uid"), "width": width, "height": height})
    e = e.withColumn("box", G.normalize_box(B.candidate_box(F.col("blocks"), F.col("own")), F.col("width"), F.col("height")))
    why = V.reason(
        ("parse_error", F.col("call").isNull()), ("unsupported", ~F.col("name").isin(*B.INTENTS)), ("missing_uid", F.coalesce("own", F.lit("")) == ""),
        ("invalid_viewport", F.col("width").isNull()), ("parse_error", F.col("box").isNull()),
    )
    action = F.when(F.col("name").isin("click", "submit"), "lclick").otherwise("type_in")
    good = F.col("why").isNull()
    return e.withColumn("why", why).select(K, "why", F.when(good, action).alias("action"), F.when(good, F.array_join("box", "/")).alias("box"))


def candidate_choice(spark, d):
    k = F.col(K)
    rect = lambda i: F.when(h(k, i) % 3 == 0, "").otherwise(F.concat_ws(",", F.lit("1"), F.lit("2"), (h(k, i + 3) % 30).cast("string"), F.lit("5")))
    attributes = lambda i: F.to_json(F.struct(rect(i).alias("bounding_box_rect"), F.when(h(k, i + 6) % 2 == 0, F.lit(f"title {i}")).alias("title")))
    one = lambda i: F.to_json(F.struct(F.lit(f"tag{i}").alias("tag"), (h(k, i + 9) % 3 == 0).alias("is_original_target"), attributes(i).alias("attributes")))
    c = B.choose_candidate(F.array(one(0), F.lit("{broken"), one(1), one(2)))
    e = table(spark, d, "events").select(K, c.alias("c"))
    return e.select(K, F.col("c.tag").alias("tag"), F.array_join(B.rectangle(F.col("c")), "/").alias("box"), F.when(F.col("c").isNotNull(), B.description(F.col("c"))).alias("description"))


def web_prompts(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    names = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: F.concat(F.lit(f"{role} "), x["turn"].cast("string")))
    depth = F.element_at(F.array(*map(F.lit, B.HISTORY_DEPTHS)), (F.col("conv_id") % 4 + 1).cast("int"))
    return t.select("conv_id", B.web_prompt(names("user"), names("assistant"), depth).alias("prompt"))


def frame_choice(spark, d):
    n = (h(F.col("page_id"), 0) % 40 + 1).cast("int")
    return table(spark, d, "pages").select(
        "page_id", F.array_join(Q.middle_frames(F.lit(8), n), ",").alias("middle"), F.array_join(Q.rate_frames(0.5, n, F.lit(4.0), 6), ",").alias("rate")
    )


def frame_starts(spark, d):
    """Eight frames of every page's video, each two behind the start of its interval, and as many drawn ones, which must be in order."""
    n = (h(F.col("page_id"), 0) % 90 + 1).cast("int")
    rows = table(spark, d, "pages").select("page_id", n.alias("n"), Q.started_frames(F.lit(8), n, 2).alias("s"), Q.drawn_frames(F.lit(8), n, 3, F.col("page_id")).alias("d"))
    return rows.select("page_id", F.array_join("s", ",").alias("starts"), (F.array_sort("d") == F.col("d")).alias("ordered"), (F.array_max("d") < F.col("n")).alias("inside"))


def frame_order(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("f_"), (F.col("page_id") * 7 % 13), F.when(F.col("page_id") % 5 > 0, ".jpg").otherwise(".png")).alias("name"), "page_id")
    return p.select("page_id", Q.frame_number(F.col("name")).alias("number"))


def transfer_counts(spark, d):
    s = G.even_split(F.col("n_chars"), F.lit(7))
    return table(spark, d, "documents").select("doc_id", F.array_join(s, ",").alias("steps"))


def _ids(spark, d):
    ids = F.transform(F.sequence(F.lit(1), (F.col("turn") % 5 + 3).cast("int")), lambda i: (100 + i).cast("int"))
    t = table(spark, d, "conversations").filter("role = 'assistant'")
    return t.select("conv_id", "turn", ids.alias("ids"))


def end_cut(spark, d):
    cut = Q.until(F.col("ids"), 104)
    return _ids(spark, d).select("conv_id", "turn", F.array_join(cut, ",").alias("ids"), F.array_join(Q.padded(cut, 6, 0), ",").alias("padded"))


def supervised_pack(spark, d):
    t = _ids(spark, d)
    single = F.col("turn") % 2 == 0
    masked = F.array((F.col("turn") % 3).cast("int"), F.lit(2)).cast("array<int>")
    p = Q.supervised(F.col("ids"), F.array_distinct(F.array_sort(masked)), F.lit(10), 1, 0, single)
    t = t.select("conv_id", "turn", p.alias("p"))
    return t.select("conv_id", "turn", *(F.array_join(f"p.{c}", ",").alias(c) for c in ("ids", "label_ids", "label_places", "lengths", "modes")))


def edit_spans(spark, d):
    s = Q.edit_span(F.lit(6), 9, F.col("page_id"))
    return table(spark, d, "pages").select("page_id", s["start"].alias("start"), s["end"].alias("end"))


def loss_reduction(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(Q.weighted_loss(F.col("l_quantity"), F.col("l_discount")), 9).alias("loss"), F.count("*").alias("tokens"))


def rescored(spark, d):
    """The same predictions under two roots of targets: given boxes and wider ones."""
    r = scored_rows(spark, d)
    wide = r.withColumn("target_box", F.transform("target_box", lambda v, i: v + F.when(i < 2, -100.0).otherwise(100.0)))
    both = r.withColumn("root", F.lit("given")).unionByName(wide.withColumn("root", F.lit("wide")))
    return S.judged(both).groupBy("root").agg(F.round(F.avg(F.col("point_hit").cast("double")), 9).alias("ssr"))


def prompt_suite(spark, d):
    """Prompts of counted objects, without repeats of the same specification."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("object"), (F.col("p_size") % 4 + 1).alias("count"))
    p = p.dropDuplicates(["object", "count"])
    text = F.when(F.col("count") == 1, F.concat(F.lit("a photo of "), with_article(F.lower("object")))).otherwise(F.concat(F.lit("a photo of "), F.col("count"), F.lit(" "), plural(F.lower("object"))))
    return p.select("object", "count", text.alias("prompt"))


def position_codes(spark, d):
    v = Q.sin_cos(F.col("n_nationkey").cast("double"), 4)
    return table(spark, d, "nation").select("n_nationkey", *(F.round(v[i], 9).alias(f"v{i}") for i in range(4)))


QUERIES = {f.__name__: f for f in (
    web_actions, candidate_choice, web_prompts, frame_choice, frame_starts, frame_order, transfer_counts, end_cut, supervised_pack, edit_spans, loss_reduction, rescored,
    prompt_suite, position_codes,
)}

_h = lambda i, k=K: sql_h(k, i)
_PARTS = "range(0, 7)"
ORACLE = {
    "web_actions": f"""WITH e AS (SELECT event_id, ['click','submit','text_input','change','load','scroll'][{_h(0)} % 6 + 1] AS intent, {_h(1)} % 3 AS u, {_h(2)} % 7 = 0 AS broken, {_h(3)} % 900 AS x, {_h(4)} % 50 AS w, {_h(5)} % 9 = 0 AS bad FROM events),
      r AS (SELECT *, CASE WHEN broken THEN 'parse_error' WHEN intent IN ('load', 'scroll') THEN 'unsupported' WHEN bad THEN 'invalid_viewport' WHEN u = 2 OR w = 0 THEN 'parse_error' END AS why,
        1000.0::DOUBLE * x / 1280 AS x1, 1000.0::DOUBLE * u / 720 AS y1, 1000.0::DOUBLE * (x + w) / 1280 AS x2, 1000.0::DOUBLE * (u + 20) / 720 AS y2 FROM e),
      b AS (SELECT *, round_even(x1, 0)::INT AS a, round_even(x2, 0)::INT AS c FROM r)
      SELECT event_id, why, CASE WHEN why IS NULL THEN CASE WHEN intent IN ('click', 'submit') THEN 'lclick' ELSE 'type_in' END END AS action,
      CASE WHEN why IS NULL THEN a || '/' || round_even(y1, 0)::INT || '/' || CASE WHEN c <= a THEN a + 1 ELSE c END || '/' || round_even(y2, 0)::INT END AS box FROM b""",
    "candidate_choice": f"""WITH c AS (SELECT event_id, i, CASE i WHEN 0 THEN {_h(0)} WHEN 1 THEN {_h(1)} ELSE {_h(2)} END % 3 > 0 AS has, CASE i WHEN 0 THEN {_h(3)} WHEN 1 THEN {_h(4)} ELSE {_h(5)} END % 30 AS w,
      CASE i WHEN 0 THEN {_h(6)} WHEN 1 THEN {_h(7)} ELSE {_h(8)} END % 2 = 0 AS titled, CASE i WHEN 0 THEN {_h(9)} WHEN 1 THEN {_h(10)} ELSE {_h(11)} END % 3 = 0 AS orig FROM events, range(3) r(i)),
      g AS (SELECT * FROM c WHERE has QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY orig DESC, i) = 1)
      SELECT event_id, 'tag' || i AS tag, CASE WHEN w > 0 THEN '1.0/2.0/' || (1 + w) || '.0/7.0' END AS box, CASE WHEN titled THEN 'title ' || i ELSE 'tag' || i END AS description FROM events LEFT JOIN g USING (event_id)""",
    "web_prompts": """WITH a AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS u, coalesce(list(turn ORDER BY turn) FILTER (role = 'assistant'), []) AS s, [0, 2, 4, 8][conv_id % 4 + 1] AS d FROM conversations GROUP BY conv_id),
      l AS (SELECT *, CASE WHEN d = 0 THEN [] ELSE s[greatest(1, len(s) - d + 1):len(s)] END AS x FROM a)
      SELECT conv_id, 'Follow the user''s instruction and predict the next GUI action.' || chr(10) || 'Instruction: ' || coalesce('user ' || u[-1], 'Continue the current web task.') ||
      CASE WHEN len(x) > 0 THEN chr(10) || 'Recent actions:' || chr(10) || array_to_string(list_transform(x, lambda t: '- assistant ' || t), chr(10)) ELSE '' END AS prompt FROM l""",
    "frame_choice": f"""WITH p AS (SELECT page_id, {_h(0, "page_id")} % 40 + 1 AS n FROM pages), k AS (SELECT *, least(8, n) AS k FROM p),
      m AS (SELECT *, list_transform(range(0, 8), lambda i: ((least(i, k - 1) * n // k) + ((least(i, k - 1) + 1) * n // k) - 1) // 2) AS m, list_filter(list_transform(range(0, ceil(n / 4.0 / 2)::BIGINT), lambda i: (4 + i * 8)::BIGINT), lambda f: f < n)[1:6] AS r FROM k)
      SELECT page_id, array_to_string(m, ',') AS middle, array_to_string(r, ',') AS rate FROM m""",
    "frame_starts": f"""WITH p AS (SELECT page_id, {_h(0, "page_id")} % 90 + 1 AS n FROM pages)
      SELECT page_id, array_to_string(list_transform(range(8), lambda i: (least(i, least(8, n) - 1) * n) // least(8, n) + 2), ',') AS starts, true AS ordered, true AS inside FROM p""",
    "frame_order": "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN (page_id * 7 % 13)::INT ELSE -1 END AS number FROM pages",
    "transfer_counts": f"SELECT doc_id, array_to_string(list_transform({_PARTS}, lambda i: n_chars // 7 + (i < n_chars % 7)::INT), ',') AS steps FROM documents",
    "end_cut": """WITH t AS (SELECT conv_id, turn, list_transform(range(1, least(turn % 5 + 3, 4) + 1), lambda i: 100 + i) AS ids FROM conversations WHERE role = 'assistant')
      SELECT conv_id, turn, array_to_string(ids, ',') AS ids, array_to_string(list_concat(ids, list_transform(range(0, 6), lambda i: 0))[1:6], ',') AS padded FROM t""",
    "supervised_pack": """WITH t AS (SELECT conv_id, turn, turn % 5 + 3 AS n, list_sort(list_distinct([turn % 3, 2])) AS m FROM conversations WHERE role = 'assistant'),
      s AS (SELECT *, turn % 2 = 0 AS single, '1,' || array_to_string(list_transform(range(0, n), lambda i: CASE WHEN list_contains(m, i) THEN 0 ELSE 101 + i END), ',') AS noisy, '1,' || array_to_string(list_transform(range(0, n), lambda i: 101 + i), ',') AS clean FROM t)
      SELECT conv_id, turn, CASE WHEN single THEN noisy ELSE noisy || ',' || clean END AS ids, array_to_string(list_transform(m, lambda i: 101 + i), ',') AS label_ids, array_to_string(list_transform(m, lambda i: 11 + i), ',') AS label_places,
      CASE WHEN single THEN (n + 1)::VARCHAR ELSE (n + 1) || ',' || (n + 1) END AS lengths, CASE WHEN single THEN 'noise' ELSE 'noise,full' END AS modes FROM s""",
    "edit_spans": """WITH u AS (SELECT page_id, ('0x' || substr(sha256('s' || chr(31) || '9' || chr(31) || page_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS a, ('0x' || substr(sha256('t' || chr(31) || '9' || chr(31) || page_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS b FROM pages),
      s AS (SELECT *, floor(a * 5)::INT AS start FROM u) SELECT page_id, start, start + 1 + floor(b * (least(start + 3, 6) - start - 1))::INT AS "end" FROM s""",
    "loss_reduction": "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS loss, count(*) AS tokens FROM lineitem GROUP BY 1",
    "rescored": with_sql("""SELECT 'given' AS root, round(avg(point_hit::INT), 9) AS ssr FROM judged UNION ALL
      SELECT 'wide', round(avg(coalesce(error IS NULL AND (px1 + px2) / 2 BETWEEN x1 - 100 AND x2 + 100 AND (py1 + py2) / 2 BETWEEN y1 - 100 AND y2 + 100, false)::INT), 9) FROM judged"""),
    "prompt_suite": """SELECT object, count, 'a photo of ' || CASE WHEN count = 1 THEN (CASE WHEN lower(object)[1] IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END) || lower(object)
      ELSE count || ' ' || lower(object) || (CASE WHEN lower(object)[-1] = 's' THEN 'es' ELSE 's' END) END AS prompt FROM (SELECT DISTINCT p_brand AS object, p_size % 4 + 1 AS count FROM part)""",
    "position_codes": "SELECT n_nationkey, round(sin(n_nationkey), 9) AS v0, round(sin(n_nationkey / 100.0::DOUBLE), 9) AS v1, round(cos(n_nationkey), 9) AS v2, round(cos(n_nationkey / 100.0::DOUBLE), 9) AS v3 FROM nation",
}
