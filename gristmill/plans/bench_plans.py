"""Queries on linking, generation benchmarks, streams' batch twins and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.operators import genbench as B
from gristmill.operators import linking as L
from gristmill.operators import matching as M
from gristmill.operators import schedule as C
from gristmill.plans.synth import h, sql_h, table
from gristmill.streaming import windows as S


def token_f1(spark, d):
    """Every document's F1 with the benchmark item nearest to it."""
    return M.nearest_f1(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def best_candidate(spark, d):
    """Every benchmark item's nearest document; the first one where none shares a token."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    best = M.best_documents(docs, items, "doc_id", "item_id")
    first = docs.agg(F.min("doc_id").alias("first"))
    found = items.select("item_id").distinct().crossJoin(first).join(best, "item_id", "left")
    return found.select("item_id", F.coalesce("doc_id", "first").alias("doc_id"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def text_link(spark, d):
    """Pages linked to the best of five detections around a box."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    box = F.array(*(x.cast("double") for x in (h(k, 0) % 800, h(k, 1) % 600, h(k, 0) % 800 + 60, h(k, 1) % 600 + 20)))
    title = F.regexp_extract("html", r"<title>([^<]+)", 1)
    t = p.select("page_id", title.alias("text"), box.alias("box"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    e = t.select("page_id", "text", "box", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("index"))
    key = F.concat_ws(":", "page_id", "index")
    move = (h(key, 0) % 400).cast("double")
    part = F.array_join(F.slice(F.split("text", " "), 1, h(key, 1) % 6 + 1), " ")
    det = e.select("page_id", "index", part.alias("text"), (h(key, 2) % 100 / 100.0).alias("confidence"), F.transform("box", lambda v, i: v + F.when(i % 2 == 0, move).otherwise(0.0)).alias("box"))
    out = L.best_links(t, det, "page_id")
    return out.select("page_id", "accepted", "reason", F.col("link.index").alias("index"), F.round("link.score", 6).alias("score"), F.array_join("box", "/").alias("box"))


def geneval_summary(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("tag"), (F.col("user_id") % 50).alias("prompt"), (h(F.col("event_id"), 0) % 3 == 0).alias("correct"))
    s = B.tag_summary(e, "tag", "prompt", "correct", "event_id")
    return s.select("tag", "images", F.round("image_share", 9).alias("image_share"), F.round("prompt_share", 9).alias("prompt_share"), "first_seen")


def geneval_overall(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("tag"), (F.col("user_id") % 50).alias("prompt"), (h(F.col("event_id"), 0) % 3 == 0).alias("correct"))
    o = B.overall(e, "tag", "prompt", "correct")
    return o.select("images", "prompts", *(F.round(c, 9).alias(c) for c in ("image_share", "prompt_share", "task_mean")))


def _detections(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    box = F.array(*(x.cast("double") for x in (h(k, 0) % 300, h(k, 1) % 300, h(k, 0) % 300 + 40 + h(k, 2) % 100, h(k, 1) % 300 + 40 + h(k, 3) % 100)))
    d = e.select("user_id", "event_type", (h(k, 4) / 65536.0).alias("score"), "event_id", box.alias("box"))
    return B.top_objects(d, ["user_id", "event_type"], "score")


def top_objects(spark, d):
    return _detections(spark, d).select("user_id", "event_type", "event_id", "rank")


def nms_topk(spark, d):
    return B.suppressed(_detections(spark, d), ["user_id", "event_type"], 0.5).select("user_id", "event_type", "event_id", "rank")


def dpg_rollup(spark, d):
    li = table(spark, d, "lineitem")
    label = F.concat("l_returnflag", F.lit(" - "), "l_linestatus", F.lit(" (line "), "l_linenumber", F.lit(")"))
    r = B.category_rollup(li.select(label.alias("label"), (F.col("l_quantity") > 25).cast("int").alias("yes")), "label", "yes")
    return r.select("l1", "l2", F.round("mean_score", 9).alias("mean_score"), "n")


def dpg_gate(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    q = li.select("l_orderkey", F.col("l_linenumber").alias("order"), F.col("l_linenumber").alias("question"), (F.col("q") > 20).cast("double").alias("score"))
    before = F.lag("question").over(W.partitionBy("l_orderkey").orderBy("question"))
    rows = q.withColumn("parents", F.array(F.coalesce(before, F.lit(0))))
    return B.gated(rows, "l_orderkey").groupBy("l_orderkey").agg(F.round(F.avg("gated"), 9).alias("score"), F.round(F.avg("score"), 9).alias("plain"))


def question_runs(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("row_index"), F.col("role").alias("item_id"))
    return B.questions(c.dropDuplicates(["row_index"])).select("row_index", "item_id")


def confidence_commit(spark, d):
    """Positions of a vector beyond a confidence, or the best one alone."""
    e = table(spark, d, "embeddings")
    best = F.array_max("embedding")
    return e.select("vec_id", F.greatest(F.size(F.filter("embedding", lambda x: x >= 0.3)), F.lit(1)).alias("commits"), F.array_position("embedding", best).cast("int").alias("best_at"))


def commit_schedule(spark, d):
    """Vectors as the first confidences of 64 positions, rising by a twentieth a step, in four blocks of eight steps; positions below -0.3 are not masked."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rising = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform("v", lambda x: x + i * 0.05))
    rows = e.select("vec_id", F.transform("v", lambda x: x >= -0.3).alias("masked"), rising.alias("c"))
    out = C.block_schedule(rows, "vec_id", "masked", "c", 16, 32, 0.25)
    return out.select("vec_id", "block", "strategy", "requested_steps", "iterations", "remaining_masks", F.array_join("committed", ",", "x").alias("committed"))


def cosine_alignment(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    j = e.join(f, "vec_id")
    return j.select("vec_id", F.round(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w")), 6).alias("cosine"))


def tumbling_windows(spark, d):
    return S.tumbling(table(spark, d, "events"), "1 day", ["event_type"], "value").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def sliding_windows(spark, d):
    return S.sliding(table(spark, d, "events"), "2 days", "1 day", [], "value").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("total", 4).alias("total")
    )


def session_windows(spark, d):
    s = S.sessions(table(spark, d, "events"), "6 hours", "user_id")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSS").alias("session_start"), "n")


def stream_dedup(spark, d):
    return S.first_seen(table(spark, d, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


QUERIES = {f.__name__: f for f in (
    token_f1, best_candidate, text_link, geneval_summary, geneval_overall, top_objects, nms_topk, dpg_rollup, dpg_gate, question_runs, confidence_commit, commit_schedule, cosine_alignment,
    tumbling_windows, sliding_windows, session_windows, stream_dedup,
)}

_P = r"""dt AS (SELECT doc_id, t, count(*) AS m FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+')) AS t FROM documents) GROUP BY ALL),
 bt AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+')) AS t FROM benchmark) GROUP BY ALL),
 c AS (SELECT doc_id, item_id, sum(least(m, n)) AS c FROM dt JOIN bt USING (t) GROUP BY ALL),
 ds AS (SELECT doc_id, sum(m) AS a FROM dt GROUP BY ALL), bs AS (SELECT item_id, sum(n) AS b FROM bt GROUP BY ALL),
 f AS (SELECT doc_id, item_id, round(2.0::DOUBLE * c / (a + b), 9) AS f1 FROM c JOIN ds USING (doc_id) JOIN bs USING (item_id))"""
_DET = f"""e AS (SELECT event_id, user_id, event_type, {sql_h("event_id", 4)} / 65536.0::DOUBLE AS score FROM events)"""
ORACLE = {
    "token_f1": f"WITH {_P} SELECT doc_id, coalesce(max(f1), 0) AS f1 FROM (SELECT doc_id FROM documents) LEFT JOIN f USING (doc_id) GROUP BY 1",
    "best_candidate": f"""WITH {_P}, x AS (SELECT item_id, arg_max(doc_id, (f1, -doc_id)) AS doc_id, max(f1) AS f1 FROM f GROUP BY 1)
      SELECT item_id, coalesce(doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id, coalesce(f1, 0) AS f1 FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN x USING (item_id)""",
    "nms_topk": f"""WITH RECURSIVE {_DET.replace('AS score FROM', f"AS score, {sql_h('event_id', 0)} % 300 AS x, {sql_h('event_id', 1)} % 300 AS y, {sql_h('event_id', 2)} % 100 + 40 AS w, {sql_h('event_id', 3)} % 100 + 40 AS h FROM")},
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id)::INT AS rank FROM e WHERE score > 0.3),
      t AS (SELECT user_id, event_type, list({{'r': rank, 'id': event_id, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY rank) AS a FROM r WHERE rank <= 16 GROUP BY ALL),
      k AS (SELECT user_id, event_type, a, 0 AS i, []::INT[] AS kept FROM t UNION ALL
        SELECT user_id, event_type, a, i + 1, CASE WHEN len(list_filter(kept, lambda j: (greatest(least(a[j].x + a[j].w, a[i + 1].x + a[i + 1].w) - greatest(a[j].x, a[i + 1].x) + 1, 0)
            * greatest(least(a[j].y + a[j].h, a[i + 1].y + a[i + 1].h) - greatest(a[j].y, a[i + 1].y) + 1, 0)) * 2
          >= (a[j].w + 1) * (a[j].h + 1) + (a[i + 1].w + 1) * (a[i + 1].h + 1) - (greatest(least(a[j].x + a[j].w, a[i + 1].x + a[i + 1].w) - greatest(a[j].x, a[i + 1].x) + 1, 0)
            * greatest(least(a[j].y + a[j].h, a[i + 1].y + a[i + 1].h) - greatest(a[j].y, a[i + 1].y) + 1, 0)))) = 0 THEN list_append(kept, (i + 1)::INT) ELSE kept END FROM k WHERE i < len(a))
      SELECT user_id, event_type, a[j].id AS event_id, j AS rank FROM (SELECT *, unnest(kept) AS j FROM k WHERE i = len(a))""",
    "geneval_summary": f"""WITH e AS (SELECT event_id, event_type AS tag, user_id % 50 AS prompt, {sql_h("event_id", 0)} % 3 = 0 AS ok FROM events),
      p AS (SELECT tag, prompt, count(*) AS n, count(*) FILTER (ok) AS good, bool_or(ok)::INT AS any_ok, min(event_id) AS f FROM e GROUP BY 1, 2)
      SELECT tag, sum(n)::BIGINT AS images, round(sum(good) / sum(n), 9) AS image_share, round(avg(any_ok), 9) AS prompt_share, min(f) AS first_seen FROM p GROUP BY 1""",
    "geneval_overall": f"""WITH e AS (SELECT event_type AS tag, user_id % 50 AS prompt, ({sql_h("event_id", 0)} % 3 = 0)::INT AS ok FROM events)
      SELECT count(*) AS images, count(DISTINCT prompt) AS prompts, round(avg(ok), 9) AS image_share, (SELECT round(avg(a), 9) FROM (SELECT max(ok) AS a FROM e GROUP BY prompt)) AS prompt_share,
        (SELECT round(avg(a), 9) FROM (SELECT avg(ok) AS a FROM e GROUP BY tag)) AS task_mean FROM e""",
    "top_objects": f"WITH {_DET}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id)::INT AS rank FROM e WHERE score > 0.3) SELECT user_id, event_type, event_id, rank FROM r WHERE rank <= 16",
    "dpg_rollup": """WITH l AS (SELECT l_returnflag AS l1, l_returnflag || ' - ' || l_linestatus AS l2, (l_quantity > 25)::INT AS s FROM lineitem)
      SELECT l1, l2, round(avg(s), 9) AS mean_score, count(*) AS n FROM l GROUP BY ROLLUP (l1, l2)""",
    "dpg_gate": """WITH q AS (SELECT l_orderkey, l_linenumber, (max(l_quantity) > 20)::DOUBLE AS s FROM lineitem GROUP BY 1, 2),
      g AS (SELECT l_orderkey, s, min(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gated FROM q) SELECT l_orderkey, round(avg(gated), 9) AS score, round(avg(s), 9) AS plain FROM g GROUP BY 1""",
    "question_runs": """WITH c AS (SELECT conv_id * 10 + turn AS row_index, min(role) AS item_id, count(*) AS k FROM conversations GROUP BY 1), k AS (SELECT * FROM c WHERE row_index > 0),
      o AS (SELECT a.row_index, a.item_id, (a.item_id IS DISTINCT FROM b.item_id)::INT AS o FROM k a LEFT JOIN k b ON a.row_index = b.row_index + 1),
      r AS (SELECT *, sum(o) OVER (PARTITION BY item_id ORDER BY row_index) AS r FROM o) SELECT row_index, item_id FROM r QUALIFY r = max(r) OVER (PARTITION BY item_id)""",
    "confidence_commit": "SELECT vec_id, greatest(len(list_filter(embedding, lambda x: x >= 0.3)), 1)::INT AS commits, list_position(embedding, list_max(embedding))::INT AS best_at FROM embeddings",
    "commit_schedule": """WITH RECURSIVE v AS (SELECT vec_id, b::INT AS block, list_transform(embedding[b * 16 + 1:b * 16 + 16], lambda x: x::DOUBLE) AS c FROM embeddings, range(4) r(b)),
      s AS (SELECT vec_id, block, c, 0 AS i, 0 AS used, list_transform(c, lambda x: CASE WHEN x < -0.3::DOUBLE THEN -1 END) AS done FROM v UNION ALL
        SELECT vec_id, block, c, i + 1, used + 1, list_transform(done, lambda d, j: CASE WHEN d IS NOT NULL THEN d WHEN c[j] + i * 0.05::DOUBLE >= 0.25::DOUBLE OR m < 0.25::DOUBLE AND j = best THEN i END) FROM
          (SELECT *, list_max(list_transform(done, lambda d, j: CASE WHEN d IS NULL THEN c[j] + i * 0.05::DOUBLE END)) AS m,
            list_position(list_transform(done, lambda d, j: CASE WHEN d IS NULL THEN c[j] + i * 0.05::DOUBLE END), list_max(list_transform(done, lambda d, j: CASE WHEN d IS NULL THEN c[j] + i * 0.05::DOUBLE END))) AS best
           FROM s WHERE i < 16 AND len(list_filter(done, lambda d: d IS NULL)) > 0))
      SELECT vec_id, block, 'confidence_threshold' AS strategy, 8 AS requested_steps, used AS iterations, len(list_filter(done, lambda d: d IS NULL))::INT AS remaining_masks,
        array_to_string(list_transform(done, lambda d: coalesce(d::VARCHAR, 'x')), ',') AS committed FROM s QUALIFY i = max(i) OVER (PARTITION BY vec_id, block)""",
    "cosine_alignment": """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "tumbling_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_windows": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM
      (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS w, value FROM events, range(2) r(k)) GROUP BY 1""",
    "session_windows": """WITH a AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
