"""Queries on records: scans, external boxes, realigned targets, checks, orders, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import actions as A
from gristmill.functions import geometry as G
from gristmill.functions import hashing as H
from gristmill.functions import sequences as Q
from gristmill.functions import text as T
from gristmill.operators import genbench as B
from gristmill.operators import records as R
from gristmill.plans.synth import h, scored_rows, sql_h, table, targets, with_sql

K = "event_id"


def _talk(spark, d):
    """conv_id, images (none for a third) and elements of the conversations' turns."""
    c = table(spark, d, "conversations")
    turn = F.struct("turn", "role", F.struct(F.lit("text").alias("type"), (F.col("role") == "assistant").cast("int").alias("loss"), F.col("text").alias("text")).alias("e"))
    t = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["e"]).alias("elements"))
    return t.withColumn("images", F.array_repeat(F.lit("x"), (h(F.col("conv_id"), 1) % 3).cast("int")))


def scan_skip_rules(spark, d):
    return R.training_scan(_talk(spark, d), F.col("images"), F.col("elements")).select("conv_id", F.size("images").alias("images"))


def scan_text_only(spark, d):
    return R.training_scan(_talk(spark, d), F.col("images"), F.col("elements"), need_image=False).select("conv_id")


def row_hook(spark, d):
    """A hook that makes a sample of every second turn and drops rows of system turns."""
    c = table(spark, d, "conversations")
    hook = lambda r: F.when((r["role"] != "system") & (r["turn"] % 2 == 0), F.array(F.struct(F.upper(r["role"]).alias("who"))))
    return R.parsed_rows(c, hook).select("conv_id", "turn", "sample.who")


def key_rename(spark, d):
    return R.renamed(table(spark, d, "nation"), {"n_name": "txt", "n_missing": "jpg"}).select("n_nationkey", "txt")


def seeded_line_order(spark, d):
    e = table(spark, d, "events").select("event_type", K)
    return R.seeded_lines(e, "event_type", K, 42, 50).select("event_type", K, "place")


def ordered_prefix(spark, d):
    return R.ordered_prefix(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_orderkey", 100)


def numbered_images(spark, d):
    name = F.concat(F.lit("out/"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_partkey").cast("string")), F.lit("/samples/"), F.lpad(F.col("p_size").cast("string"), 5, "0"), F.lit(".png"))
    t = table(spark, d, "part").select("p_partkey", R.numbered_image(name).alias("at"))
    return t.filter("at is not null").select("p_partkey", "at.prompt", "at.image")


def latest_steps(spark, d):
    path = F.concat(F.lit("runs/"), "o_custkey", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return table(spark, d, "orders").select("o_custkey", path.alias("path")).groupBy("o_custkey").agg(R.latest_step("path").alias("latest"))


def external_boxes(spark, d):
    t = targets(spark, d)
    kinds = ("xyxy_0_1", "XYXY_1000", "xywh_pixels", "xyxy_pixels", None)
    kind = F.element_at(F.array(*map(F.lit, kinds)), h(F.col(K), 9) % 5 + 1)
    box = F.when(kind == "xyxy_0_1", F.transform("target_box", lambda v: v / 1000)).otherwise(F.col("target_box"))
    found = R.external_box(kind, box, F.lit(1000), F.lit(1000), F.when(h(F.col(K), 10) % 7 == 0, F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4)))))
    return t.select(K, F.array_join(found, "/").alias("box"))


def web_routing(spark, d):
    e, k = table(spark, d, "events"), F.col(K)
    file = F.concat(F.element_at(F.array(F.lit("WEB_"), F.lit("pc_"), F.lit("ios_")), h(k, 0) % 3 + 1), k)
    source = F.element_at(F.array(F.lit("Shop"), F.lit("windows"), F.lit(None).cast("string")), h(k, 1) % 3 + 1)
    kept = e.select(K, file.alias("file"), source.alias("source"), F.when(h(k, 2) % 2 == 0, "TEXT").alias("kind")).filter(R.is_web(F.col("file"), F.col("source")))
    return kept.groupBy(R.text_or_icon(F.col("kind")).alias("route")).agg(F.count("*").alias("n"))


def protocol_prompts(spark, d):
    p = table(spark, d, "part")
    protocol = F.when(F.col("p_partkey") % 2 == 0, "target_grounding").otherwise("task_history")
    prompt = R.prompt_by(protocol, F.lit("CLICK"), F.col("p_name"), F.lit(""), F.col("p_name"), F.array(F.lit("a"), F.lit("b")), F.lit("1"))
    return p.select("p_partkey", prompt.alias("prompt"))


def element_prompts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", A.element_prompt(F.lit("web"), F.col("p_name")).alias("element"), F.md5(A.page_prompt(F.col("p_name"), F.col("p_size"), F.lit(720), F.lit(4))).alias("page"))


def last_answers(spark, d):
    t, k = targets(spark, d), F.col(K)
    said = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    answer = A.render_action(F.col("target_action"), F.col("target_box"))
    talk = F.array(said("gpt", F.lit("hover [1,1,2,2]")), said("human", F.lit("go")), said("gpt", answer), said("human", F.lit("x")))
    return t.select(K, F.array_join(F.transform(R.with_last_answer(talk, F.array(*(F.lit(v) for v in (5, 6, 7, 8)))), lambda x: x["value"]), "|").alias("values"))


def _realigned(spark, d):
    k = F.col(K)
    moved = F.transform("target_box", lambda v: v + 1)
    error = F.when(h(k, 9) % 10 == 0, "ocr failed")
    return targets(spark, d).select(K, "event_type", R.realigned(F.col("target_box"), F.when(h(k, 10) % 4 > 0, moved), h(k, 11) % 3 > 0, error).alias("result"))


def realigned_boxes(spark, d):
    return _realigned(spark, d).select(K, F.array_join("result.box", "/").alias("box"), "result.accepted", "result.error")


def realigned_rates(spark, d):
    r = _realigned(spark, d).groupBy("event_type").agg(*R.match_rates())
    return r.select("event_type", "n", "matched", "fallback", "errors", F.round("match_rate", 9).alias("match_rate"))


def question_coverage(spark, d):
    """Customers as images, their orders as questions."""
    q = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("questions"))
    return R.with_questions(table(spark, d, "customer").select("c_custkey"), q, "c_custkey")


def replay_turns(spark, d):
    """Selected turns joined to what was recorded there."""
    c = table(spark, d, "conversations")
    wanted = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return wanted.join(c, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def last_crop_categories(spark, d):
    li = table(spark, d, "lineitem").withColumn("yes", (F.col("l_quantity") > 25).cast("int"))
    r = R.last_crop_categories(li, "l_orderkey", "l_linenumber", "l_returnflag", "yes")
    return r.select("l_returnflag", F.round("mean_score", 9).alias("mean_score"), "n")


def token_losses(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(Q.token_loss(F.col("l_discount"), F.col("l_quantity"), 8), 9).alias("loss"))


def rank_totals(spark, d):
    """Samples, mean loss and greatest memory over ranks."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.count("*").alias("samples"), F.avg("value").alias("loss"), F.max("value").alias("memory"))
    return e.agg(F.sum("samples").alias("samples"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.max("memory"), 6).alias("memory"))


def benchmark_checks(spark, d):
    t = scored_rows(spark, d).withColumn("action", F.when(h(F.col(K), 9) % 50 > 0, F.col("target_action")).otherwise("drag"))
    t = t.withColumn("box", F.when(h(F.col(K), 10) % 40 == 0, F.transform("target_box", lambda v: v * 2)).otherwise(F.col("target_box")))
    return R.benchmark_checks(t, K, "event_type", "action", "box", A.ACTIONS)


def prediction_records(spark, d):
    """Predictions of events as records; one in fifty failed."""
    t = scored_rows(spark, d)
    out = t.select(K, "target_action", "prediction", F.col("value").alias("latency"), F.when(h(F.col(K), 11) % 50 == 0, F.concat(F.lit("TimeoutError: "), K)).alias("error"))
    r = R.prediction_records(out, [K, "target_action"], "prediction", "error", ["latency"])
    return r.withColumn("predicted_box", F.array_join(F.transform("predicted_box", lambda v: v.cast("int")), ","))


def colour_rules(spark, d):
    """As rule_checks, by colours: two returned lines that are shipped, one open line of no flag, fewer than three accepted."""
    o = _line_objects(spark, d)
    o = o.withColumns({"include": F.array(_clause("R", 2, "F"), _clause("N", 1, "O")), "exclude": F.array(_clause("A", 3))})
    return o.select("l_orderkey", B.judged_rules("objects", "include", "exclude").alias("r")).select("l_orderkey", "r.correct", "r.reason")


def seeded_file_order(spark, d):
    files = table(spark, d, "supplier").select(F.concat(F.lit("part-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("path")).withColumn("epoch", F.lit(3))
    return R.seeded_files(files, "path", 42, F.col("epoch"), 2, 2).select("path", "rank", "worker", "turn")


def video_turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    turns = F.array(F.concat(F.lit("<video> what? "), "conv_id"), F.lit("an answer"))
    return c.select("conv_id", F.array_join(T.with_frames(turns, (h(F.col("conv_id"), 0) % 4 + 1).cast("int")), "|").alias("turns"))


def marked_images(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.lit(" see <img><|image_"), h(k, 0) % 9, F.lit("|></img>"), F.when(k % 2 == 0, " then ").otherwise(" "), F.lit("<img><|image_12|></img> end "))
    e = T.marked_images(text)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(e, lambda x: F.coalesce(x["text"], F.concat(F.lit("#"), x["image"].cast("string")))), "|").alias("elements"))


def byte_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", Q.byte_tokens(F.col("text")).alias("ids"))
    return t.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (Q.byte_text(F.col("ids")) == F.col("text")).alias("same"))


def adaptive_lengths(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", G.adaptive_length(n).alias("length"))


def spread_positions(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 1).cast("int").alias("r"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("c"))
    return t.select("n_nationkey", F.array_join(G.spread_positions(F.col("r"), F.col("c"), 10), ",").alias("ids"))


def guided_steps(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 24.0).alias("t"))
    return t.select("n_nationkey", G.guided_scale(F.col("t"), F.lit(4.0), 0.25, 0.75).alias("scale"))


def quarter_crops(spark, d):
    n = (F.col("n_nationkey") % 6).cast("int")
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(G.quarter_crops(F.lit(512), n), lambda c: F.array_join(c, ",")), "|").alias("crops"))


def patch_rows(spark, d):
    """The first twelve numbers of a vector as three channels of 2 x 2, in patches of 1 and of 2."""
    v = F.slice(F.transform("embedding", lambda x: F.rint(x * 1000).cast("int")), 1, 12)
    joined = lambda p: F.array_join(F.transform(Q.patches(v, 3, 2, 2, p), lambda x: F.array_join(x, ",")), "|")
    return table(spark, d, "embeddings").select("vec_id", joined(1).alias("ones"), joined(2).alias("twos"))


def merged_segments(spark, d):
    k = F.col("page_id")
    kinds = F.array(F.lit("text"), F.when(h(k, 0) % 2 == 0, "vit_image").otherwise("vae_image"), F.lit("text"))
    lens = F.array(*((h(k, i) % 9 + 1).cast("int") for i in (1, 2, 3)))
    m = Q.merged_segments(kinds, lens, F.array(F.lit("causal"), F.lit("full"), F.lit("noise")))
    return table(spark, d, "pages").select("page_id", F.array_join(m["lengths"], ",").alias("lengths"), F.array_join(m["modes"], ",").alias("modes"))


def adapted_ids(spark, d):
    k = F.col("doc_id")
    ids = F.sequence(F.lit(1), F.lit(20))
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.adapted(ids, 0, k), ",").alias("ids"))


def edit_merges(spark, d):
    k = F.col("page_id")
    n = (h(k, 0) % 5 + 2).cast("int")
    s = Q.edit_steps(n, H.uniform("g", k) < 0.5, k)
    return table(spark, d, "pages").select("page_id", s["start"].alias("start"), s["end"].alias("end"), s["merged"].alias("merged"))


def sample_hashes(spark, d):
    t = targets(spark, d)
    return t.select(K, H.sample_hash(F.col("event_type"), F.col("target_action"), F.col("target_box")).alias("sample"), H.cache_key(F.col("event_type"), F.col("target_box")).alias("cache"))


def utc_stamps(spark, d):
    return table(spark, d, "events").select(K, H.utc_stamp(F.col("ts")).alias("stamp"))


def _line_objects(spark, d):
    """Orders as images, their lines as objects from left to right; a line's status is its colour."""
    li = table(spark, d, "lineitem")
    x = F.col("l_linenumber").cast("double") * 20
    box = F.array(x, F.lit(0.0), x + 10, F.lit(10.0))
    thing = F.struct("l_linenumber", F.col("l_returnflag").alias("class"), box.alias("box"), F.col("l_linestatus").alias("color"))
    o = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(thing)).alias("o"))
    return o.select("l_orderkey", F.transform("o", lambda t: F.struct(t["class"].alias("class"), t["box"].alias("box"), t["color"].alias("color"))).alias("objects"))


def _clause(name, n, color=None, side=None, of=None):
    return F.struct(F.lit(name).alias("class"), F.lit(n).alias("count"), F.lit(color).cast("string").alias("color"), F.lit(side).cast("string").alias("side"), F.lit(of).cast("int").alias("of"))


def rule_checks(spark, d):
    """Orders as images, their lines as objects: one accepted, one returned that stands right of it, fewer than two of no flag."""
    o = _line_objects(spark, d).withColumns({"include": F.array(_clause("A", 1), _clause("R", 1, side="right of", of=0)), "exclude": F.array(_clause("N", 2))})
    return o.select("l_orderkey", B.judged_rules("objects", "include", "exclude").alias("r")).select("l_orderkey", "r.correct", "r.reason")


QUERIES = {f.__name__: f for f in (
    scan_skip_rules, scan_text_only, row_hook, key_rename, seeded_line_order, ordered_prefix, numbered_images, latest_steps, external_boxes, web_routing,
    protocol_prompts, element_prompts, last_answers, realigned_boxes, realigned_rates, question_coverage, replay_turns, last_crop_categories, token_losses,
    rank_totals, benchmark_checks, prediction_records, colour_rules, seeded_file_order, video_turns, marked_images, byte_tokens, adaptive_lengths, spread_positions, guided_steps, quarter_crops,
    patch_rows, merged_segments, adapted_ids, edit_merges, sample_hashes, utc_stamps, rule_checks,
)}

_hex = lambda *parts: "substr(sha256(" + " || chr(31) || ".join(parts) + "), 1, 16)"
_u = lambda *parts: f"(('0x' || substr({_hex(*parts)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_TALK = f"""t AS (SELECT conv_id, {sql_h("conv_id", 1)} % 3 AS images, bool_or(role = 'assistant') AS loss, bool_or(trim(coalesce(text, '')) <> '') AS said FROM conversations GROUP BY conv_id)"""
_REALIGNED = f"""r AS (SELECT *, {sql_h("event_id", 10)} % 4 > 0 AND {sql_h("event_id", 11)} % 3 > 0 AND {sql_h("event_id", 9)} % 10 > 0 AS good,
  CASE WHEN {sql_h("event_id", 9)} % 10 = 0 THEN 'ocr failed' END AS error FROM targets)"""
_D = lambda v: f"({v})::DOUBLE"
_LIST = " || '/' || ".join
ORACLE = {
    "scan_skip_rules": f"WITH {_TALK} SELECT conv_id, images::INT AS images FROM t WHERE loss AND said AND images > 0",
    "scan_text_only": f"WITH {_TALK} SELECT conv_id FROM t WHERE loss AND said",
    "row_hook": "SELECT conv_id, turn, upper(role) AS who FROM conversations WHERE role <> 'system' AND turn % 2 = 0",
    "key_rename": "SELECT n_nationkey, n_name AS txt FROM nation",
    "seeded_line_order": f"""SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_hex("'42'", "event_type", "event_id")}, event_id)::INT AS place FROM events) WHERE place <= 50""",
    "ordered_prefix": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "numbered_images": "SELECT p_partkey, p_partkey AS prompt, p_size::BIGINT AS image FROM part WHERE p_partkey % 3 <> 0",
    "latest_steps": "SELECT o_custkey, 'runs/' || o_custkey || '/' || lpad(max(o_orderkey)::VARCHAR, 9, '0') AS latest FROM orders GROUP BY 1",
    "external_boxes": with_sql(
        """SELECT event_id, CASE WHEN own THEN '1/2/3/4' WHEN enc = 2 AND least(x1 + x2, 1000) > x1 AND least(y1 + y2, 1000) > y1
          THEN x1 || '/' || y1 || '/' || least(x1 + x2, 1000) || '/' || least(y1 + y2, 1000) ELSE x1 || '/' || y1 || '/' || x2 || '/' || y2 END AS box FROM k""",
        f"k AS (SELECT *, {sql_h('event_id', 9)} % 5 AS enc, {sql_h('event_id', 10)} % 7 = 0 AS own FROM targets)",
    ),
    "web_routing": f"""SELECT CASE WHEN {sql_h("event_id", 2)} % 2 = 0 THEN 'text' ELSE 'icon' END AS route, count(*) AS n FROM events WHERE {sql_h("event_id", 0)} % 3 = 0 OR {sql_h("event_id", 1)} % 3 = 0 GROUP BY 1""",
    "protocol_prompts": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Click on ' || p_name || '.'
      ELSE 'Complete the following web task by predicting the next GUI action.' || chr(10) || 'Task: ' || p_name || chr(10) || 'Previous actions:' || chr(10) || '- a' END AS prompt FROM part""",
    "element_prompts": """SELECT p_partkey, 'Locate and click the web UI element described as: "' || p_name || '".' AS element,
      md5('The following 4 images are non-overlapping tiles from one ' || p_size || 'x720 webpage screenshot, ordered left-to-right and then top-to-bottom. Treat them as one complete page. ' || p_name
      || ' Return the action and bounding box with coordinates normalized to the complete original screenshot in [0,1000].') AS page FROM part""",
    "last_answers": with_sql("SELECT event_id, 'hover [1,1,2,2]|go|' || target_action || ' [5,6,7,8]|x' AS values FROM targets"),
    "realigned_boxes": with_sql(
        f"SELECT event_id, {_LIST(f'{_D(f'{v} + good::INT')}' for v in ('x1', 'y1', 'x2', 'y2'))} AS box, good AS accepted, error FROM r", _REALIGNED
    ),
    "realigned_rates": with_sql(
        """SELECT event_type, count(*) AS n, count(*) FILTER (good) AS matched, count(*) FILTER (NOT good) AS fallback, count(error) AS errors, round(avg(good::INT), 9) AS match_rate FROM r GROUP BY 1""",
        _REALIGNED,
    ),
    "question_coverage": """SELECT c_custkey, n AS questions, CASE WHEN n IS NULL THEN 'no_questions' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "replay_turns": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) USING (conv_id, turn)",
    "last_crop_categories": """SELECT l_returnflag, round(avg((l_quantity > 25)::INT), 9) AS mean_score, count(*) AS n FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) USING (l_orderkey, l_linenumber) GROUP BY 1""",
    "token_losses": "SELECT l_returnflag, round(sum(l_discount) * 8 / sum(l_quantity), 9) AS loss FROM lineitem GROUP BY 1",
    "rank_totals": "SELECT sum(n)::BIGINT AS samples, round(avg(l), 6) AS loss, round(max(m), 6) AS memory FROM (SELECT count(*) AS n, avg(value) AS l, max(value) AS m FROM events GROUP BY user_id % 8)",
    "benchmark_checks": with_sql(
        f"""SELECT count(*) AS n, count(*) - count(DISTINCT event_id) AS repeated, count(DISTINCT event_type) AS benchmarks, count(*) FILTER ({sql_h("event_id", 9)} % 50 = 0) AS bad_actions,
        count(*) FILTER ({sql_h("event_id", 10)} % 40 = 0 AND 2 * greatest(x2, y2) > 1000) AS bad_boxes FROM targets"""
    ),
    "seeded_file_order": f"""WITH f AS (SELECT 'part-' || lpad(s_suppkey::VARCHAR, 6, '0') AS path FROM supplier), o AS (SELECT path, row_number() OVER (ORDER BY {_hex("'42'", "'3'", "path")}, path) - 1 AS i, count(*) OVER () AS n FROM f),
      p AS (SELECT path, i, n // 2 AS r, (n // 2) // 2 AS w FROM o), q AS (SELECT path, w, CASE WHEN r > 0 THEN i // r END AS rank, CASE WHEN r > 0 THEN i % r END AS j FROM p),
      s AS (SELECT path, w, rank, j, CASE WHEN w > 0 THEN j // w END AS worker FROM q)
      SELECT path, CASE WHEN ok THEN rank END::INT AS rank, CASE WHEN ok THEN worker END::INT AS worker, CASE WHEN ok THEN w - 1 - j % w END::INT AS turn FROM (SELECT *, coalesce(rank < 2 AND worker < 2, false) AS ok FROM s)""",
    "video_turns": f"SELECT conv_id, repeat('<image>', ({sql_h('conv_id', 0)} % 4 + 1)::INT) || ' what? ' || conv_id || '|an answer' AS turns FROM (SELECT DISTINCT conv_id FROM conversations)",
    "marked_images": f"SELECT doc_id, 'see|#' || ({sql_h('doc_id', 0)} % 9) || CASE WHEN doc_id % 2 = 0 THEN '|then' ELSE '' END || '|#12|end' AS elements FROM documents",
    "byte_tokens": "SELECT doc_id, octet_length(encode(text))::INT AS n, list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT))::BIGINT AS total, true AS same FROM documents",
    "adaptive_lengths": "SELECT doc_id, (CASE WHEN n_chars > p * 3 // 4 THEN p ELSE p * 3 // 4 END)::BIGINT AS length FROM (SELECT doc_id, n_chars, CASE WHEN n_chars <= 0 THEN 1 ELSE 1 << length(ltrim(bin(n_chars), '0')) END AS p FROM documents)",
    "spread_positions": """SELECT n_nationkey, array_to_string(flatten(list_transform(range(n_nationkey % 5 + 1), lambda r: list_transform(range(n_nationkey % 7 + 1), lambda c: (r * 10 // (n_nationkey % 5 + 1)) * 10 + c * 10 // (n_nationkey % 7 + 1)))), ',') AS ids FROM nation""",
    "guided_steps": "SELECT n_nationkey, (CASE WHEN n_nationkey / 24.0 > 0.25 AND n_nationkey / 24.0 <= 0.75 THEN 4 ELSE 1 END)::DOUBLE AS scale FROM nation",
    "quarter_crops": """SELECT n_nationkey, CASE WHEN n_nationkey % 6 <= 1 THEN '' ELSE array_to_string(['0,0,512,512', '512,0,1024,512', '0,512,512,1024', '512,512,1024,1024'][1:least(n_nationkey % 6, 4)], '|') END AS crops FROM nation""",
    "patch_rows": """WITH v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: round_even(x::DOUBLE * 1000, 0)::INT) AS v FROM embeddings),
      p AS (SELECT vec_id, list_transform(range(4), lambda i: array_to_string([v[i + 1], v[i + 5], v[i + 9]], ',')) AS p FROM v)
      SELECT vec_id, array_to_string(p, '|') AS ones, array_to_string(p, ',') AS twos FROM p""",
    "merged_segments": f"""SELECT page_id, CASE WHEN m THEN (a + b + c)::VARCHAR ELSE a || ',' || b || ',' || c END AS lengths, CASE WHEN m THEN 'full' ELSE 'causal,full,noise' END AS modes FROM
      (SELECT page_id, {sql_h("page_id", 0)} % 2 = 0 AS m, {sql_h("page_id", 1)} % 9 + 1 AS a, {sql_h("page_id", 2)} % 9 + 1 AS b, {sql_h("page_id", 3)} % 9 + 1 AS c FROM pages)""",
    "adapted_ids": f"""SELECT doc_id, array_to_string(CASE WHEN u < 0.1 THEN range(1, 21) || list_transform(range((floor(v * 20) + 1)::INT), lambda x: 0) WHEN u < 0.2 THEN range(1, (floor(v * 19) + 2)::INT) ELSE range(1, 21) END, ',') AS ids
      FROM (SELECT doc_id, {_u("'a'", "doc_id")} AS u, {_u("'b'", "doc_id")} AS v FROM documents)""",
    "edit_merges": f"""WITH a AS (SELECT page_id, {sql_h("page_id", 0)} % 5 + 2 AS n, {_u("'s'", "page_id")} AS s, {_u("'t'", "page_id")} AS t, {_u("'g'", "page_id")} AS g FROM pages), b AS (SELECT *, floor(s * (n - 1))::INT AS start FROM a),
      c AS (SELECT *, start + 1 + floor(t * (least(start + 3, n) - start - 1))::INT AS e FROM b), m AS (SELECT *, e - start > 1 AND g < 0.5 AS merged FROM c)
      SELECT page_id, start, (CASE WHEN merged AND e = n - 1 THEN e - 1 ELSE e END)::INT AS "end", merged FROM m""",
    "sample_hashes": with_sql(
        f"""SELECT event_id, substr(sha256(event_type || chr(31) || target_action || chr(31) || '[' || {" || ', ' || ".join(f"{v} || '.0'" for v in ("x1", "y1", "x2", "y2"))} || ']'), 1, 20) AS sample,
        event_type || ':' || {" || ',' || ".join(f"{v} || '.000'" for v in ("x1", "y1", "x2", "y2"))} AS cache FROM targets"""
    ),
    "utc_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
    "prediction_records": with_sql(f"""SELECT event_id, target_action, CASE WHEN bad THEN '' ELSE prediction END AS prediction, CASE WHEN NOT bad THEN predicted END AS predicted_action,
      CASE WHEN NOT bad AND error IS NULL THEN concat_ws(',', px1::INT, py1::INT, px2::INT, py2::INT) END AS predicted_box, CASE WHEN NOT bad THEN trim(coalesce(m.said_value, '')) ELSE '' END AS predicted_value,
      CASE WHEN bad THEN 'inference_error' ELSE error END AS parse_error, CASE WHEN NOT bad THEN value END AS latency, CASE WHEN bad THEN 'TimeoutError: ' || event_id END AS error
      FROM (SELECT *, {sql_h("event_id", 11)} % 50 = 0 AS bad FROM errors)"""),
    "colour_rules": """WITH a AS (SELECT l_orderkey, list(l_linestatus ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag = 'R') AS r, list(l_linestatus ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag = 'N') AS n,
        count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1),
      c AS (SELECT l_orderkey, a, coalesce(len(r), 0) AS r, coalesce(len(n), 0) AS n, len(list_filter(coalesce(r, [])[1:2], lambda x: x = 'F')) AS rf, len(list_filter(coalesce(n, [])[1:1], lambda x: x = 'O')) AS no FROM a),
      p AS (SELECT l_orderkey, CASE WHEN r < 2 THEN 'expected R>=2, found ' || r WHEN rf < 2 THEN 'expected F R>=2, found ' || rf || ' F' END AS p1,
        CASE WHEN n < 1 THEN 'expected N>=1, found 0' WHEN no < 1 THEN 'expected O N>=1, found 0 O' END AS p2, CASE WHEN a >= 3 THEN 'expected A<3, found ' || a END AS p3 FROM c)
      SELECT l_orderkey, p1 IS NULL AND p2 IS NULL AND p3 IS NULL AS correct, concat_ws(chr(10), p1, p2, p3) AS reason FROM p""",
    "rule_checks": """WITH a AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'A') AS a, min(l_linenumber) FILTER (l_returnflag = 'R') AS s, count(*) FILTER (l_returnflag = 'N') AS r FROM lineitem GROUP BY 1),
      p AS (SELECT l_orderkey, CASE WHEN a IS NULL THEN 'expected A>=1, found 0' END AS p1, CASE WHEN s IS NULL THEN 'expected R>=1, found 0' WHEN a IS NULL THEN 'no target for R to be right of' WHEN s <= a THEN 'expected R right of target' END AS p2,
        CASE WHEN r >= 2 THEN 'expected N<2, found ' || r END AS p3 FROM a)
      SELECT l_orderkey, p1 IS NULL AND p2 IS NULL AND p3 IS NULL AS correct, concat_ws(chr(10), p1, p2, p3) AS reason FROM p""",
}
