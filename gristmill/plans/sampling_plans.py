"""Queries on samples, orders, sets and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.hashing import paired_seed, stable_hex
from gristmill.operators import audit as U
from gristmill.operators import sampling as P
from gristmill.operators import validation as V
from gristmill.plans.synth import h, sql_h, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")


def stable_sample(spark, d):
    return P.stable_sample(_docs(spark, d), 100, 42, "doc_id").select("doc_id", "source")


def balanced_repeat(spark, d):
    docs = _docs(spark, d)
    return P.balanced_repeat(docs, 2 * docs.count() + 37, 42, "doc_id").select("doc_id", "variant")


def variant_topup(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    return P.top_up(s, int(s.count() * 2.5), 7, "s_suppkey")


def priority_fill(spark, d):
    docs = _docs(spark, d)
    return P.priority_fill(docs.filter("lang = 'es'"), docs.filter("lang <> 'es'"), docs.filter("lang = 'es'").count() + 50, 3, "doc_id").select("doc_id", "lang")


def first_n_per_source(spark, d):
    return P.first_per_key(_docs(spark, d), "source", ["doc_id"], 20).select("source", "doc_id")


def shard_assign(spark, d):
    n = table(spark, d, "events").count()
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", P.shard(i, 7).alias("modulo"), P.contiguous_shard(i, F.lit(n), 7).alias("chunk"), P.contiguous_shard(i, F.lit(n), 7, True).alias("floor_chunk")
    )


def run_islands(spark, d):
    r = P.runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


def dedupe_first_wins(spark, d):
    t = table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return t


def mixture_assign(spark, d):
    return P.mixture(_docs(spark, d), {"a": 0.5, "b": 0.3, "c": 0.0, "e": 0.2}, 11, "doc_id").select("doc_id", "mix")


def weighted_interleave(spark, d):
    """Documents of four languages merged by weights; one language has none and is left out."""
    return P.interleaved(_docs(spark, d), "lang", {"en": 0.5, "de": 0.3, "fr": 0.2, "es": 0.0}, 11, "doc_id").filter("at IS NOT NULL").select("doc_id", "lang", "at")


def seeds(spark, d):
    k = F.concat(F.lit("u"), "event_id")
    return table(spark, d, "events").select("event_id", paired_seed(42, k).alias("seed"), stable_hex("s", k).alias("hex"))


def last_k_actions(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, -1)
    return table(spark, d, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), ",").alias("history"))


def union_sources(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s, allowMissingColumns=True)


def except_both(spark, d):
    """Suppliers and users of events by number: those that are on one side only."""
    s, u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "events").select((F.col("user_id") + 5).alias("k"))
    a = s.subtract(u).select("k", F.lit("supplier").alias("side"))
    return a.union(u.subtract(s).select("k", F.lit("user")))


def intersect_keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


def semi_join_prefilter(spark, d):
    b = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return _docs(spark, d).join(b, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def stem_join(spark, d):
    stem = F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1).try_cast("long")
    p = table(spark, d, "pages").select("page_id", stem.alias("doc_id"))
    return p.join(_docs(spark, d), "doc_id").select("page_id", "doc_id", "source")


def dual_protocol_explode(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.array(F.lit("history"), F.lit("target"))).alias("protocol"))
    return p.select("page_id", "protocol", F.concat_ws("_", "protocol", "page_id").alias("sample_id"))


_RULES = [("empty", "length(text) = 0"), ("short", "n_chars < 200"), ("shouting", "text = upper(text)"), ("personal", "position('@' IN text) > 0")]


def _rejected(spark, d):
    t = table(spark, d, "documents")
    return t.withColumn("why", V.reason(*((n, F.expr(e)) for n, e in _RULES)))


def reject_reasons(spark, d):
    return V.counters(_rejected(spark, d), "why")


def source_counts(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("texts"))


def corpus_validate(spark, d):
    t = table(spark, d, "documents").withColumn("answer", F.when(h(F.col("doc_id"), 0) % 9 == 0, "lclick [1, 2,3,4]").otherwise("hover [1,2,3,4]"))
    return V.corpus_report(t, ("doc_id", "text", "source"), "doc_id", "source", "answer", F.col("text").cast("binary"))


def corpus_sources(spark, d):
    """Documents of every source against expected counts, which are wrong for sources of an odd number of rows; with answers out of order."""
    k = F.col("doc_id")
    box = F.concat(F.lit("lclick ["), F.concat_ws(",", *((h(k, i) % 700 + (300 if i > 1 else 0)).cast("string") for i in range(4))), F.lit("]"))
    t = table(spark, d, "documents").select("doc_id", "source", "text", box.alias("answer"))
    n = t.groupBy("source").agg(F.count("*").alias("n")).select("source", (F.floor(F.col("n") / 2) * 2).alias("expected"))
    expected = n.unionByName(t.sparkSession.range(1).select(F.lit("nowhere").alias("source"), F.lit(5).cast("long").alias("expected")))
    return U.source_report(t, expected, "doc_id", "source", F.col("text").cast("binary"), ~U.ordered_box(F.col("answer")))


def box_problems(spark, d):
    """Boxes of events, some without numbers, without size or beside the screen: how many for each reason."""
    k = F.col("event_id")
    x, y = h(k, 0) % 2000 - 300, h(k, 1) % 1200 - 200
    box = F.when(h(k, 4) % 30 > 0, F.array(x, y, x + h(k, 2) % 90, y + 20))
    rows = table(spark, d, "events").select(V.box_problem(box, F.lit(1280), F.lit(720)).alias("why"))
    return V.counters(rows, "why")


def record_problems(spark, d):
    """Documents as records with an answer and a source: why some aren't made."""
    k = F.col("doc_id")
    answer = F.when(h(k, 0) % 7 == 0, "click [1,2,3,4]").otherwise("hover [1,2,3,4]")
    content = F.when(h(k, 1) % 11 == 0, "").otherwise(F.col("text")).cast("binary")
    source = F.when(h(k, 2) % 5 == 0, " ").otherwise(F.col("source"))
    return V.counters(table(spark, d, "documents").select(V.record_problem(content, answer, {"source": source}).alias("why")), "why")


def token_window_filter(spark, d):
    t = _docs(spark, d).withColumn("tokens", F.col("n_chars"))
    _, counter = V.token_window(t, "tokens", 1000, 4000)
    return t.groupBy(counter.alias("counter")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def fit_asymmetry(spark, d):
    n, plan = F.col("n_chars"), F.lit(3)
    return _docs(spark, d).agg(F.count_if(V.fits(n, plan, 2006)).alias("normal"), F.count_if(V.fits(n, plan, 2006, True)).alias("mandatory"))


def unnest_elements(spark, d):
    k = F.col("page_id")
    el = F.transform(F.sequence(F.lit(0), (h(k, 0) % 5).cast("int")), lambda i: F.struct(i.alias("at"), ((h(k, 1) + i * 7) % 10 - 2).alias("w")))
    p = table(spark, d, "pages").select("page_id", el.alias("elements"))
    u = V.unnest(p, "elements", F.col("element.w") > 0, ["page_id"])
    return u.select("page_id", "position", F.col("element.w").alias("w"), "valid")


QUERIES = {f.__name__: f for f in (
    stable_sample, balanced_repeat, variant_topup, priority_fill, first_n_per_source, shard_assign, run_islands, dedupe_first_wins, mixture_assign, weighted_interleave, seeds,
    last_k_actions, union_sources, except_both, intersect_keys, semi_join_prefilter, stem_join, dual_protocol_explode, reject_reasons, source_counts,
    corpus_validate, corpus_sources, box_problems, record_problems, token_window_filter, fit_asymmetry, unnest_elements,
)}

_hex = lambda *parts: "substr(sha256(" + " || chr(31) || ".join(parts) + "), 1, 16)"
ORACLE = {
    "stable_sample": f"SELECT doc_id, source FROM documents ORDER BY {_hex("'42'", 'doc_id')}, doc_id LIMIT 100",
    "balanced_repeat": f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_hex("'42'", "'selection'", "doc_id")}, doc_id) - 1 AS i, count(*) OVER () AS t FROM documents)
      SELECT doc_id, unnest(range((2 * t + 36 - i) // t + 1))::INT AS variant FROM o""",
    "variant_topup": f"""WITH n AS (SELECT (count(*) * 2.5)::INT AS n, count(*) AS t FROM supplier), v AS (SELECT s_suppkey, v::INT AS variant FROM supplier, range(10) r(v)),
      o AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY {_hex("'7'", "variant", "s_suppkey")}, s_suppkey) AS r FROM v)
      SELECT s_suppkey, variant FROM o, n WHERE variant * t + r <= floor(t * 2.5)""",
    "priority_fill": f"""SELECT doc_id, lang FROM documents WHERE lang = 'es' UNION ALL
      (SELECT doc_id, lang FROM documents WHERE lang <> 'es' ORDER BY {_hex("'3'", "doc_id")}, doc_id LIMIT 50)""",
    "first_n_per_source": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20",
    "shard_assign": """WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id, (event_id % 7)::INT AS modulo, floor(event_id / ceil(n / 7))::INT AS chunk,
      CASE WHEN event_id // (n // 7) < 7 THEN (event_id // (n // 7))::INT END AS floor_chunk FROM events, n""",
    "run_islands": """WITH a AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a) SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""",
    "dedupe_first_wins": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "mixture_assign": """SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'e' END AS mix FROM
      (SELECT doc_id, ('0x' || substr(sha256('11' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents)""",
    "weighted_interleave": f"""WITH g AS (SELECT doc_id, lang, {_hex("'11'", "'order'", "doc_id")} AS h, floor(-ln(1 - ('0x' || substr(sha256('11' || chr(31) || 'gap' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) * 1000000
        / CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END)::BIGINT AS gap FROM documents WHERE lang IN ('en', 'de', 'fr'))
      SELECT doc_id, lang, sum(gap) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS at FROM g""",
    "seeds": f"""SELECT event_id, ('0x' || substr(sha256('42' || chr(31) || 'u' || event_id), 1, 8))::BIGINT AS seed, {_hex("'s'", "'u' || event_id")} AS hex FROM events""",
    "last_k_actions": """SELECT event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ','), '') AS history FROM events""",
    "union_sources": "SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, NULL FROM supplier",
    "except_both": """(SELECT k, 'supplier' AS side FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT user_id + 5 FROM events)) UNION ALL
      (SELECT k, 'user' FROM (SELECT user_id + 5 AS k FROM events EXCEPT SELECT s_suppkey FROM supplier))""",
    "intersect_keys": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "semi_join_prefilter": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "stem_join": r"SELECT page_id, doc_id, source FROM (SELECT page_id, try_cast(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages) JOIN documents USING (doc_id)",
    "dual_protocol_explode": "SELECT page_id, protocol, protocol || '_' || page_id AS sample_id FROM pages, (VALUES ('history'), ('target')) v(protocol)",
    "reject_reasons": "SELECT coalesce('rejected:' || why, 'valid') AS counter, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {e} THEN '{n}'" for n, e in _RULES) + " END AS why FROM documents) GROUP BY 1",
    "source_counts": "SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY 1",
    "corpus_validate": f"""SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(DISTINCT source) AS n_sources, count(*) FILTER ({sql_h("doc_id", 0)} % 9 = 0) AS bad_answers, count(DISTINCT text) AS n_contents FROM documents""",
    "corpus_sources": f"""WITH a AS (SELECT source, doc_id, sha256(text) AS c, {sql_h("doc_id", 0)} % 700 AS x1, {sql_h("doc_id", 1)} % 700 AS y1, {sql_h("doc_id", 2)} % 700 + 300 AS x2, {sql_h("doc_id", 3)} % 700 + 300 AS y2,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
      SELECT source, count(*) AS rows, count(*) // 2 * 2 AS expected, count(*) % 2 = 0 AS equal, count(*) FILTER (x2 <= x1 OR y2 <= y1) AS invalid, count(*) FILTER (r <= 200) AS checked, count(DISTINCT c) FILTER (r <= 200) AS contents
      FROM a GROUP BY source UNION ALL SELECT 'nowhere', 0, 5, false, 0, 0, 0""",
    "box_problems": f"""WITH b AS (SELECT {sql_h("event_id", 0)} % 2000 - 300 AS x, {sql_h("event_id", 1)} % 1200 - 200 AS y, {sql_h("event_id", 2)} % 90 AS w, {sql_h("event_id", 4)} % 30 > 0 AS there FROM events)
      SELECT coalesce('rejected:' || why, 'valid') AS counter, count(*) AS n FROM (SELECT CASE WHEN NOT there THEN 'missing_box' WHEN w <= 0 THEN 'zero_size' WHEN x + w <= 0 OR y + 20 <= 0 OR x >= 1280 OR y >= 720 THEN 'off_screen' END AS why FROM b) GROUP BY 1""",
    "record_problems": f"""SELECT coalesce('rejected:' || why, 'valid') AS counter, count(*) AS n FROM (SELECT CASE WHEN {sql_h("doc_id", 1)} % 11 = 0 OR coalesce(text, '') = '' THEN 'empty_content'
      WHEN {sql_h("doc_id", 2)} % 5 = 0 OR trim(source) = '' THEN 'missing:source' WHEN {sql_h("doc_id", 0)} % 7 = 0 THEN 'invalid_answer' END AS why FROM documents) GROUP BY 1""",
    "token_window_filter": """SELECT CASE WHEN n_chars <= 1000 THEN 'filtered:short' WHEN n_chars > 4000 THEN 'filtered:long' ELSE 'valid' END AS counter, count(*) AS n, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1""",
    "fit_asymmetry": "SELECT count(*) FILTER (n_chars + 6 <= 2006) AS normal, count(*) FILTER (n_chars + 6 < 2006) AS mandatory FROM documents",
    "unnest_elements": f"""WITH e AS (SELECT page_id, unnest(range({sql_h("page_id", 0)} % 5 + 1))::INT AS position, {sql_h("page_id", 1)} AS b FROM pages)
      SELECT page_id, position, (b + position * 7) % 10 - 2 AS w, (b + position * 7) % 10 - 2 > 0 AS valid FROM e""",
}
