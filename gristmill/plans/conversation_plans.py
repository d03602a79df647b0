"""Queries on conversations, plans, offsets and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.hashing import uniform
from gristmill.operators import conversation as C
from gristmill.operators import packing
from gristmill.plans.synth import h, sql_h, table


def _talks(spark, d):
    """Conversations as arrays of {role, content}."""
    t = table(spark, d, "conversations")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("c"))
    g = g.select("conv_id", F.transform("c", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit("<image> "), x["content"]).alias("content"))).alias("conversation"))
    return C.normalized(g, "conversation")


def conversation_normalize(spark, d):
    t = _talks(spark, d).select("conv_id", F.posexplode("turns").alias("i", "t"))
    return t.select("conv_id", "i", "t.role", F.md5("t.text").alias("digest"))


def conversation_rounds(spark, d):
    return _talks(spark, d).select("conv_id", "rounds", F.size("turns").alias("kept"))


def pair_shape(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    pair = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.concat(F.lit("q"), i).alias("user"), F.when(i % 3 > 0, F.concat(F.lit("a"), i)).alias("assistant")))
    t = C.normalized(t.select("conv_id", pair.alias("conversation")), "conversation")
    return t.select("conv_id", "rounds", F.array_join(F.transform("turns", lambda x: x["text"]), " ").alias("texts"))


def inline_image_split(spark, d):
    k = F.col("conv_id")
    text = F.concat(F.lit("see <image> and"), F.when(h(k, 0) % 2 == 0, " <image> or ").otherwise(" nothing "), F.lit("<image>"), "role")
    t = table(spark, d, "conversations").select("conv_id", "turn", C.interleaved(text, F.lit(2)).alias("e"))
    return t.select("conv_id", "turn", F.array_join(F.transform("e", lambda x: F.coalesce(x["text"], F.lit("#"))), "|").alias("elements"))


def zero_loss_filter(spark, d):
    t = _talks(spark, d).withColumn("e", C.elements(F.col("turns"), F.lit(1), F.col("rounds")))
    return t.filter(C.has_loss(F.col("e"))).select("conv_id", F.size("e").alias("n"))


def plan_lengths(spark, d):
    t = _talks(spark, d)
    words = F.aggregate("turns", F.lit(0), lambda a, x: a + F.size(F.split(x["text"], " ")))
    return t.select("conv_id", words.alias("words"), (words + 2 * F.size("turns")).alias("tokens"))


def sequence_offsets(spark, d):
    t = _talks(spark, d).select("conv_id", F.transform("turns", lambda x: F.length(x["text"]).cast("long")).alias("n"))
    t = t.select("conv_id", F.posexplode(F.arrays_zip("n", C.running_offsets(F.col("n")).alias("at"))).alias("i", "z"))
    return t.select("conv_id", "i", F.col("z.n").alias("n"), F.col("z.at").alias("start"))


def mask_hash(spark, d):
    """Tokens masked with a probability of their sample, by hash."""
    t = table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    p = 0.001 + 0.999 * uniform("p", F.col("doc_id"))
    masked = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: uniform("m", F.col("doc_id"), i) < F.col("p"))
    return t.withColumn("p", p).select("doc_id", F.round("p", 9).alias("p"), F.size(masked).alias("masked"))


def image_plans(spark, d):
    k = F.col("page_id")
    flag = lambda i: h(k, i) % 2 == 0
    plan = C.image_plan(flag(0), flag(1), flag(2))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(plan, lambda p: F.concat(p["type"], p["loss"].cast("string"))), ",").alias("plan"))


def attention_segments(spark, d):
    k = F.col("conv_id")
    t = table(spark, d, "conversations").select("conv_id").distinct()
    modes = F.array(F.lit("full"), F.when(h(k, 0) % 2 == 0, "noise").otherwise("causal"), F.lit("causal"))
    lens = F.array(*((h(k, i) % 4 + 1).cast("int") for i in (1, 2, 3)))
    a = C.attention(lens, modes)
    seen = F.aggregate(F.flatten(a), F.lit(0), lambda acc, x: acc + x.cast("int"))
    return t.select("conv_id", F.size(a).alias("n"), seen.alias("seen"))


LIMITS = {"expected": 4000, "most": 6000, "most_per_sample": 5000, "buffer_size": 5, "prefer_buffer_before": 2000}


def pack_sequences(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("tokens"))
    return packing.pack(t, "source", "doc_id", "doc_id", "tokens", **LIMITS)


def pack_sequences_keep(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("tokens"))
    return packing.pack(t, "source", "doc_id", "doc_id", "tokens", **LIMITS, drop_overflow=False)


def pack_mandatory(spark, d):
    """Every sequence begins with a document of the labels' good ones and one of the toxic ones."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    group = table(spark, d, "labels").groupBy("doc_id").agg(F.min(kind).alias("kind"))
    t = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("tokens")).join(group, "doc_id", "left")
    return packing.pack(t, "source", "doc_id", "doc_id", "tokens", "kind", **LIMITS)


QUERIES = {f.__name__: f for f in (
    conversation_normalize, conversation_rounds, pair_shape, inline_image_split, zero_loss_filter, plan_lengths, sequence_offsets, mask_hash, image_plans,
    attention_segments, pack_sequences, pack_sequences_keep, pack_mandatory,
)}

_TURNS = """t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN trim(text) ELSE '<image> ' || text END AS text FROM conversations WHERE role IN ('user', 'assistant')),
 k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS i FROM t WHERE text <> '')"""
ORACLE = {
    "conversation_normalize": f"WITH {_TURNS} SELECT conv_id, i, role, md5(text) AS digest FROM k",
    "conversation_rounds": f"WITH {_TURNS}, n AS (SELECT conv_id, (count(*) // 2)::INT AS rounds FROM conversations GROUP BY 1), m AS (SELECT conv_id, count(*) AS kept FROM k GROUP BY 1) SELECT conv_id, rounds, coalesce(kept, 0)::INT AS kept FROM n LEFT JOIN m USING (conv_id)",
    "pair_shape": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, n, unnest(range(1, n + 1)) AS i FROM n)
      SELECT conv_id, n::INT AS rounds, string_agg('q' || i || CASE WHEN i % 3 > 0 THEN ' a' || i ELSE '' END, ' ' ORDER BY i) AS texts FROM r GROUP BY 1, 2""",
    "inline_image_split": f"SELECT conv_id, turn, CASE WHEN {sql_h('conv_id', 0)} % 2 = 0 THEN 'see|#|and|#|or|' || role ELSE 'see|#|and nothing|#|' || role END AS elements FROM conversations",
    "zero_loss_filter": f"WITH {_TURNS} SELECT conv_id, (count(*) + 1)::INT AS n FROM k GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') > 0",
    "plan_lengths": f"""WITH {_TURNS}, w AS (SELECT conv_id, sum(len(string_split(text, ' '))) AS w, count(*) AS m FROM k GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations)
      SELECT conv_id, coalesce(w, 0)::INT AS words, (coalesce(w, 0) + 2 * coalesce(m, 0))::INT AS tokens FROM c LEFT JOIN w USING (conv_id)""",
    "sequence_offsets": f"WITH {_TURNS} SELECT conv_id, i, length(text) AS n, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY i) - length(text))::BIGINT AS start FROM k",
    "mask_hash": """WITH t AS (SELECT doc_id, len(string_split(text, ' ')) AS n, 0.001::DOUBLE + 0.999::DOUBLE * (('0x' || substr(sha256('p' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS p FROM documents),
      i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM t)
      SELECT doc_id, round(p, 9) AS p, (count(*) FILTER (('0x' || substr(sha256('m' || chr(31) || doc_id || chr(31) || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p))::INT AS masked FROM i GROUP BY 1, 2""",
    "image_plans": f"""SELECT page_id, concat_ws(',', CASE WHEN {sql_h("page_id", 0)} % 2 = 0 THEN 'vae_image1' END, CASE WHEN {sql_h("page_id", 1)} % 2 = 0 THEN 'vae_image0' END, CASE WHEN {sql_h("page_id", 2)} % 2 = 0 THEN 'vit_image0' END) AS plan FROM pages""",
    "attention_segments": f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), l AS (SELECT conv_id, {sql_h("conv_id", 0)} % 2 = 0 AS noise, {sql_h("conv_id", 1)} % 4 + 1 AS a, {sql_h("conv_id", 2)} % 4 + 1 AS b, {sql_h("conv_id", 3)} % 4 + 1 AS c FROM c)
      SELECT conv_id, (a + b + c)::INT AS n, (a * a + b * a + CASE WHEN noise THEN b * b ELSE b * (b + 1) // 2 END + c * a + CASE WHEN noise THEN 0 ELSE c * b END + c * (c + 1) // 2)::INT AS seen FROM l""",
}
