"""Queries on text, prompts and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import actions as A
from gristmill.functions import text as T
from gristmill.plans.synth import h, sql_h, table


def compact_redact(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    talk = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("key"), "text")
    return docs.union(talk).select("key", F.md5(T.compact(F.col("text"))).alias("digest"))


def canonicalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.canonicalize(F.col("text"))).alias("digest"))


def article_plural(spark, d):
    return table(spark, d, "part").select("p_partkey", T.with_article(F.col("p_name")).alias("one"), T.plural(F.col("p_name")).alias("many"))


def category_split(spark, d):
    label = F.concat("p_type", F.lit(" - kind (size "), F.col("p_size"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", T.broad_category(label).alias("l1"), T.detailed_category(label).alias("l2"))


def final_answers(spark, d):
    t = F.concat(F.lit("<think>why</think> "), F.col("text"), F.lit("<|endoftext|>"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.final_answer(t)).alias("digest"))


def caption_choice(spark, d):
    k = F.col("doc_id")
    caps = [F.when(h(k, i) % 3 > 0, F.concat(F.lit(f"caption {i} of "), "doc_id")) for i in range(4)]
    return table(spark, d, "documents").select("doc_id", T.pick_caption(caps, 5, k).alias("caption"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.schema_of_variant("v").startswith("OBJECT").alias("is_object"))


_OPS = ("CLICK", "HOVER", "TYPE", "SELECT", "ENTER")


def _targets(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, _OPS)), h(k, 0) % 5 + 1)
    typed = op.isin("TYPE", "SELECT")
    head = F.concat(F.when(h(k, 1) % 4 > 0, "[button] ").otherwise(""), F.when(h(k, 2) % 5 > 0, F.concat(F.lit("Item -> "), "event_type")).otherwise(""))
    text = F.concat(head, F.lit(" -> "), op, F.when(typed, ": some  value").otherwise(""))
    structured = F.when(h(k, 3) % 3 == 0, "hover").otherwise("")
    p = A.parsed_target(text, structured, F.lit(""), F.lit(""), F.when(h(k, 4) % 2 == 0, "spare"))
    return e.select("event_id", p.alias("p")).select("event_id", "p.*")


def target_repr_parse(spark, d):
    return _targets(spark, d)


def grounding_prompt(spark, d):
    return _targets(spark, d).select("event_id", A.grounding_prompt(F.col("operation"), F.col("description"), F.col("value")).alias("prompt"))


def task_history_prompt(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    acts = F.transform("t", lambda x: F.concat(x["role"], F.lit(" "), x["turn"].cast("string")))
    index = F.when(F.col("conv_id") % 3 == 0, "none").otherwise((F.col("conv_id") % 12).cast("string"))
    return c.select("conv_id", A.history_prompt(F.concat(F.lit("Do  task "), "conv_id"), acts, index).alias("prompt"))


QUERIES = {f.__name__: f for f in (
    compact_redact, canonicalize_text, article_plural, category_split, final_answers, caption_choice, json_props, target_repr_parse, grounding_prompt, task_history_prompt,
)}

_SQUEEZE = r"trim(regexp_replace(replace({t}, chr(0), ' '), '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+', ' ', 'g'))"
_COMPACT = r"substr(regexp_replace(regexp_replace({s}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '<EMAIL>', 'g'), '(?i)(password\s*[:=]\s*)([^\s,;]+)', '\1<REDACTED>', 'g'), 1, 2000)"
_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_T = f"""o AS (SELECT event_id, event_type, ['CLICK','HOVER','TYPE','SELECT','ENTER'][{sql_h("event_id", 0)} % 5 + 1] AS op, {sql_h("event_id", 1)} % 4 > 0 AS roled,
   {sql_h("event_id", 2)} % 5 > 0 AS named, {sql_h("event_id", 3)} % 3 = 0 AS structured, {sql_h("event_id", 4)} % 2 = 0 AS spare FROM events),
 p AS (SELECT event_id, CASE WHEN structured THEN 'HOVER' ELSE op END AS operation, CASE WHEN op IN ('TYPE', 'SELECT') THEN 'some value' ELSE '' END AS value,
   CASE WHEN named THEN 'Item -> ' || event_type WHEN spare THEN 'spare' WHEN roled THEN 'the button' ELSE 'the target UI element' END AS description,
   CASE WHEN roled THEN 'button' ELSE '' END AS role FROM o)"""
ORACLE = {
    "compact_redact": "WITH t AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations), s AS (SELECT key, "
    + _SQUEEZE.format(t="text") + " AS s FROM t) SELECT key, md5(" + _COMPACT.format(s="s") + ") AS digest FROM s",
    "canonicalize_text": "SELECT doc_id, md5(" + _SQUEEZE.format(t=f"translate(text, '{_MARKS}', '')") + ") AS digest FROM documents",
    "article_plural": """SELECT p_partkey, (CASE WHEN p_name[1] IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END) || p_name AS one,
      p_name || (CASE WHEN p_name[-1] = 's' THEN 'es' ELSE 's' END) AS many FROM part""",
    "category_split": "SELECT p_partkey, trim(split_part(p_type, '-', 1)) AS l1, trim(p_type || ' - kind') AS l2 FROM part",
    "final_answers": "SELECT conv_id, turn, md5(trim(text)) AS digest FROM conversations",
    "caption_choice": f"""WITH c AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {sql_h('doc_id', i)} % 3 > 0 THEN 'caption {i} of ' || doc_id END" for i in range(4))}], lambda x: x IS NOT NULL) AS caps,
      ('0x' || substr(sha256('5' || chr(31) || doc_id), 1, 16))::UBIGINT AS u FROM documents)
      SELECT doc_id, CASE WHEN len(caps) = 0 THEN ' ' ELSE caps[(u % greatest(len(caps), 1)::UBIGINT)::INT + 1] END AS caption FROM c""",
    "json_props": "SELECT event_id, CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' END AS is_object FROM events",
    "target_repr_parse": f"WITH {_T} SELECT event_id, CASE operation WHEN 'HOVER' THEN 'hover' WHEN 'TYPE' THEN 'type_in' WHEN 'SELECT' THEN 'type_in' ELSE 'lclick' END AS action, operation, value, description, role FROM p",
    "grounding_prompt": f"""WITH {_T} SELECT event_id, CASE WHEN operation = 'HOVER' THEN 'Hover over ' || description WHEN operation = 'TYPE' THEN 'Type "' || value || '" into ' || description
      WHEN operation = 'SELECT' THEN 'Select "' || value || '" from ' || description WHEN operation = 'ENTER' THEN 'Press Enter on ' || description ELSE 'Click on ' || description END || '.' AS prompt FROM p""",
    "task_history_prompt": """WITH c AS (SELECT conv_id, list(role || ' ' || turn ORDER BY turn, role) AS a FROM conversations GROUP BY 1),
      i AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN greatest(0, len(a) - 1) ELSE least(conv_id % 12, len(a)) END AS n FROM c),
      l AS (SELECT conv_id, n, a[greatest(1, n - 7):n] AS b FROM i)
      SELECT conv_id, 'Complete the following web task by predicting the next GUI action.' || chr(10) || 'Task: Do task ' || conv_id || CASE WHEN n > 0 THEN chr(10) || 'Previous actions:' || chr(10)
      || array_to_string(list_transform(b, lambda x: '- ' || x), chr(10)) ELSE '' END AS prompt FROM l""",
}
