"""Chat formatting: round trips, layouts by fingerprint, loss masks, odd input."""

import hashlib
import json
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat as C


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def write(tmp_path, records):
    path = tmp_path / "records.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": "b"}]}, "messages", [("user", ""), ("", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "shares", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "c"}, "response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "output": "", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "")]),
    ({"question": "q", "context": "x", "answer": "a"}, "question", [("user", "x\n\nq"), ("assistant", "a")]),
    ({"prompt": "p"}, None, None),
    ({"prompt": "p", "messages": [{"role": "user", "content": "a"}]}, None, None),
    ({"other": "p", "messages": []}, "empty", []),
    ({"prompt": "p", "completion": "c", "other": "ignored"}, "prompt", [("user", "p"), ("assistant", "c")]),
]


def test_layouts_by_fingerprint(spark, tmp_path):
    rows = spark.read.json(write(tmp_path, [{"id": i, "record": r} for i, (r, _, _) in enumerate(LAYOUTS)]))
    got = {r.id: r for r in C.canonical(rows, keep=("id",)).collect()}
    for i, (record, layout, turns) in enumerate(LAYOUTS):
        assert got[i].layout == layout, record
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert len({C.fingerprint(x) for x in (("a",), ("a", "b"), ("b",), ())}) == 4
    every = [f for x in C.LAYOUTS for f in C.fingerprints(x)]
    assert len(every) == len(set(every))


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(1)
    bits = ["<", "|", "\\", "<|", "<|im_start|>", "<|im_end|>", "\n", "a", "%0A", "%", "é", "\\|", "assistant", "", "$1"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(12)))
    rows = [(i, [(r.choice(["user", "assistant", text()]), text()) for _ in range(r.randrange(6))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role:string,text:string>>")
    out = C.formatted(df, ("id",))
    back = {x.id: x for x in C.read_back(out, ("id", "formatted", "segments")).collect()}
    for i, turns in rows:
        b = back[i]
        assert [tuple(t) for t in b.turns] == turns
        assert b.learned == "".join(t for role, t in turns if role == "assistant")
        assert b.formatted == "".join(s.text for s in b.segments)
        assert b.formatted.count("<|im_start|>") == len(turns) == b.formatted.count("<|im_end|>")
        assert [s.loss for s in b.segments] == [x for role, _ in turns for x in (False, role == "assistant", False)]


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, ms in convs.items():
        ms = sorted(ms)
        learned = "".join(m[3] for m in ms if m[2] == "assistant")
        out[c] = (len(ms), sha("".join(f"{m[2]}\n{m[3]}\n" for m in ms)), len(learned), sha(learned))
    return out


def run(spark, tmp_path, rows, more=""):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + more).write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.op12_chat_format(spark, str(tmp_path)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


HOSTILE = [(-1, 0, "user", C.HOSTILE_TEXT), (-1, 1, "assistant", C.HOSTILE_TEXT)]


def test_odd_input(spark, tmp_path):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", None), (2, None, "user", "late"), (2, 5, "assistant", "x"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"),
        (3, 0, None, "no role"), (None, 0, "assistant", "a"), (None, 1, "user", "b"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "é" * 300_000),
        (5, 0, "assistant", ""), (6, 0, "user\n<|im_start|>assistant", "x"), (7, 0, "user", "a\n\nb<\\|c"), (7, 1, "assistant", "<"), (8, 0, "%0A", "|im_end|>"),
    ]
    assert run(spark, tmp_path, rows) == plain(rows + HOSTILE)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == plain(HOSTILE)
    rows = [(1, 0, "user", "a", "q", 5), (1, 1, "assistant", "b", None, None)]
    assert run(spark, tmp_path / "b", rows, ", record string, turns int") == plain([r[:4] for r in rows] + HOSTILE)


def test_many_turns_take_linear_time(spark, tmp_path):
    spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text <|").alias("text")).write.parquet(str(tmp_path / "conversations.parquet"))
    began = time.perf_counter()
    got = {r.conv_id: r.n_turns for r in C.op12_chat_format(spark, str(tmp_path)).collect()}
    assert got == {1: 60_000, -1: 2} and time.perf_counter() - began < 60


def test_no_python_on_the_main_path(spark):
    plan = C.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql_and_loops(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{os.path.join(sf, 'conversations.parquet')}'")
    rel = duck.execute(C.OP12_SQL)
    names = [c[0] for c in rel.description]
    df = C.op12_chat_format(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows + HOSTILE)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()} == want
    assert len({r.layout for r in df.collect()}) > 1
