"""Running totals, frames, guards and text reports against plain Python."""

import time

import pytest
from pyspark.sql import functions as F

from gristmill.functions import arrays as X
from gristmill.functions import sequences as Q
from gristmill.operators import conversation as C
from gristmill.operators import genbench as B
from gristmill.operators import validation as V
from gristmill.sources import sinks


def test_running_totals(spark):
    rows = [(i, [(7 * j + i) % 11 for j in range(n)]) for i, n in enumerate((0, 1, 127, 128, 129, 1000, 20_000))]
    df = spark.createDataFrame(rows, "i int, v array<long>")
    most = X.running(F.col("v"), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    for r, (_, v) in zip(df.select("i", C.running_offsets(F.col("v")).alias("s"), most.alias("m")).orderBy("i").collect(), rows, strict=True):
        assert r.s == [sum(v[:j]) for j in range(len(v))] if len(v) < 2000 else r.s[-1] == sum(v[:-1])
        assert r.m[:300] == [max(v[:j], default=0) for j in range(min(len(v), 300))]
    began = time.perf_counter()
    n = spark.range(1).select(F.size(C.running_offsets(F.array_repeat(F.lit(3).cast("long"), 500_000))).alias("n")).first().n
    assert n == 500_000 and time.perf_counter() - began < 30


def test_frames(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(Q.started_frames(F.lit(4), F.lit(20), 1)) == [1, 6, 11, 16]
    assert one(Q.started_frames(F.lit(5), F.lit(3), 0)) == [0, 1, 2, 2, 2]
    for frames in (1, 3, 8, 15, 16, 40, 100):
        got = {tuple(one(Q.drawn_frames(F.lit(8), F.lit(frames), seed))) for seed in range(4)}
        edges = [i * frames // min(8, frames) for i in range(min(8, frames) + 1)]
        for g in got:
            assert len(g) == 8 and list(g) == sorted(g) and 0 <= g[0] and g[-1] < frames
            if all(b - 1 > a for a, b in zip(edges, edges[1:], strict=False)):
                assert all(a <= x < b - 1 for x, a, b in zip(g, edges, edges[1:], strict=False))
            else:
                assert len(set(g)) == min(8, frames)
        assert len(got) > 1 or frames in (1, 3, 8, 16)  # these leave no choice


def test_problems(spark):
    boxes = [(None,), ([1.0, 2.0, None, 4.0],), ([1.0, 2.0, 1.0, 4.0],), ([-5.0, 0.0, 0.0, 4.0],), ([99.0, 0.0, 101.0, 4.0],), ([100.0, 0.0, 101.0, 4.0],), ([1.0],)]
    got = [r.w for r in spark.createDataFrame(boxes, "b array<double>").select(V.box_problem(F.col("b"), F.lit(100), F.lit(50)).alias("w")).collect()]
    assert got == ["missing_box", "missing_box", "zero_size", "off_screen", None, "off_screen", "missing_box"]
    rows = [(b"x", "hover [1,2,3,4]", "s"), (b"", "hover [1,2,3,4]", "s"), (None, "", ""), (b"x", "hover", "s"), (b"x", None, "s"), (b"x", "hover [1,2,3,4]", " ")]
    df = spark.createDataFrame(rows, "c binary, a string, s string")
    assert [r.w for r in df.select(V.record_problem(F.col("c"), F.col("a"), {"s": F.col("s")}).alias("w")).collect()] == [None, "empty_content", "empty_content", "invalid_answer", "invalid_answer", "missing:s"]
    assert V.special_tokens({"a": 0, "b": 4}, ["b", "x", "y", "x"]) == ({"b": 4, "x": 5, "y": 6}, 2) and V.special_tokens({}, ["x"]) == ({"x": 0}, 1)


def test_text_reports(spark):
    rows = spark.createDataFrame([("b - x (1)", 1.0), ("b - y (2)", 0.0), ("a - z (1)", 0.5)], "label string, yes double")
    text = sinks.category_report(B.category_rollup(rows, "label", "yes"), "Model: m", 0.25, {"Images": "here"})
    assert text == "Model: m\nL1 category scores:\n\ta: 50.0\n\tb: 50.0\nL2 category scores:\n\ta - z: 50.0\n\tb - x: 100.0\n\tb - y: 0.0\nImages: here\nScore: 25.0"
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.category_report(B.category_rollup(rows, "label", "yes"), "m", 0.0, most=1)
    tags = spark.createDataFrame([("two", 0.5, 2), ("one", 1.0, 1), ("other", 0.0, 0)], "tag string, share double, first int")
    assert sinks.tag_line(tags, "tag", "share", "first", {"one": "SO", "two": "TO"}) == "SO   TO   ALL\n1.00 0.50 0.75"
