"""Audits of corpora and benchmarks, records of runs, and overall scores: known answers and odd input."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import audit as U
from gristmill.operators import genbench as B
from gristmill.operators import records as R


def test_sources_against_expectations(spark):
    rows = [("a", i, f"text {i // 2}".encode(), i % 100 == 0) for i in range(500)] + [(None, 1, None, True), ("b", 1, b"x", False)]
    df = spark.createDataFrame(rows, "source string, k long, content binary, bad boolean")
    expected = spark.createDataFrame([("a", 500), ("c", 4), (None, 2)], "source string, expected long")
    report = lambda deep: {r.source: tuple(r)[1:] for r in U.source_report(df, expected, "k", "source", F.col("content"), F.col("bad"), deep).collect()}
    assert report(False) == {"a": (500, 500, True, 5, 200, 100), None: (1, 2, False, 1, 1, 0), "b": (1, None, False, 0, 1, 1), "c": (0, 4, False, 0, 0, 0)}
    assert report(True)["a"] == (500, 500, True, 5, 500, 250)
    assert U.source_report(df.limit(0), expected.limit(0), "k", "source", F.col("content"), F.col("bad")).collect() == []
    assert [tuple(r) for r in U.repeated_keys(df.filter("source is not null"), "k").collect()] == [(1, 2)]


@pytest.mark.parametrize("answer,good", [("lclick [1,2,3,4]", True), ("lclick [3,2,3,4]", False), ("lclick [1,2,3,1001]", False), ("lclick [1, 2,3,4]", False), ("", False), (None, False), ("x [99999999999,2,3,4]", False)])
def test_boxes_in_order(spark, answer, good):
    assert spark.createDataFrame([(answer,)], "a string").select(U.ordered_box(F.col("a"))).first()[0] is good


def test_benchmarks_against_their_manifest(spark):
    record = lambda f, s, b="x", a="hover", box=(0.0, 0.0, 5.0, 5.0), i="1.png": (f, s, b, a, list(box) if box else None, i)
    records = [
        record("x.jsonl", "s1"), record("x.jsonl", "s2", b="y"), record("x.jsonl", "s2", a=None), record("x.jsonl", "s3", box=(5.0, 0.0, 5.0, 5.0)), record("x.jsonl", "s4", box=None),
        record("x.jsonl", "s5", i="2.png"), record("x.jsonl", "s6", i=None), record("x.jsonl", None), record("y.jsonl", "t1", b="y"), record("stray.jsonl", "s1"),
    ]
    df = spark.createDataFrame(records, "file string, sample_id string, benchmark string, target_action string, target_box array<double>, image string")
    files = spark.createDataFrame([("x.jsonl", b"abc"), ("y.jsonl", b"def")], "path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("x", "x.jsonl", 8, sha(b"abc")), ("y", "y.jsonl", 2, sha(b"altered")), ("z", "z.jsonl", 0, sha(b""))], "benchmark string, path string, rows long, sha256 string")
    images = spark.createDataFrame([("1.png",), ("1.png",)], "path string")
    got = {r.benchmark: tuple(r)[1:] for r in U.benchmark_report(files, manifest, df, images, ("hover", "lclick")).collect()}
    assert got == {"x": (8, True, True, 1, 3, 1, 2, 2), "y": (1, False, False, 0, 0, 0, 0, 0), "z": (0, True, False, 0, 0, 0, 0, 0)}


def test_records_of_runs(spark):
    rows = [(1, "lclick [1, 2, 3, 4]", None, 5), (2, "hover [9, 2, 3, 4]", None, 6), (3, None, None, 7), (4, "hover [1, 2, 3, 4]", "OSError: x", 8)]
    df = spark.createDataFrame(rows, "id int, said string, failed string, steps int")
    got = {r.id: tuple(r)[1:] for r in R.prediction_records(df, ["id"], "said", "failed", ["steps"]).collect()}
    assert got[1] == ("lclick [1, 2, 3, 4]", "lclick", [1, 2, 3, 4], "", None, 5, None)
    assert got[2][1:5] == ("hover", None, "", "degenerate_bbox") and got[3][3:5] == ("", "empty_prediction")
    assert got[4] == ("", None, None, "", "inference_error", None, "OSError: x")


def test_every_tag_counts_alike(spark):
    rows = [("a", 1, True)] * 3 + [("a", 2, False), ("b", 2, True), ("b", 3, False), ("c", 4, None)]
    df = spark.createDataFrame(rows, "tag string, prompt int, correct boolean")
    o = B.overall(df, "tag", "prompt", "correct").first()
    assert (o.images, o.prompts) == (7, 4) and o.image_share == pytest.approx(4 / 7)
    assert o.prompt_share == pytest.approx(0.5) and o.task_mean == pytest.approx((0.75 + 0.5 + 0) / 3)
    assert json.dumps(B.overall(df.limit(0), "tag", "prompt", "correct").first().asDict()) == '{"images": null, "image_share": null, "task_mean": null, "prompts": 0, "prompt_share": null}'
