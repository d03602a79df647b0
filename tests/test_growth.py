"""Work that must not grow faster than the input, told by plans and by files."""

import glob
import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import spatial
from gristmill.plans import catalogue, io_plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "call", "most"), [("web_actions", "regexp_extract(", 12), ("target_repr_parse", "regexp_replace(", 40), ("grounding_prompt", "regexp_replace(", 40)])
def test_an_expression_stands_once(spark, name, call, most):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(call) <= most


@pytest.mark.parametrize(("sides", "most"), [((60, 30), 0.05), ((900, 500), 0.0005)])
def test_boxes_are_dealt_into_few_cells(spark, monkeypatch, sides, most):
    made, dealt = [], spatial._dealt
    monkeypatch.setattr(spatial, "_dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    x, y = F.col("id") * 37 % 300, F.col("id") * 53 % 200
    box = F.array(*(c.cast("double") for c in (x, y, x + sides[0], y + sides[1])))
    rows = spark.range(200).select(F.lit(1).alias("user"), "id", box.alias("box"))
    pairs = spatial.near_pairs(
        rows.withColumns({"width": F.lit(1280), "height": F.lit(720)}), rows.select("user", F.col("id").alias("other"), F.col("box").alias("other_box")), "user", most
    )
    found = {(r.id, r.other) for r in pairs.select("id", "other").collect()}
    assert [d.count() <= 6 * 200 for d in made] == [True, True]
    b = {r.id: r.box for r in rows.collect()}
    gap = lambda p, q, i: max(q[i] - p[i + 2], p[i] - q[i + 2], 0)
    assert found == {(i, j) for i in b for j in b if math.hypot(gap(b[i], b[j], 0), gap(b[i], b[j], 1)) <= most * math.hypot(1280, 720)}
    assert len(found) == pairs.count()


@pytest.fixture
def made(spark, monkeypatch):
    """Files below each scratch folder that a query makes."""
    folders, scratch = [], io_plans.scratch
    monkeypatch.setattr(io_plans, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])
    return lambda: sorted(p for f in folders for p in glob.glob(f"{f}/**", recursive=True) if p.endswith((".tar", ".zip", ".jsonl")))


@pytest.mark.parametrize("name", ["tar_trip", "zip_trip"])
def test_archives_are_bounded_by_bytes(spark, made, name):
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", *sizes)}
    for k, v in zip(before, ("64", "20000b", "1b"), strict=True):
        spark.conf.set(k, v)
    try:
        catalogue.queries()[name](spark, SF).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made()) >= 8  # 0.3 MB of texts and more


def test_files_of_a_benchmark_are_bounded(spark, made, monkeypatch):
    monkeypatch.setattr(io_plans, "_FILE_IDS", 100, raising=False)
    report = {r.benchmark: r for r in catalogue.queries()["benchmark_audit"](spark, SF).collect()}
    assert max(sum(1 for _ in open(p)) for p in made()) <= 100 < min(r.file_rows for r in report.values())
    assert [b for b, r in report.items() if not r.checksum_equal] == ["click"] and [b for b, r in report.items() if not r.rows_equal] == ["view"]


def test_images_are_made_once_by_one_worker_of_a_task(spark):
    plan = catalogue.queries()["flattened_images"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("see_through(") == 1
