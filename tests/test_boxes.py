"""Seeded crops against the standard library, and grid joins against all pairs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions import twister
from gristmill.operators.spatial import near_pairs
from gristmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_draws_equal_the_standard_library():
    r = random.Random(2)
    seeds = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, 2**96 + 5] + [r.getrandbits(r.choice([5, 32, 33, 64])) for _ in range(3000)]
    low = np.array([[r.randrange(-1000, 1000) for _ in range(3)] for _ in seeds])
    high = low + np.array([[r.choice([0, 1, 2, 3, 7, 8, 500, 2**31, 2**32 - 2]) for _ in range(3)] for _ in seeds])
    got = twister.bounded(seeds, low, high)
    for s, a, b, g in zip(seeds, low.tolist(), high.tolist(), got.tolist(), strict=True):
        own = random.Random(s)
        assert g == [own.randint(x, y) for x, y in zip(a, b, strict=True)]
    for a, b in ((1, 0), (0, 2**33)):
        with pytest.raises(ValueError):
            twister.bounded([1], np.array([[a]]), np.array([[b]]))
    assert twister.bounded([], np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)).shape == (0, 2)


def test_crops_of_every_event(spark):
    rows = catalogue.queries()["seeded_crops"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    for r in rows:
        x1, y1, x2, y2 = map(float, r.box.split(","))
        seed = int(hashlib.sha256("\x1f".join(("42", str(r.event_id), "crop", "0")).encode()).hexdigest()[:16], 16)
        own, want = random.Random(seed), []
        sizes = [min(s, max(500, int(hi - lo) + 64)) for lo, hi, s in ((x1, x2, 1400), (y1, y2, 1100))]
        for lo, hi, s, n in ((x1, x2, 1400, sizes[0]), (y1, y2, 1100, sizes[1])):
            want.append(own.randint(max(0, int(hi) - n), min(int(lo), s - n)))
        assert r.crop == ",".join(map(str, [*want, want[0] + sizes[0], want[1] + sizes[1]]))


def test_null_boxes_have_no_crop(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0, 5.0, 5.0])], "k int, box array<double>")
    got = {r.k: r.c for r in df.select("k", twister.seeded_crop(F.col("box"), F.lit(10), F.lit(10), 4, F.lit("ff")).alias("c")).collect()}
    assert got[1] is None or got[1][0] is None
    assert got[2] == [0, 0, 10, 10]


def test_the_middle_of_the_possible_starts(spark):
    starts = [spark.range(1).select(G.crop_axis(F.lit(lo), F.lit(hi), F.lit(100), 40)[0].alias("s")).first().s for lo, hi in ((5.0, 10.0), (3.0, 4.0), (60.0, 70.0), (99.0, 100.0), (0.0, 100.0))]
    assert starts == [round((max(0, b - n) + min(a, 100 - n)) / 2) for a, b in ((5, 10), (3, 4), (60, 70), (99, 100), (0, 100)) for n in [min(100, max(40, b - a + 64))]]


@pytest.mark.parametrize("most", [0.01, 0.1, 0.5])
def test_near_pairs_equal_all_pairs(spark, most):
    r = random.Random(7)
    box = lambda: (lambda x, y: [x, y, x + r.choice([0, 1, 40, 700]), y + r.choice([0, 1, 40, 300])])(r.uniform(-20, 1300), r.uniform(-20, 720))
    left = [(r.choice("ab"), i, box(), r.choice([1280, 300]), 720) for i in range(120)] + [("a", 900, None, 1280, 720), (None, 901, [0.0, 0.0, 1.0, 1.0], 5, 5), ("c", 902, [5.0, 5.0, 1.0, 1.0], 5, 5)]
    right = [(r.choice("abd"), i, box()) for i in range(150)] + [("a", 900, None), (None, 901, [0.0, 0.0, 1.0, 1.0])]
    left = [(k, i, b and [float(v) for v in b], w, h) for k, i, b, w, h in left]
    right = [(k, i, b and [float(v) for v in b]) for k, i, b in right]
    pairs = near_pairs(spark.createDataFrame(left, "k string, i int, box array<double>, width int, height int"), spark.createDataFrame(right, "k string, j int, other_box array<double>"), "k", most)
    want = []
    for k, i, a, w, h in left:
        for k2, j, b in right:
            if k is not None and k == k2 and a and b and a[2] >= a[0]:
                dx, dy = max(b[0] - a[2], a[0] - b[2], 0), max(b[1] - a[3], a[1] - b[3], 0)
                if np.hypot(dx, dy) / np.hypot(w, h) <= most:
                    want.append((i, j))
    assert sorted((p.i, p.j) for p in pairs.collect()) == sorted(want) and want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
