"""Clusters against plain loops over all vectors, and odd input."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

from gristmill.llm import centroids as C


def plain(vectors, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """[(id, cluster, distance)], centroids: Lloyd on every vector."""
    import math

    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cs = [q for _, q in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min((far(q, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        cs = [tuple(sum(col) // len(col) for col in zip(*rows, strict=True)) if (rows := [q for (_, q), o in zip(kept, own, strict=True) if o == n]) else c for n, c in enumerate(cs)]
    return [(i, nearest(q)[1], nearest(q)[0]) for i, q in kept], cs


def frame(spark, rows):
    extra = ", id string, q int, cluster string" if rows and len(rows[0]) > 2 else ""
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + extra)


def compare(spark, vectors, **how):
    got, cs, inertia = C.clustered(frame(spark, vectors), **how)
    want, want_cs = plain([v[:2] for v in vectors], **how)
    assert [tuple(c) for c in cs] == want_cs
    assert Counter(map(tuple, got.collect())) == Counter(want)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    assert inertia == [sums[c] for c in range(len(cs))]


def test_equals_plain_loops_with_copies_ties_and_negative_sums(spark):
    import random

    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(40)]
    vectors = [(i, [x + 1e-7 * (i % 3) for x in base[i % 40 if i % 3 else 7]]) for i in range(300)]
    compare(spark, vectors, dims=4, k=5, rounds=4)


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.5]
    vectors = [(1, v), (1, v), (2, None), (3, [0.1]), (4, [0.1, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (None, [0.25, 0.0]), (7, []), (8, [-0.001, 0.001])]
    compare(spark, vectors, dims=2)
    assert C.clustered(frame(spark, []), dims=2)[0].collect() == []
    assert C.clustered(frame(spark, [(2, None)]), dims=2)[0].collect() == []
    assert C.clustered(frame(spark, [(None, v)]), dims=2)[0].collect() == []


def test_clashing_columns(spark):
    rows = [(1, [0.5, 0.1], "a", 7, "z"), (2, [0.2, 0.1], None, None, None)]
    compare(spark, rows, dims=2, k=2)


def test_wide_components_are_exact(spark):
    compare(spark, [(i, [i * 5e4, -i * 5e4, 1.0]) for i in range(20)], dims=3, k=3, rounds=3)
    got, _, _ = C.clustered(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e299, 5.0])]), dims=2, k=1, rounds=1)
    assert {r.distance for r in got.collect()} == {C.LARGEST_LONG}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql_and_loops(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{os.path.join(sf, 'embeddings.parquet')}'")
    rel = duck.execute(C.oracle_sql())
    names = [c[0] for c in rel.description]
    df = C.op11_centroids(spark, sf)
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(tuple, df.select(*names).collect()))
    assert got == sorted(rel.fetchall())
    want, cs = plain([(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    at = [names.index(n) for n in ("vec_id", "cluster", "distance")]
    assert [tuple(g[i] for i in at) for g in got] == sorted(want)
