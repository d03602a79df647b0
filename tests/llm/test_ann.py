import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = (x * x[i]).sum(axis=1)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[q] = [(v, -n) for n, v in order]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_query_is_exact(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    got, want = grouped(ann.op8_nearest(spark, sf).collect()), brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_blocks_ties_and_scales(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 90)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 9)) * 10.0 ** rng.integers(-3, 4, size=(600, 1))
    x[100:200] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = grouped(ann.nearest(df, F.col("id") % 5 == 0, 7).collect()), brute(list(range(600)), x, range(0, 600, 5), 7)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in want.items()}


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0], "a"), (20, [0.0, 0.0], "a"), (40, None, "a"), (1, [1.0, None], "a"), (2, [float("nan"), 1.0], "a"),
        (3, [float("inf"), 1.0], "a"), (4, [0.5, 0.5], "a"), (4, [0.5, 0.5], "a"), (5, [-1.0, 0.0], "a"), (None, [9.0, 9.0], "a"), (60, [1.0], "a"), (6, [], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = grouped(ann.nearest(df, F.col("id") % 20 == 0, 20).collect())
    assert got == {0: [(4, 0.5), (5, -1.0)]}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    """Scores too are equal to the last bit: both add up the components in order."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    rel = con.execute(ann.OP8_SQL)
    names = [c[0] for c in rel.description]
    got = ann.op8_nearest(spark, f"/root/testdata/{sf}").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
