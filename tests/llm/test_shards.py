import duckdb
import pytest

from gristmill.llm import shards
from gristmill.llm.shards import ShardStore, plan_runs


def all_rows(df):
    return sorted(map(str, df.collect()))


def test_append_compact_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = ShardStore(spark, f"file://{tmp_path}/s")
    assert store.manifest() is None
    for part in docs.randomSplit([1.0] * 3, 1):
        store.append(part.repartition(2), shard_rows=15)
    before = store.manifest()
    assert before.version == 3 and len(before.shards) > 12
    size = max(s.n_bytes for s in before.shards)
    after = store.compact(target_bytes=size * 5, fan_in=4)
    assert len(after.shards) < len(before.shards) and after.version > 3
    assert sum(s.n_rows for s in after.shards) == docs.count()
    assert max(s.n_bytes for s in after.shards) <= size * 6
    assert all_rows(store.read()) == all_rows(store.read(3)) == all_rows(docs)
    assert store.read().schema == docs.schema
    store.vacuum()
    assert all_rows(store.read()) == all_rows(docs)
    with pytest.raises(Exception):  # noqa: B017
        store.read(3).count() and store.read(3).collect()


def test_a_version_is_taken_once(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/s")
    m = store.append(spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, path string"))
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(m)
    assert len(all_rows(store.read())) == 3
    empty = ShardStore(spark, f"{tmp_path}/e")
    df = spark.createDataFrame([], "doc_id long, n_rows int")
    empty.append(df)
    empty.compact()
    assert empty.read().count() == 0 and empty.read().schema == df.schema


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    a, b = (ShardStore(spark, f"{tmp_path}/s") for _ in range(2))
    a.append(rows(0), 1)
    plain = ShardStore.manifest
    late = []

    def overtaken(self, version=None):
        found = plain(self, version)
        if self is a and late:
            late.pop()()  # another writer commits between our look and our commit
        return found

    monkeypatch.setattr(ShardStore, "manifest", overtaken)
    late += [lambda: b.append(rows(2)), lambda: b.append(rows(1))]
    assert a.append(rows(3)).version == 4
    assert sorted(r.id for r in a.read().collect()) == [0, 1, 2, 3]
    late.clear()
    monkeypatch.setattr(ShardStore, "_merge", lambda self, runs, merge=ShardStore._merge: (merge(self, runs), b.append(rows(4)))[0])
    m = a.compact(fan_in=4)
    assert sorted(r.id for r in b.read().collect()) == [0, 1, 2, 3, 4] and len(m.shards) == 2
    taken = shards.replaced([["gone", "too"]], [shards.Shard("new", 1, 1)])
    assert a._changed(taken).version == m.version
    monkeypatch.setattr(shards, "ATTEMPTS", 2)
    monkeypatch.setattr(ShardStore, "_commit", lambda self, m, commit=ShardStore._commit: commit(self, shards.Manifest(1, m.schema, m.shards)) if self is a else commit(self, m))
    with pytest.raises(RuntimeError, match="other writers"):
        a.append(rows(7))


def test_runs_join_similar_sizes_up_to_the_target():
    assert plan_runs([10] * 3, 100, 4) == []
    assert plan_runs([10] * 9 + [99], 50, 4) == [[0, 1, 2, 3, 4], [5, 6, 7, 8]]
    assert plan_runs([10, 1000, 10, 1000, 10, 10], 10_000, 4) == [[0, 2, 4, 5]]
    assert plan_runs([], 10, 4) == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, shards.op6_shards(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(shards.OP6_SQL).fetchall())


def test_columns_that_come_and_go(spark, tmp_path):
    store = shards.ShardStore(spark, f"{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a", 1.5), (1, "a", 1.5)], "id long, text string, extra double"), 1)
    store.append(spark.createDataFrame([(2, "x" * 200_000), (3, None)], "id long, text string"), 1)
    want = [(1, "a", 1.5), (1, "a", 1.5), (2, "x" * 200_000, None), (3, None, None)]
    assert sorted((tuple(r) for r in store.read().select("id", "text", "extra").collect()), key=lambda r: r[0]) == want
    store.compact(fan_in=2)
    store.vacuum()
    assert len(store.manifest().shards) < 4
    assert sorted((tuple(r) for r in store.read().select("id", "text", "extra").collect()), key=lambda r: r[0]) == want
    with pytest.raises(ValueError, match="column id"):
        store.append(spark.createDataFrame([("1",)], "id string"))
