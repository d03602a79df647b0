"""Sources and writers that know row groups: repeating streams, rows by place, outputs that are whole or absent."""

import json
import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gristmill.sources import committed, files, located, repeating


def make_files(folder, sizes, group=4):
    """Files of so many rows; the value of a row is file * 1000 + row."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for i, n in enumerate(sizes):
        path = f"{folder}/{i}.parquet"
        pq.write_table(pa.table({"v": [i * 1000 + j for j in range(n)], "s": [f"{i}:{j}" for j in range(n)]}), path, row_group_size=group)
        paths.append(path)
    return paths


def test_course_is_cut_anywhere():
    sizes = {"a": [3, 0, 2], "b": [], "c": [1]}
    course = repeating.Course(["a", "b", "c"], 2, "", sizes.__getitem__)
    whole, end = course.advance(course.start(), 10_000)
    rows = [(s.epoch, s.path, s.group, r) for s in whole for r in range(s.first, s.stop)]
    assert rows == [(e, p, g, r) for e in (0, 1) for p, gs in sizes.items() for g, n in enumerate(gs) for r in range(n)]
    for step in (1, 2, 4, 5):
        at, got = course.start(), []
        while True:
            spans, to = course.advance(at, step)
            assert course.advance(at, end=to)[0] == spans
            if not spans:
                break
            got += [(s.epoch, s.path, s.group, r) for s in spans for r in range(s.first, s.stop)]
            at = to
        assert got == rows
    with pytest.raises(ValueError, match="none of the files"):
        repeating.Course(["b"], 0, "", sizes.__getitem__).advance(course.start(), 5)
    orders = {tuple(repeating.epoch_order(list("abcdef"), "7", e)) for e in range(4)}
    assert len(orders) > 1 and all(sorted(o) == list("abcdef") for o in orders)


def run_once(stream, check, out, fail=False):
    def keep(batch, number):
        rows = [r.asDict() for r in batch.collect()]
        if fail:
            raise RuntimeError("killed")
        with open(f"{out}/{number}.json", "w") as f:
            json.dump(rows, f)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "killed" in str(e)


@pytest.mark.parametrize("seed", ["", "5"])
def test_restarts_yield_every_row_once_an_epoch(spark, tmp_path, seed):
    paths = make_files(f"{tmp_path}/in", [9, 1, 6])
    (tmp_path / "out").mkdir()
    stream = lambda: repeating.repeating(spark, paths, rows_per_batch=7, epochs=3, seed=seed)
    for i in range(10):  # 48 rows; every run is a restart, some are killed in a batch
        run_once(stream(), f"{tmp_path}/check", f"{tmp_path}/out", fail=i in (1, 4))
    batches = [json.loads((tmp_path / "out" / f"{n}.json").read_text()) for n in range(len(os.listdir(tmp_path / "out")))]
    assert [len(b) for b in batches] == [7] * 6 + [6]
    rows = [r for b in batches for r in b]
    values = [i * 1000 + j for i, n in enumerate((9, 1, 6)) for j in range(n)]
    for e in range(3):
        assert sorted(r["v"] for r in rows if r["epoch"] == e) == values
    assert all(r["v"] % 1000 == r["row_group"] * 4 + r["row"] and r["file"].endswith(f"/{r['v'] // 1000}.parquet") for r in rows)
    epochs = [max(r["epoch"] for r in b) for b in batches]
    assert epochs == sorted(epochs)


def test_a_broken_file_is_passed_over_or_an_error(spark, tmp_path):
    paths = make_files(f"{tmp_path}/in", [5, 5, 5])
    with open(paths[0], "wb") as f:
        f.write(b"broken")
    (tmp_path / "out").mkdir()
    run_once(repeating.repeating(spark, paths, epochs=1, on_error="skip", columns="v"), f"{tmp_path}/check", f"{tmp_path}/out")
    rows = json.loads((tmp_path / "out" / "0.json").read_text())
    assert sorted(r["v"] for r in rows) == [*range(1000, 1005), *range(2000, 2005)] and set(rows[0]) == {"v", "epoch", "file", "row_group", "row"}
    with pytest.raises(Exception, match="(?i)parquet"):
        repeating.repeating(spark, paths, epochs=1)
    shards = [repeating._Reader({"paths": "\n".join(paths), "shard": i, "shards": 2}, ["v"]).course.paths for i in range(2)]
    assert shards == [[paths[0], paths[2]], [paths[1]]]


def spoil(path, group, column):
    """Overwrite the data of a column in a row group."""
    meta = pq.ParquetFile(path).metadata.row_group(group)
    c = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == column)
    at = c.dictionary_page_offset if c.dictionary_page_offset is not None else c.data_page_offset
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff" * c.total_compressed_size)


def test_conditions_on_the_place_choose_row_groups(spark, tmp_path):
    paths = make_files(f"{tmp_path}/in", [10, 7, 4])
    every = located.groups(spark, paths, ["s"])
    assert every.rdd.getNumPartitions() == 6 and every.count() == 21
    some = every.filter((F.col("path") == paths[0]) & F.col("row_group").isin(0, 2) & (F.col("row") >= 1))
    assert some.rdd.getNumPartitions() == 2
    spoil(paths[0], 1, "s")
    spoil(paths[1], 0, "s")
    assert sorted(r.s for r in some.collect()) == ["0:1", "0:2", "0:3", "0:9"]
    assert every.filter(F.col("path") == "none").collect() == []
    with pytest.raises(Exception):  # noqa: B017
        every.collect()


def test_fetch_reads_the_selected_row_groups_only(spark, tmp_path):
    paths = make_files(f"{tmp_path}/in", [10, 7, 4])
    spoil(paths[0], 1, "s")
    spoil(paths[2], 0, "s")
    narrow = located.with_places(spark.read.parquet(*paths), "v").filter("v in (1, 3, 9, 1005, 1006)")
    got = located.fetch(narrow.union(narrow.filter("v = 9")), ["s"], "s string")
    assert Counter((r.v, r.s) for r in got.collect()) == Counter([(1, "0:1"), (3, "0:3"), (9, "0:9"), (9, "0:9"), (1005, "1:5"), (1006, "1:6")])
    assert got.filter("v > 5000").collect() == [] and located.fetch(narrow.limit(0), ["s"], "s string").collect() == []


def rows_of(spark, n):
    error = F.when(F.col("id") % 10 == 3, F.concat(F.lit("bad "), "id"))
    return spark.range(0, n, 1, 3).select("id", F.concat(F.lit("k"), F.col("id") % 5).alias("kind"), F.lit("é").alias("t"), error.alias("error"))


def test_rows_and_audit_appear_together(spark, tmp_path):
    path = f"{tmp_path}/out"
    committed.write(rows_of(spark, 4000), path, "error", group_rows=256, shard_rows=600, dictionary="kind")
    manifest = json.loads((tmp_path / "out" / committed.MANIFEST).read_text())
    assert manifest["total_rows"] == 3600 and manifest["errors"] == 400
    assert {f"rows/{f}" for f in os.listdir(f"{path}/rows")} == set(manifest["rows"])
    for name, n in manifest["rows"].items():
        meta = pq.ParquetFile(f"{path}/{name}").metadata
        assert meta.num_rows == n <= 600 and all(meta.row_group(g).num_rows <= 256 for g in range(meta.num_row_groups))
        for c in range(meta.num_columns):
            column = meta.row_group(0).column(c)
            assert ("RLE_DICTIONARY" in column.encodings) == (column.path_in_schema == "kind")
    back = spark.read.parquet(f"{path}/rows")
    assert back.columns == ["id", "kind", "t"] and back.agg(F.sum("id")).first()[0] == sum(i for i in range(4000) if i % 10 != 3)
    assert spark.read.json(f"{path}/audit").filter("error = concat('bad ', id) and t = 'é'").count() == 400
    with pytest.raises(Exception, match="(?i)exists"):
        committed.write(rows_of(spark, 10), path, "error")
    assert spark.read.parquet(f"{path}/rows").count() == 3600
    committed.write(rows_of(spark, 10), path, "error", force=True)
    assert spark.read.parquet(f"{path}/rows").count() == 9 and sorted(os.listdir(tmp_path)) == ["out"]


def test_a_failing_audit_or_task_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="400 rows with an error"):
        committed.write(rows_of(spark, 4000), f"{tmp_path}/a", "error", most_errors=399)
    broken = rows_of(spark, 4000).withColumn("t", F.when(F.col("id") == 3999, F.raise_error(F.lit("no"))).otherwise(F.col("t")))
    with pytest.raises(Exception):  # noqa: B017
        committed.write(broken, f"{tmp_path}/b", "error")
    with pytest.raises(Exception, match="no column x"):
        committed.write(rows_of(spark, 4), f"{tmp_path}/c", "error", dictionary="x")
    assert os.listdir(tmp_path) == []
    committed.write(rows_of(spark, 4000), f"{tmp_path}/a", "error", most_errors=400)
    committed.write(rows_of(spark, 0), f"{tmp_path}/d", "error")
    assert spark.read.parquet(f"{tmp_path}/d/rows").schema.simpleString() == "struct<id:bigint,kind:string,t:string>" and sorted(os.listdir(tmp_path)) == ["a", "d"]


def test_uris():
    assert files.store_of("file:///a%20b")[1] == "/a b" and files.store_of("/a%20b")[1] == "/a%20b"
