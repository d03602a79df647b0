"""Readers, archives, writers, streams with a restart."""

import io
import json
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.operators import packing
from gristmill.operators.packing import Packer, pack_stream
from gristmill.sources import readers, sinks
from gristmill.streaming import packer as stream_packer
from gristmill.streaming import windows


def test_quota_repeats_and_cuts():
    assert readers.with_quota(["a", "b"], 5) == ["a", "b", "a", "b", "a"]
    assert readers.with_quota(["a", "b"], 1) == ["a"] and readers.with_quota(["a", "b"], "None") == ["a", "b"]


def test_parquet_quota(spark, tmp_path):
    spark.range(8).repartition(2).write.parquet(f"{tmp_path}/p")
    assert readers.parquet(spark, [f"{tmp_path}/p"], [4]).count() == 16
    assert readers.parquet(spark, [f"{tmp_path}/p"], [3], ["id"]).count() == 12
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.parquet(spark, [f"{tmp_path}/none"])


def test_strict_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.read("json_lines", spark, f"{tmp_path}/a.jsonl", "a int").collect()] == [1, 2]
    for bad in ("{oops", "[1]"):
        (tmp_path / "b.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="malformed line"):
            readers.strict_json(spark, f"{tmp_path}/b.jsonl", "a int").collect()
    with pytest.raises(KeyError):
        readers.read("nothing", spark)


def test_tar_samples(spark, tmp_path):
    for a in range(2):
        with tarfile.open(tmp_path / f"{a}.tar", "w") as t:
            for stem in range(3):
                for ext, data in (("jpg", b"image"), ("json", json.dumps({"prompt": f"p{stem}"}).encode()), ("txt", b"words" if stem == 0 else b"")):
                    info = tarfile.TarInfo(f"x/{stem}.{ext}")
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
    df = readers.archives(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = df.select("stem", "index", readers.tar_caption().alias("c"), readers.member("members", "png", "jpg").alias("i")).collect()
    assert sorted((r["stem"], r["index"], r["c"], bytes(r["i"])) for r in got)[::2] == [("x/0", 0, "words", b"image"), ("x/1", 1, "p1", b"image"), ("x/2", 2, "p2", b"image")]


def test_zip_lookup(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("a/one.png", "./two.png", "b/three.png", "c/three.png", "d/four.png"):
            z.writestr(n, n)
    m = readers.archives(spark, str(tmp_path), "zip")
    want = spark.createDataFrame([("a/one.png",), ("two.png",), ("three.png",), ("x/four.png",), ("five.png",)], "file string")
    got = {r.file: r.member for r in readers.zip_lookup(m, want, "file").collect()}
    assert got == {"a/one.png": "a/one.png", "two.png": "./two.png", "three.png": None, "x/four.png": "d/four.png", "five.png": None}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, source string, error string")
    sinks.sharded_parquet(df, f"{tmp_path}/p", 1)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.sharded_parquet(df, f"{tmp_path}/p")
    a = sinks.json_lines(df, f"{tmp_path}/j")
    assert a["rows"] == 2 and a == sinks.json_lines(df.orderBy(F.desc("id")), f"{tmp_path}/k")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect())[0] == '{"error":"x","id":2,"source":"b"}'
    with pytest.raises(ValueError):
        sinks.csv(df.limit(0), f"{tmp_path}/c")
    assert sinks.markdown(df.select("id", F.col("id").alias("d")).orderBy("id"), ("d",)).splitlines()[2] == "| 1 | +1.00 |"
    sinks.resume_append(df, f"{tmp_path}/r", "id")
    sinks.resume_append(df.union(spark.createDataFrame([(3, "c", None)], df.schema)), f"{tmp_path}/r", "id")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/r").collect()) == [1, 2, 3]
    assert sinks.content_addressed(df.union(df), "source").count() == 2
    assert sinks.merge_manifest({"sources": {"a": {"rows": 1}, "b": {"rows": 2}}}, {"b": {"rows": 5}})["total_rows"] == 6


def packed_by_batch(spark, rows, limits, mandatory=None):
    schema = "shard long, id long, tokens long, kind string"
    out = packing.pack(spark.createDataFrame(rows, schema), "shard", "id", "id", "tokens", mandatory, **limits)
    return {(r.shard, r.sequence, r.position): r.id for r in out.collect()}


LIMITS = {"expected": 50, "most": 60, "most_per_sample": 55, "buffer_size": 3, "prefer_buffer_before": 20}


def test_stream_packing_survives_restarts_and_ends_whole(spark, tmp_path):
    rows = [(i % 2, i, 5 + (i * 37) % 50, None) for i in range(80)]
    schema = "shard long, id long, tokens long, kind string"
    stream = lambda: stream_packer.pack_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "shard", "id", "tokens", **LIMITS)
    for part in (rows[:33], rows[33:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_packer.run_available(stream(), f"{tmp_path}/check", f"{tmp_path}/out")
    stream_packer.run_available(stream(), f"{tmp_path}/check", f"{tmp_path}/out")
    done = {(r.shard, r.sequence, r.position): r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    places = {r.shard: r for r in stream_packer.places(spark, f"{tmp_path}/check", "shard").collect()}
    assert {s: (p.rows, p.last) for s, p in places.items()} == {0: (40, 78), 1: (40, 79)}
    last = {(r.shard, r.sequence, r.position): r.id for r in stream_packer.leftover(spark, f"{tmp_path}/check", "shard", "id", **LIMITS).collect()}
    assert last and not done.keys() & last.keys() and all(places[s].sequence <= q for s, q, _ in last)
    assert done | last == packed_by_batch(spark, rows, LIMITS) and len(done) > 40
    assert list(pack_stream([], Packer(**LIMITS))) == []


def test_an_idle_stream_emits_its_last_sequences(spark, tmp_path):
    rows = [(i % 2, i, 5 + (i * 37) % 30, "abc"[i % 3] if 0 <= i - 4 < 9 else None) for i in range(40)]
    spark.createDataFrame(rows, "shard long, id long, tokens long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("shard long, id long, tokens long, kind string").parquet(f"{tmp_path}/in")
    limits = LIMITS | {"drop_overflow": False}
    want = packed_by_batch(spark, rows, limits, "kind")
    q = stream_packer.pack_stream(source, "shard", "id", "tokens", "kind", 1, **limits).writeStream.format("memory").queryName("packed").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("packed").count() >= len(want):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.shard, r.sequence, r.position): r.id for r in spark.table("packed").collect()} == want


def test_stream_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, make in (
        ("t", lambda e: windows.tumbling(e, "1 day", ["event_type"], "value")),
        ("s", lambda e: windows.sliding(e, "2 days", "1 day", [], "value")),
        ("e", lambda e: windows.sessions(e, "6 hours", "user_id")),
    ):
        q = make(stream).writeStream.format("memory").queryName(f"w_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {str(r[:-1] if name != "t" else r[:3]) for r in map(tuple, spark.table(f"w_{name}").collect())}
        batch = {str(r[:-1] if name != "t" else r[:3]) for r in map(tuple, make(events).collect())}
        assert got and len(batch - got) <= 0.2 * len(batch) + 12  # windows that the watermark hasn't passed stay open
    q = windows.first_seen(stream, ["user_id"], lateness="1000 days").writeStream.format("memory").queryName("w_d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w_d").count() == events.select("user_id").distinct().count()
