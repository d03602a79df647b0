"""Round trips: tables written in every format to the shared folder and read back, with the tables as SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import actions as A
from gristmill.functions import raster
from gristmill.operators import audit as U
from gristmill.operators import records as R
from gristmill.plans.synth import scored_rows, table
from gristmill.sources import committed, located, readers, repeating, sinks
from gristmill.streaming import packer


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gristmill-io-")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _folder(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the gateway is gone at exit
        return


def parquet_shards(spark, d) -> DataFrame:
    """Sharded files by source, read with a column projection."""
    path = scratch(spark, "parquet")
    sinks.sharded_parquet(table(spark, d, "documents"), path, 100, "lang")
    return readers.read("parquet", spark, [path], None, ["doc_id", "source", "n_chars"])


def parquet_quota(spark, d) -> DataFrame:
    """Twice as many files as there are: every row twice."""
    path = scratch(spark, "quota")
    table(spark, d, "nation").repartition(3, "n_nationkey").write.parquet(path)
    n = len(readers.list_files(spark, path, ".parquet"))
    return readers.parquet(spark, [path], [2 * n], ["n_nationkey"]).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def json_lines_trip(spark, d) -> DataFrame:
    path, rows = scratch(spark, "lines"), table(spark, d, "conversations")
    sinks.json_lines(rows, path)
    return readers.read("json_lines", spark, path, rows.schema).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def json_array_trip(spark, d) -> DataFrame:
    """Files of one JSON array each."""
    path, rows = scratch(spark, "array"), table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lines = F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("o_orderkey", "o_orderpriority")))), ",\n")
    arrays = rows.groupBy((F.col("o_orderkey") % 50).alias("file")).agg(F.encode(F.concat(F.lit("["), lines, F.lit("]")), "UTF-8").alias("content"))
    sinks.write_files(arrays.withColumn("name", F.concat("file", F.lit(".json"))), "name", "content", path)
    return readers.read("json_array", spark, path, "o_orderkey long, o_orderpriority string")


def csv_trip(spark, d) -> DataFrame:
    """Names with commas, quotes and line breaks survive."""
    path = scratch(spark, "csv")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit('a "'), "p_name", F.lit('",\nb')).alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read("csv", spark, path, "p_partkey long, name string")


def csv_report(spark, d) -> DataFrame:
    path = scratch(spark, "report")
    sinks.csv(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return readers.read("csv", spark, path, "o_orderpriority string, n long")


def text_lines_trip(spark, d) -> DataFrame:
    path = scratch(spark, "text")
    table(spark, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" \n\n"))).write.text(path)
    return readers.read("text", spark, path).select("line")


def tar_trip(spark, d) -> DataFrame:
    """Archives with samples of up to three members, of which the caption is the first that is filled; samples without an image go.

    Documents are dealt into archives by bytes (the advisory size of a partition): more of them make more archives, not larger ones.
    """
    path, docs = scratch(spark, "tar"), table(spark, d, "documents").hint("rebalance", "doc_id")
    k, filled = F.col("doc_id"), F.lit("").cast("binary")
    members = {
        "jpg": F.when(k % 5 != 0, F.encode(F.lit("image"), "UTF-8")),
        "txt": F.when(k % 3 != 0, F.encode("text", "UTF-8")).otherwise(filled),
        "json": F.encode(F.to_json(F.struct(F.concat_ws(" ", "lang", "source").alias("prompt"))), "UTF-8"),
    }
    parts = F.array(*(F.struct(F.concat(k.cast("string"), F.lit(f".{ext}")).alias("name"), c.alias("content")) for ext, c in members.items()))
    sinks.write_archives(docs.select(F.inline(parts)).filter("content IS NOT NULL"), "name", "content", path)
    s = readers.read("archives", spark, path)
    return s.filter(readers.member("members", "jpg", "png").isNotNull()).select(F.col("stem").cast("long").alias("doc_id"), F.md5(readers.tar_caption()).alias("caption"))


def zip_trip(spark, d) -> DataFrame:
    """Members of zip archives, dealt as in tar_trip and found by name, without a leading ./, and by a base name that is unique."""
    path, docs = scratch(spark, "zip"), table(spark, d, "documents").hint("rebalance", "doc_id")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "sub/").otherwise("./"), "doc_id", F.lit(".txt"))
    sinks.write_archives(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), "name", "content", path, "zip")
    members = readers.archives(spark, path, "zip")
    wanted = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("wanted"))
    found = readers.zip_lookup(members, wanted, "wanted")
    content = members.select(F.col("name").alias("member"), F.md5("content").alias("digest"))
    return found.join(content, "member", "left").select("doc_id", "digest")


def image_folder(spark, d) -> DataFrame:
    """Files with an image's extension and a number, by prompt; others are left out. The digest is that of the bytes."""
    path, k = scratch(spark, "images"), F.col("s_suppkey")
    name = F.format_string("%05d/samples/%05d.%s", k % 7, k, F.when(k % 4 == 0, "txt").otherwise("png"))
    sinks.write_files(table(spark, d, "supplier").select(name.alias("name"), F.encode("s_name", "UTF-8").alias("content")), "name", "content", path)
    files = readers.read("images", spark, path)
    return files.select(R.numbered_image(F.col("path")).alias("at"), F.sha2("content", 256).alias("digest")).select("at.prompt", "at.image", "digest")


def results_trip(spark, d) -> DataFrame:
    """Results of many steps, found by a pattern; the step is the number of the folder."""
    path = scratch(spark, "results")
    rows = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("step")).agg(F.count("*").alias("score"))
    named = rows.select(F.concat(F.lit("run-"), "step", F.lit("/result.json")).alias("name"), F.encode(F.to_json(F.struct("score")), "UTF-8").alias("content"))
    sinks.write_files(named, "name", "content", path)
    return readers.read("results", spark, f"{path}/*/result.json", "score long").select("step", "score")


def prediction_shards(spark, d) -> DataFrame:
    """Predictions in shards, loaded as one table with different keys; rows that are done are not written again."""
    path = scratch(spark, "predictions")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sinks.resume_append(rows.filter("o_orderkey % 2 = 0"), path, "o_orderkey")
    sinks.resume_append(rows, path, "o_orderkey")
    return R.loaded(spark, path, rows.schema, "o_orderkey")


def audited_rows(spark, d) -> DataFrame:
    """Rows without an error, and the audit of the others; both were committed at once."""
    path = scratch(spark, "audit")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "too dear").otherwise(F.lit(None).cast("string")).alias("error"))
    committed.write(rows, path, "error", shard_rows=5000)
    good = spark.read.parquet(f"{path}/rows").select("o_orderkey", F.lit(None).cast("string").alias("error"))
    return good.unionByName(spark.read.schema("o_orderkey long, error string").json(f"{path}/audit"))


def _in_groups(spark, d, *columns: str) -> str:
    """Documents as shards of row groups of 256 rows at most."""
    path = scratch(spark, "groups")
    committed.write(table(spark, d, "documents").select(*columns), path, dictionary="lang", shard_rows=2000)
    return f"{path}/rows"


def late_rows(spark, d) -> DataFrame:
    """The longest document of every source and language: chosen by narrow columns, its text read by its place."""
    path = _in_groups(spark, d, "doc_id", "text", "lang", "source", "n_chars")
    narrow = located.with_places(spark.read.parquet(path), "doc_id", "source", "lang", "n_chars")
    first = W.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    chosen = narrow.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")
    return located.fetch(chosen, ["text"], "text string").select("source", "lang", "doc_id", F.md5("text").alias("digest"))


def group_rows(spark, d) -> DataFrame:
    """Rows by their place: those of the first row group of each shard, by conditions that the source takes; all are in the table."""
    path = _in_groups(spark, d, "doc_id", "lang")
    rows = located.groups(spark, readers.list_files(spark, path, ".parquet"), ["doc_id"]).filter("row_group = 0 and row < 256")
    whole = located.groups(spark, readers.list_files(spark, path, ".parquet"), ["doc_id"])
    n = rows.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    return whole.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs")).crossJoin(n).select("rows", "docs", (F.col("most") <= 256).alias("bounded"))


def repeated_epochs(spark, d) -> DataFrame:
    """Three epochs of the documents as a stream in batches, each row with its place: every one thrice, once an epoch."""
    path = _in_groups(spark, d, "doc_id", "lang", "n_chars")
    stream = repeating.repeating(spark, readers.list_files(spark, path, ".parquet"), epochs=3, seed="1", rows_per_batch=100_000)
    out = scratch(spark, "epochs")
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return rows.groupBy("doc_id").agg(F.count("*").alias("times"), F.countDistinct("epoch").alias("epochs"), F.sum("n_chars").alias("n_chars"))


def content_store(spark, d) -> DataFrame:
    """Every content once, under its digest."""
    path = scratch(spark, "content")
    sinks.write_contents(table(spark, d, "part").select(F.encode("p_type", "UTF-8").alias("content")), "content", path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("digest"), F.col("content").cast("string").alias("p_type"))


def changed_partitions(spark, d) -> DataFrame:
    """Only the partitions that are written again change."""
    path, o = scratch(spark, "partitions"), table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    sinks.replace_partitions(o, path, "o_orderpriority")
    sinks.replace_partitions(o.filter("o_orderpriority like '1%' and o_orderkey % 2 = 0"), path, "o_orderpriority")
    return spark.read.schema(o.schema).parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def packed_stream(spark, d) -> DataFrame:
    """Documents packed as a stream that ends, by language: how often each is in a sequence, and whether that holds 9,000 tokens at most."""
    path, limits = scratch(spark, "packed"), {"expected": 8000, "most": 9000, "most_per_sample": 5000, "buffer_size": 20, "prefer_buffer_before": 4000, "drop_overflow": False}
    docs = table(spark, d, "documents").select("lang", "doc_id", F.least("n_chars", F.lit(4000)).alias("tokens"))
    docs.write.parquet(f"{path}/in")
    stream = packer.pack_stream(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), "lang", "doc_id", "tokens", **limits)
    packer.run_available(stream, f"{path}/check", f"{path}/out")
    done = spark.read.schema(stream.schema).parquet(f"{path}/out").unionByName(packer.leftover(spark, f"{path}/check", "lang", "doc_id", **limits))
    total = done.groupBy("lang", "sequence").agg(F.sum("tokens").alias("total"))
    return done.join(total, ["lang", "sequence"]).groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.col("total") <= 9000).alias("fits"))


def _graymap(vector) -> Column:
    """Eight by eight samples of a vector of 64, as a graymap."""
    value = lambda x: F.greatest(F.least(F.floor((x.cast("double") + 1) * 127.5), F.lit(255)), F.lit(0))
    digits = F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(value(x)), 2, "0")), "")
    return F.concat(F.encode(F.lit("P5 8 8 255\n"), "UTF-8"), F.unhex(digits))


def image_grids(spark, d) -> DataFrame:
    """Of every label's vectors, drawn as images, the first four in a grid."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", _graymap("embedding").alias("image"))
    out = raster.grids(rows, "label", "vec_id", "image", 8)
    pixels = raster.samples("grid")
    return out.select("label", pixels.alias("p")).select("label", F.md5(F.array_join("p", ",")).alias("digest"))


def flattened_images(spark, d) -> DataFrame:
    """Every vector as sixteen pixels of colour and see-through, on white."""
    rows = table(spark, d, "embeddings").select("vec_id", _graymap("embedding").alias("image"))
    flat = raster.stepped(raster.see_through(F.col("image")), [("flatten", {})])
    pixels = rows.select("vec_id", raster.signed_samples(flat).alias("p")).filter("p IS NOT NULL")
    return pixels.select("vec_id", F.md5(F.array_join("p", ",")).alias("digest"))


#: Numbers of events that share a file of a benchmark.
_FILE_IDS = 100_000


def benchmark_audit(spark, d) -> DataFrame:
    """Benchmarks of events, written by executors and checked: one's files are altered, some images are missing.

    A benchmark is a file and a manifest's line for each ``_FILE_IDS`` numbers of events, so no file grows with the table.
    """
    path, k = scratch(spark, "benchmark"), F.col("event_id")
    t = scored_rows(spark, d).select(
        F.concat(F.lit("s"), F.when(k % 97 == 0, k - k % 970).otherwise(k)).alias("sample_id"), F.when(k % 51 == 0, "other").otherwise(F.col("event_type")).alias("benchmark"),
        F.when(k % 41 == 0, "drag").otherwise(F.col("target_action")).alias("target_action"), F.col("target_box"), F.concat(F.lit("images/"), k % 20, F.lit(".png")).alias("image"), F.col("event_type").alias("own"),
        F.floor(k / _FILE_IDS).alias("block"),
    )
    lines = t.groupBy("own", "block").agg(F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("sample_id", "benchmark", "target_action", "target_box", "image")))), "\n").alias("text"), F.count("*").alias("rows"))
    name = F.concat("own", F.lit("/"), "block", F.lit(".jsonl"))
    named = lines.select(name.alias("path"), F.encode("text", "UTF-8").alias("content"), "own", "rows").persist()
    sinks.write_files(named, "path", "content", path)
    sinks.write_files(t.select("image").distinct().filter("image <> 'images/7.png'").select("image", F.lit("x").cast("binary").alias("content")), "image", "content", path)
    own = F.when(F.col("own") == "click", F.lit("0")).otherwise(F.sha2("content", 256))
    manifest = named.select(F.col("own").alias("benchmark"), "path", (F.col("rows") + F.when(F.col("own") == "view", 1).otherwise(0)).alias("rows"), own.alias("sha256"))
    below = lambda c: F.regexp_extract(c, "/benchmark-[0-9a-f]+/(.*)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(path).select(below(F.col("path")).alias("path"), "content")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path).select(below(F.col("path")).alias("path"))
    schema = "sample_id string, benchmark string, target_action string, target_box array<double>, image string"
    records = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(path).select("*", below(F.col("_metadata.file_path")).alias("file"))
    each = U.benchmark_report(files, manifest, records, images, A.ACTIONS)
    all_of, sum_of = ("rows_equal", "checksum_equal"), ("wrong_benchmark", "repeated", "bad_actions", "bad_boxes", "missing_images")
    return each.groupBy("benchmark").agg(F.sum("file_rows").alias("file_rows"), *(F.bool_and(c).alias(c) for c in all_of), *(F.sum(c).alias(c) for c in sum_of))


QUERIES = {f.__name__: f for f in (
    benchmark_audit, image_grids, flattened_images, packed_stream, parquet_shards, parquet_quota, json_lines_trip, json_array_trip, csv_trip, csv_report, text_lines_trip, tar_trip, zip_trip, image_folder, results_trip,
    prediction_shards, audited_rows, late_rows, group_rows, repeated_epochs, content_store, changed_partitions,
)}

_BYTES = "list_transform(embedding, lambda x: greatest(least(floor((x::DOUBLE + 1) * 127.5::DOUBLE), 255), 0)::INT)"
ORACLE = {
    "benchmark_audit": f"""WITH e AS (SELECT event_type AS own, event_id AS k, CASE WHEN event_id % 97 = 0 THEN event_id - event_id % 970 ELSE event_id END AS s FROM events),
      t AS (SELECT *, count(*) OVER (PARTITION BY s) > 1 AS again FROM e)
      SELECT own AS benchmark, count(*) AS file_rows, own <> 'view' AS rows_equal, own <> 'click' AS checksum_equal, count(*) FILTER (k % 51 = 0) AS wrong_benchmark, count(*) FILTER (again) AS repeated,
        count(*) FILTER (k % 41 = 0) AS bad_actions, 0::BIGINT AS bad_boxes, count(*) FILTER (k % 20 = 7) AS missing_images FROM t GROUP BY own""",
    "image_grids": f"""WITH r AS (SELECT label, {_BYTES} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
      g AS (SELECT label, list(v ORDER BY r) AS t FROM r WHERE r <= 4 GROUP BY 1)
      SELECT label, md5(CASE WHEN len(t) = 1 THEN '8,8,3,' || array_to_string(list_transform(range(192), lambda i: t[1][i // 3 + 1]), ',')
        ELSE '16,16,3,' || array_to_string(list_transform(range(768), lambda i: coalesce(t[(i // 384) * 2 + (i // 24) % 2 + 1][((i // 48) % 8) * 8 + (i // 3) % 8 + 1], 255)), ',') END) AS digest FROM g""",
    "flattened_images": f"""WITH v AS (SELECT vec_id, {_BYTES} AS v FROM embeddings),
      t AS (SELECT vec_id, list_transform(range(48), lambda i: v[(i // 3) * 4 + i % 3 + 1] * v[(i // 3) * 4 + 4] + 255 * (255 - v[(i // 3) * 4 + 4]) + 128) AS t FROM v)
      SELECT vec_id, md5('4,4,3,' || array_to_string(list_transform(t, lambda x: ((x >> 8) + x) >> 8), ',')) AS digest FROM t""",
    "packed_stream": "SELECT doc_id, 1::BIGINT AS times, true AS fits FROM documents",
    "parquet_shards": "SELECT doc_id, source, n_chars FROM documents",
    "parquet_quota": "SELECT n_nationkey, 2::BIGINT AS n FROM nation",
    "json_lines_trip": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations",
    "json_array_trip": "SELECT o_orderkey, o_orderpriority FROM orders",
    "csv_trip": """SELECT p_partkey, 'a "' || p_name || '",' || chr(10) || 'b' AS name FROM part""",
    "csv_report": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "text_lines_trip": "SELECT trim(n_name) AS line FROM nation",
    "tar_trip": "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 OR coalesce(text, '') = '' THEN concat_ws(' ', lang, source) ELSE text END) AS caption FROM documents WHERE doc_id % 5 <> 0",
    "zip_trip": "SELECT doc_id, md5(text) AS digest FROM documents",
    "image_folder": "SELECT (s_suppkey % 7)::BIGINT AS prompt, s_suppkey AS image, sha256(s_name) AS digest FROM supplier WHERE s_suppkey % 4 <> 0",
    "results_trip": "SELECT (o_orderkey // 1000)::BIGINT AS step, count(*) AS score FROM orders GROUP BY 1",
    "prediction_shards": "SELECT o_orderkey, o_totalprice FROM orders",
    "audited_rows": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'too dear' END AS error FROM orders",
    "late_rows": "SELECT source, lang, doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1",
    "group_rows": "SELECT count(*) AS rows, count(DISTINCT doc_id) AS docs, true AS bounded FROM documents",
    "repeated_epochs": "SELECT doc_id, 3::BIGINT AS times, 3::BIGINT AS epochs, (3 * n_chars)::BIGINT AS n_chars FROM documents",
    "content_store": "SELECT DISTINCT sha256(p_type) AS digest, p_type FROM part",
    "changed_partitions": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%' OR o_orderkey % 2 = 0 GROUP BY 1",
}
