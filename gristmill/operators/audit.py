"""Checks of prepared corpora and benchmarks against what their manifests promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import geometry as G

#: Rows of a source whose contents are looked at unless a deep check is asked for.
FIRST_CONTENTS = 200
ANSWER_BOX = r"\[(\d+),(\d+),(\d+),(\d+)\]"


def ordered_box(answer: Column, pattern: str = ANSWER_BOX) -> Column:
    """Whether an answer has a box of whole numbers from 0 to 1000 with its ends in order."""
    v = [F.regexp_extract(answer, pattern, i).try_cast("int") for i in range(1, 5)]
    inside = [F.coalesce(x.between(0, 1000), F.lit(False)) for x in v]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (v[2] > v[0]) & (v[3] > v[1]), F.lit(False))


def source_report(rows: DataFrame, expected: DataFrame, key: str, source: str, content: Column, invalid: Column, deep: bool = False) -> DataFrame:
    """source, rows, expected, equal, invalid, checked, contents: a row for each source that the rows or the expectations have.

    expected: source, expected. Of each source the first rows by key are looked at (all of them in a deep check): how many there
    are, and how many different contents they have. A null source is one of its own.
    """
    each = rows.select(F.col(source).alias("_s"), F.col(key).alias("_k"), F.sha2(content, 256).alias("_c"), F.coalesce(invalid, F.lit(False)).alias("_bad"))
    counts = each.groupBy("_s").agg(F.count("*").alias("rows"), F.count_if("_bad").alias("invalid"))
    first = each if deep else each.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_k"))).filter(F.col("_r") <= FIRST_CONTENTS)
    looked = first.groupBy("_s").agg(F.count("*").alias("checked"), F.count_distinct("_c").alias("contents")).withColumnRenamed("_s", "_t")
    wanted = expected.select(F.col(source).alias("_e"), F.col("expected").cast("long").alias("expected"))
    found = counts.join(looked, F.col("_s").eqNullSafe(F.col("_t")), "left").join(wanted, F.col("_s").eqNullSafe(F.col("_e")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        F.coalesce("_s", "_e").alias(source), zero("rows"), "expected", (F.coalesce("rows", F.lit(0)).eqNullSafe(F.col("expected"))).alias("equal"),
        zero("invalid"), zero("checked"), zero("contents"),
    )


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1")


def benchmark_report(files: DataFrame, manifest: DataFrame, records: DataFrame, images: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """benchmark, file_rows, rows_equal, checksum_equal, wrong_benchmark, repeated, bad_actions, bad_boxes, missing_images.

    files: path, content of the benchmarks' files; manifest: benchmark, path, rows, sha256; records: file (the path that a record came
    from), sample_id, benchmark, target_action, target_box, image; images: path of the images that are there. Paths are told from the
    corpus's root. A file that the manifest names and that isn't there has no checksum and no rows.
    """
    digests = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_digest"))
    promised = manifest.select(F.col("benchmark").alias("_b"), F.col("path").alias("_p"), F.col("rows").alias("_rows"), F.col("sha256").alias("_sha"))
    there = images.select(F.col("path").alias("_i")).distinct()
    box = F.col("target_box")
    good = F.coalesce(G.valid_box(box) & F.forall(box, lambda v: (v >= 0) & (v <= 1000)), F.lit(False))
    times = records.groupBy("sample_id").agg(F.count("*").alias("_times"))
    each = records.join(times, "sample_id", "left").join(there, F.col("image") == F.col("_i"), "left").select(
        F.col("file").alias("_p"), F.col("benchmark").alias("_own"), (F.coalesce("_times", F.lit(1)) > 1).alias("_again"), (~good).alias("_box"),
        (~F.coalesce(F.col("target_action").isin(*actions), F.lit(False))).alias("_action"), F.col("_i").isNull().alias("_gone"),
    )
    told = each.join(promised.select("_p", "_b"), "_p").groupBy("_p").agg(
        F.count("*").alias("file_rows"), F.count_if(~F.col("_own").eqNullSafe(F.col("_b"))).alias("wrong_benchmark"), F.count_if("_again").alias("repeated"),
        F.count_if("_action").alias("bad_actions"), F.count_if("_box").alias("bad_boxes"), F.count_if("_gone").alias("missing_images"),
    )
    out = promised.join(digests, "_p", "left").join(told, "_p", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("_b").alias("benchmark"), zero("file_rows"), F.coalesce("file_rows", F.lit(0)).eqNullSafe(F.col("_rows")).alias("rows_equal"),
        F.col("_digest").eqNullSafe(F.col("_sha")).alias("checksum_equal"), *(zero(c) for c in ("wrong_benchmark", "repeated", "bad_actions", "bad_boxes", "missing_images")),
    )
