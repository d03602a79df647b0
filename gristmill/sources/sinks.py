"""Writers: sharded Parquet, sorted JSON lines with a digest, CSV, reports, files and archives, resumable appends."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.sources.files import store_of


def sharded_parquet(rows: DataFrame, path: str, shard_rows: int = 1000, by: str | None = "source", force: bool = False) -> None:
    """zstd files of at most shard_rows rows, by source; refuses a path that exists unless forced."""
    writer = rows.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").option("maxRecordsPerFile", shard_rows)
    (writer.partitionBy(by) if by else writer).parquet(path)


def canonical_json(rows: DataFrame) -> Column:
    """A row as JSON with its fields in order of name, nulls kept."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def json_lines(rows: DataFrame, path: str, force: bool = False) -> dict:
    """Canonical lines; returns their number and a digest that doesn't depend on their order."""
    lines = rows.select(canonical_json(rows).alias("value")).persist()
    try:
        lines.write.mode("overwrite" if force else "errorifexists").text(path)
        part = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = lines.agg(F.count("*"), F.sum(part)).first()
    finally:
        lines.unpersist()
    return {"rows": n, "digest": f"{int(total or 0):x}"}


def csv(rows: DataFrame, path: str, force: bool = False) -> None:
    if rows.isEmpty():
        raise ValueError("there are no rows to write")
    rows.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def markdown(rows: DataFrame, signed: tuple[str, ...] = (), most: int = 1000) -> str:
    """A small table as Markdown; signed columns show their sign and two places."""
    shown = rows.select(*(F.format_string("%+.2f", F.col(c).cast("double")).alias(c) if c in signed else F.col(c).cast("string") for c in rows.columns))
    found = shown.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns)]
    return "\n".join(f"| {line} |" for line in [*head, *(" | ".join("" if v is None else v for v in r) for r in found)])


def category_report(rows: DataFrame, title: str, mean: float, notes: dict[str, str] | None = None, most: int = 1000) -> str:
    """A roll-up (l1, l2, mean_score) as text: broad categories, then detailed ones, in order of name, in percent; then notes and the mean."""
    found = rows.filter("l1 IS NOT NULL").select("l1", "l2", "mean_score").orderBy("l1", "l2").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    part = lambda level, rows: [f"{level} category scores:", *(f"\t{name}: {score * 100}" for name, score in rows)]
    broad, detailed = [(r.l1, r.mean_score) for r in found if r.l2 is None], sorted((r.l2, r.mean_score) for r in found if r.l2 is not None)
    return "\n".join([title, *part("L1", broad), *part("L2", detailed), *(f"{k}: {v}" for k, v in (notes or {}).items()), f"Score: {mean * 100}"])


def tag_line(rows: DataFrame, tag: str, share: str, order: str, names: dict[str, str]) -> str:
    """Two lines: short names of the tags and their shares to two places, in order, and the mean of the shares."""
    found = rows.filter(F.col(tag).isin(*names)).select(tag, share).orderBy(order).collect()  # one row for each name
    shares = [r[share] for r in found]
    head, body = [names[r[tag]] for r in found], [f"{s:.2f}" for s in shares]
    return "\n".join(" ".join(f"{c:<4}" for c in line).rstrip() for line in ([*head, "ALL"], [*body, f"{sum(shares) / len(shares):.2f}" if shares else ""]))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the completed ones."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def resume_append(rows: DataFrame, path: str, key: str) -> None:
    """Append what the path doesn't hold yet."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    left = pending(rows, spark.read.schema(rows.schema).json(path), key) if there else rows
    left.write.mode("append").json(path)


def content_addressed(rows: DataFrame, content: str) -> DataFrame:
    """One row for each content, with its digest and the path xx/digest."""
    named = rows.withColumn("sha256", F.sha2(content, 256)).dropDuplicates(["sha256"])
    return named.withColumn("path", F.concat_ws("/", F.substring("sha256", 1, 2), F.col("sha256")))


def write_files(rows: DataFrame, name: str, content: str, base: str) -> None:
    """Every row's content as a file below base, written by executors; one that is there already stays as it is."""

    def put(part):
        store, folder = store_of(base)
        for r in part:
            path = f"{folder}/{r[name]}"
            if store.get_file_info(path).type == fs.FileType.NotFound:
                store.create_dir(os.path.dirname(path), recursive=True)
                aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"  # a lost task leaves no half of a file under the name
                with store.open_output_stream(aside) as out:
                    out.write(bytes(r[content]))
                store.move(aside, path)

    rows.foreachPartition(put)


def write_contents(rows: DataFrame, content: str, path: str) -> None:
    """Every content once, as a file xx/digest below path."""
    write_files(content_addressed(rows, content), "path", content, path)


def write_archives(rows: DataFrame, name: str, content: str, base: str, kind: str = "tar") -> None:
    """Members (name, content) as archives below base, written by executors: one for each partition, in its order.

    An archive gets its name once it is whole; its name is the partition's number, so a task that runs twice leaves one.
    """

    def put(number: int, part):
        store, folder = store_of(base)
        store.create_dir(folder, recursive=True)
        aside, n = f"{folder}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(aside) as out:
            with tarfile.open(fileobj=out, mode="w|") if kind == "tar" else zipfile.ZipFile(out, "w") as archive:
                for r in part:
                    data, n = bytes(r[content]), n + 1
                    if kind == "tar":
                        info = tarfile.TarInfo(r[name])
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
                    else:
                        archive.writestr(r[name], data)
        store.move(aside, f"{folder}/part-{number:05d}.{kind}") if n else store.delete_file(aside)
        return iter(())

    rows.select(name, content).rdd.mapPartitionsWithIndex(put).count()


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows by a column; of partitions that are there only those with new rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_manifest(previous: dict, new: dict) -> dict:
    """Selected sources are replaced, the others stay; totals are counted again."""
    sources = previous.get("sources", {}) | new
    return {"sources": sources, "total_rows": sum(s["rows"] for s in sources.values())}
