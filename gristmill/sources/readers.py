"""Readers by name, each a DataFrame over a path; quotas, strict lines, archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gristmill.sources.files import store_of


def with_quota(paths: list[str], n: int | None) -> list[str]:
    """The first n of the files; with more than there are, the list is repeated. No whole number: all."""
    if not isinstance(n, int) or isinstance(n, bool) or not paths:
        return paths
    return (paths * (n // len(paths) + 1))[:n]


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Files below a folder, in order, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name)
    if not out:
        raise FileNotFoundError(f"no {suffix} files below {folder}")
    return sorted(out)


def parquet(spark: SparkSession, folders: list[str], quotas: list[int | None] | None = None, columns: list[str] | None = None) -> DataFrame:
    """All Parquet files below folders, by quota; a file that is named twice is read twice."""
    quotas = quotas or [None] * len(folders)
    times: dict[str, int] = {}
    for folder, n in zip(folders, quotas, strict=True):
        for path in with_quota(list_files(spark, folder, ".parquet"), n):
            times[path] = times.get(path, 0) + 1
    out = None
    for k in sorted(set(times.values())):
        df = spark.read.parquet(*(p for p, n in times.items() if n == k))
        df = df.select(*columns) if columns else df
        if k > 1:
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_copy")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line or one that isn't an object is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    ok = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    checked = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema).alias("row")).select("row.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line") != "")


def images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "webp", "bmp")) -> DataFrame:
    """path and content of files with an image's extension, folders below included."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)).select("path", "content")


def results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON results found by a pattern, with the step that their folder's name ends in."""
    step = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)/[^/]*$", 1).try_cast("long")
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("step", step)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.paths, self.kind = options["paths"].split("\n"), kind

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        path = partition.path
        store, name = store_of(path)
        with store.open_input_file(name) as f:
            if self.kind == "tar":
                yield from self._tar(path, f)
            else:
                with zipfile.ZipFile(io.BufferedReader(f)) as z:
                    for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                        yield path, i, info.filename, z.read(info)

    @staticmethod
    def _tar(path, f):
        """Consecutive members with one stem are a sample."""
        stem, members, index = None, {}, 0
        with tarfile.open(fileobj=f, mode="r|*") as t:
            for m in t:
                if not m.isfile():
                    continue
                folder, _, base = m.name.rpartition("/")
                own, _, ext = base.partition(".")
                own = f"{folder}/{own}" if folder else own
                if stem is not None and own != stem:
                    yield path, index, stem, members
                    index, members = index + 1, {}
                stem = own
                members[ext] = t.extractfile(m).read()
        if stem is not None:
            yield path, index, stem, members


class TarSource(DataSource):
    """Samples of tar archives; option paths: one a line. One partition an archive, members streamed."""

    @classmethod
    def name(cls):
        return "tar_samples"

    def schema(self):
        return "archive string, index int, stem string, members map<string,binary>"

    def reader(self, schema):
        return _ArchiveReader(self.options, "tar")


class ZipSource(DataSource):
    """Members of zip archives; option paths: one a line."""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "archive string, index int, name string, content binary"

    def reader(self, schema):
        return _ArchiveReader(self.options, "zip")


def archives(spark: SparkSession, folder: str, kind: str = "tar") -> DataFrame:
    source = TarSource if kind == "tar" else ZipSource
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", "\n".join(list_files(spark, folder, f".{kind}"))).load()


def member(column: str, *names: str) -> Column:
    """The first filled member of a sample among the names."""
    m = F.col(column)
    filled = lambda n: F.when(F.length(F.try_element_at(m, F.lit(n))) > 0, F.try_element_at(m, F.lit(n)))
    return F.coalesce(*(filled(n) for n in names))


def tar_caption(column: str = "members") -> Column:
    """txt, else the json member's prompt, else its second turn, else prompt.txt."""
    js = member(column, "json").cast("string")
    return F.coalesce(
        member(column, "txt").cast("string"), F.get_json_object(js, "$.prompt"), F.get_json_object(js, "$.conversations[1].value"), member(column, "prompt.txt").cast("string")
    )


def zip_lookup(members: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Members for names: exact, else without a leading ./, else by a base name that is unique; else null."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    m = members.select(F.col("name").alias("_m"))
    exact = wanted.join(m.withColumn("_exact", F.col("_m")).withColumnRenamed("_m", "_k1"), F.col(name) == F.col("_k1"), "left").drop("_k1")
    loose = m.groupBy(bare(F.col("_m")).alias("_k2")).agg(F.min("_m").alias("_loose"))
    exact = exact.join(loose, bare(F.col(name)) == F.col("_k2"), "left").drop("_k2")
    last = m.groupBy(base(F.col("_m")).alias("_k3")).agg(F.count("*").alias("_n"), F.min("_m").alias("_last")).filter("_n = 1").drop("_n")
    exact = exact.join(last, base(F.col(name)) == F.col("_k3"), "left").drop("_k3")
    return exact.withColumn("member", F.coalesce("_exact", "_loose", "_last")).drop("_exact", "_loose", "_last")


#: Readers by name.
REGISTRY: dict[str, Callable] = {
    "parquet": parquet, "json_lines": strict_json, "json_array": json_array, "csv": csv, "text": text_lines,
    "images": images, "archives": archives, "results": results,
}


def read(name: str, spark: SparkSession, *args, **options) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"unknown reader {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name](spark, *args, **options)
