"""A table as immutable shards under versioned manifests, compacted by size tiers.

Arrivals are appended as small Parquet shards. A manifest names the shards of one version; a new one is written
aside and renamed to its number, which fails if another writer took the number; the loser makes its change anew on
the version that won. So versions are atomic and a reader always sees one whole version, where renaming is one step and
refuses a name that exists: HDFS and local folders do, most object stores don't and need one writer at a time. Compaction merges runs of shards of similar size (a tier is a power of the
fan-in) into files of the target size, one task a run, streaming row groups from file to file without a shuffle.
A task writes under a name of its own; what a lost task leaves is in no manifest and goes with vacuum(), which must
not run while another writer has files that it has not committed yet.

Defined results for odd input: rows come back as they went in, nulls, repeated rows and extra columns included;
an empty table makes no shard and a version without any; the manifest keeps the schema, the columns of all that was
appended: a shard that lacks one reads as nulls there, and a column that comes with another type is refused. Long texts
make larger files, not more memory than a row group; rows of one key stay as many as they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gristmill.llm._shared import fresh_path, hadoop, store_of, table

TARGET_BYTES, FAN_IN, ARRIVAL_ROWS, ROW_GROUP_BYTES = 128 << 20, 4, 2_000, 32 << 20
#: Versions that other writers may take before one of ours gives up.
ATTEMPTS = 20
COLUMNS = "run int, path string, n_rows long, n_bytes long"


@dataclass
class Shard:
    path: str
    n_rows: int
    n_bytes: int


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The columns of both, by name, all nullable; ValueError if a column has two types."""
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        if kinds.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


@dataclass
class Manifest:
    version: int
    schema: str
    shards: list[Shard]


class ShardStore:
    """A folder with shards/ and manifests/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, _ = hadoop(spark, self.root)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version, by default the latest; None if there is none."""
        if version is None:
            folder = self._path("manifests")
            if not self.fs.exists(folder):
                return None
            names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
            found = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
            if not found:
                return None
            version = max(found)
        stream = self.fs.open(self._path(f"manifests/v{version:012d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        x = json.loads(text)
        return Manifest(x["version"], x["schema"], [Shard(**s) for s in x["shards"]])

    def _commit(self, m: Manifest) -> Manifest:
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # refuses a name that exists
        context.rename(aside, self._path(f"manifests/v{m.version:012d}.json"), options)
        return m

    def _changed(self, change) -> Manifest:
        """Commit change(latest manifest or None) as the next version; made anew if another writer takes the number first.

        A change that gives None is given up, and the latest manifest stands.
        """
        for _ in range(ATTEMPTS):
            last = self.manifest()
            new = change(last)
            if new is None:
                return last
            try:
                return self._commit(new)
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
        raise RuntimeError(f"other writers took {ATTEMPTS} versions in a row")

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> Manifest:
        """Rows become new shards of at most shard_rows rows; earlier shards, and those of writers at the same time, stay as they are."""

        def schema_with(last: Manifest | None) -> StructType:
            return merged_schema(StructType.fromJson(json.loads(last.schema)) if last else StructType(), rows.schema)

        schema_with(self.manifest())  # a type that doesn't fit is refused before anything is written
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
        counts = {
            r["name"]: r["n"]
            for r in self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        }  # one row a file
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder))}
        new = [Shard(f"{folder}/{name}", n, sizes[name]) for name, n in sorted(counts.items())]
        return self._changed(lambda last: Manifest(last.version + 1 if last else 1, schema_with(last).json(), (last.shards if last else []) + new))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema))
        reader = self.spark.read.schema(schema)
        return reader.parquet(*(s.path for s in m.shards)) if m.shards else self.spark.createDataFrame([], schema)

    def compact(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> Manifest:
        """Merge runs until no tier below the target holds fan_in shards; one version for each round."""
        m = self.manifest()
        while runs := plan_runs([s.n_bytes for s in m.shards], target_bytes, fan_in):
            merged = [[m.shards[i].path for i in run] for run in runs]
            m = self._changed(replaced(merged, self._merge(merged)))
        return m

    def _merge(self, runs: list[list[str]]) -> list[Shard]:
        root = f"{self.root}/shards"

        def merge(batches):
            for b in batches:
                for run, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    name = f"{root}/merged-{uuid.uuid4().hex}.parquet"
                    n_rows, n_bytes = merge_files(paths, name)
                    yield pa.RecordBatch.from_pylist([{"run": run, "path": name, "n_rows": n_rows, "n_bytes": n_bytes}], MERGED)

        rows = self.spark.createDataFrame(list(enumerate(runs)), "run int, paths array<string>").repartitionByRange(len(runs), "run")
        return [Shard(r["path"], r["n_rows"], r["n_bytes"]) for r in sorted(rows.mapInArrow(merge, COLUMNS).collect(), key=lambda r: r["run"])]

    def vacuum(self) -> None:
        """Delete shard files that the latest manifest doesn't name; older versions can't be read afterwards."""
        named = {hadoop(self.spark, s.path)[1].toUri().getPath() for s in self.manifest().shards}
        files = self.fs.listFiles(self._path("shards"), True)
        paths = []
        while files.hasNext():
            paths.append(files.next().getPath())
        for p in paths:
            if p.toUri().getPath() not in named:
                self.fs.delete(p, False)


def replaced(runs: list[list[str]], made: list[Shard]):
    """A change that puts merged shards in the place of their runs; given up where another writer replaced a part of these already."""
    first = {run[0]: shard for run, shard in zip(runs, made, strict=True)}
    gone = {path for run in runs for path in run}

    def change(last: Manifest) -> Manifest | None:
        if not gone <= {s.path for s in last.shards}:
            return None
        shards = [first.get(s.path, s) for s in last.shards if s.path in first or s.path not in gone]
        return Manifest(last.version + 1, last.schema, shards)

    return change


MERGED = pa.schema([("run", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64())])


def plan_runs(sizes: list[int], target: int, fan_in: int) -> list[list[int]]:
    """Runs of places, in arrival order, of shards of one tier, each up to the target in sum."""
    tiers: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        if n < target * 0.75:
            tier = 0
            while n >= fan_in ** (tier + 1):
                tier += 1
            tiers.setdefault(tier, []).append(i)
    runs = []
    for _, places in sorted(tiers.items()):
        if len(places) < fan_in:
            continue
        run: list[int] = []
        total = 0
        for i in places:
            if run and total + sizes[i] > target:
                runs.append(run)
                run, total = [], 0
            run.append(i)
            total += sizes[i]
        runs.append(run)
    return [r for r in runs if len(r) > 1]


def merge_files(paths: list[str], name: str) -> tuple[int, int]:
    """Append the rows of Parquet files to a new one, a row group in memory at a time; columns that a file lacks are null."""
    schemas = []
    for p in paths:
        source, path = store_of(p)
        with source.open_input_file(path) as f:
            schemas.append(pq.read_schema(f).remove_metadata())
    schema = pa.unify_schemas(schemas)
    held, size, n_rows = [], 0, 0
    fs, out = store_of(name)
    with pq.ParquetWriter(out, schema, filesystem=fs, compression="zstd") as writer:
        for p in paths:
            source, path = store_of(p)
            with source.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1024):
                    there = batch.schema.names
                    columns = [batch.column(c.name) if c.name in there else pa.nulls(batch.num_rows, c.type) for c in schema]
                    held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
                    size += batch.nbytes
                    n_rows += batch.num_rows
                    if size >= ROW_GROUP_BYTES:
                        writer.write_table(pa.Table.from_batches(held, schema), row_group_size=n_rows)
                        held, size = [], 0
        if held:
            writer.write_table(pa.Table.from_batches(held, schema), row_group_size=n_rows)
    return n_rows, fs.get_file_info(out).size


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its arrival as small shards and their compaction, read by the last manifest."""
    store = ShardStore(spark, fresh_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
