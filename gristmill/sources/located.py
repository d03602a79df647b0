"""Rows by their place: heavy columns are read only from the row groups of the rows that were selected.

Two ways, for few places and for many. ``parquet_groups`` is a source with one partition for each row group; conditions on path,
row_group and row are pushed into it, so other groups are not opened. ``fetch`` takes places as a table: selections of
any size are grouped by row group on the cluster, and each group is read once, by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gristmill.sources import files

PLACE = StructType([StructField("path", StringType()), StructField("row_group", IntegerType()), StructField("row", LongType())])
#: What a condition means for a value.
TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}


@dataclass
class Group(InputPartition):
    path: str
    group: int


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns
        self.tests: dict[str, list[tuple[type, object]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on the place stay here; all others go back to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PLACE.fieldNames():
                self.tests.setdefault(f.attribute[0], []).append((type(f), frozenset(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _fits(self, name: str, value) -> bool:
        return all(TESTS[kind](value, x) for kind, x in self.tests.get(name, []))

    def partitions(self) -> list[Group]:
        paths = [p for p in self.paths if self._fits("path", p)]
        return [Group(p, g) for p in paths for g in range(len(files.group_rows(p))) if self._fits("row_group", g)]

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Group):
            return
        t = files.read_group(partition.path, partition.group, self.columns)
        rows = [r for r in range(t.num_rows) if self._fits("row", r)]
        if not rows:
            return
        t = t.select(self.columns).take(pa.array(rows, pa.int64()))
        place = {"path": pa.array([partition.path] * len(rows)), "row_group": pa.array([partition.group] * len(rows), pa.int32()), "row": pa.array(rows, pa.int64())}
        yield from pa.table(place | dict(zip(self.columns, t.columns, strict=True))).to_batches(max_chunksize=1024)


class ParquetGroups(DataSource):
    """Options: paths (one a line), columns (comma-separated; all)."""

    @classmethod
    def name(cls) -> str:
        return "parquet_groups"

    def schema(self) -> StructType:
        return StructType([*PLACE.fields, *wide_schema(self.options["paths"].split("\n")[0], self.options.get("columns")).fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["paths"].split("\n"), schema.fieldNames()[len(PLACE) :])


def wide_schema(path: str, columns: str | None) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    found = from_arrow_schema(files.arrow_schema(path))
    return StructType([found[c] for c in columns.split(",")]) if columns else found


def groups(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """path, row_group, row and columns; conditions on the place choose the row groups that are opened.

    Turns the session's push-down to Python sources on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ParquetGroups)
    reader = spark.read.format(ParquetGroups.name()).option("paths", "\n".join(paths))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def with_places(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of a Parquet scan with the path of each row's file and its number in it, which Spark's reader knows."""
    return rows.select(*columns, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        firsts = []
        for path in b.column("path").to_pylist():
            at, own = 0, []
            for n in files.group_rows(path):
                own.append(at)
                at += n
            firsts.append(own)
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(firsts, pa.list_(pa.int64()))], ["path", "firsts"])


def fetch(selected: DataFrame, columns: list[str], kinds: StructType | str) -> DataFrame:
    """Selected rows (path, row_index and what else they have) with heavy columns, read from their row groups only.

    kinds: the schema of the heavy columns. Footers are read on executors, one for each file that has a selected row.
    """
    kinds = StructType.fromDDL(kinds) if isinstance(kinds, str) else kinds
    firsts = selected.select("path").distinct().mapInArrow(_firsts, "path string, firsts array<long>")
    own = F.size(F.filter("firsts", lambda f: f <= F.col("row_index"))) - 1
    located = selected.join(firsts, "path").withColumn("_group", own).withColumn("_row", F.col("row_index") - F.element_at("firsts", F.col("_group") + 1)).drop("firsts")
    kept = selected.columns

    def read(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = files.read_group(key[0].as_py(), key[1].as_py(), columns)
        for b in batches:
            taken = wide.take(b.column("_row"))
            yield from pa.table([*(b.column(c) for c in kept), *(taken.column(c) for c in columns)], names=[*kept, *columns]).combine_chunks().to_batches()

    def grouped(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(read(key, rows.to_batches())))

    schema = StructType([*selected.schema.fields, *(kinds[c] for c in columns)])
    return located.groupBy("path", "_group").applyInArrow(grouped, schema)
