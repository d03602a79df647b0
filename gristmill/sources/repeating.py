"""Parquet files as an endless stream that goes on where it stopped.

The offset is the place of the next row: epoch, file, row group, row. A batch takes the rows after it, some thousands, cut
at row groups, which are its partitions; planning reads footers only. After the last file the next epoch begins, in a new
seeded order of files if asked for. Spark logs the offsets in the query's checkpoint, so a query that was killed goes on with
the row after the last one that it committed, and repeats a batch that it had not.

Every row carries its own place, so whoever trains from the stream can name the last row taken. Files that can't be opened and
row groups that can't be read are an error, or are passed over (on_error=skip); a passed-over file counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gristmill.sources import files

PLACE = StructType([StructField("epoch", LongType()), StructField("file", StringType()), StructField("row_group", IntegerType()), StructField("row", LongType())])


@dataclass
class Span(InputPartition):
    """Rows first to stop (exclusive) of a row group."""

    epoch: int
    path: str
    group: int
    first: int
    stop: int


def epoch_order(paths: list[str], seed: str, epoch: int) -> list[str]:
    """The files of an epoch: as given without a seed, else by a hash of seed, epoch and name."""
    if seed == "":
        return paths
    return sorted(paths, key=lambda p: (hashlib.sha256(f"{seed}:{epoch}:{p}".encode()).digest(), p))


class Course:
    """Walks the row groups of files, epoch after epoch. sizes: rows of each row group of a file."""

    def __init__(self, paths: list[str], epochs: int, seed: str, sizes):
        self.paths, self.epochs, self.seed, self.sizes = paths, epochs, seed, sizes

    def start(self) -> dict:
        return {"epoch": 0, "file": 0, "group": 0, "row": 0}

    def advance(self, at: dict, rows: int | None = None, end: dict | None = None) -> tuple[list[Span], dict]:
        """The spans from a place on, of so many rows or up to another place, and the place after them."""
        spans, left, idle = [], rows, 0
        epoch, file, group, row = (at[k] for k in ("epoch", "file", "group", "row"))
        goal = None if end is None else tuple(end[k] for k in ("epoch", "file", "group", "row"))
        while (left is None or left > 0) and (not self.epochs or epoch < self.epochs) and (goal is None or (epoch, file, group, row) < goal):
            order = epoch_order(self.paths, self.seed, epoch)
            if file >= len(order):
                if idle >= len(order):  # a whole epoch without a row
                    raise ValueError("none of the files has a row")
                epoch, file, group, row = epoch + 1, 0, 0, 0
                continue
            sizes = self.sizes(order[file])
            if group >= len(sizes):
                idle = 0 if any(sizes) else idle + 1
                file, group, row = file + 1, 0, 0
                continue
            stop = sizes[group]
            if left is not None:
                stop = min(stop, row + left)
            if goal is not None and (epoch, file, group) == goal[:3]:
                stop = min(stop, goal[3])
            if stop > row:
                spans.append(Span(epoch, order[file], group, row, stop))
                left = None if left is None else left - (stop - row)
                row = stop
            if row >= sizes[group]:
                group, row = group + 1, 0
        return spans, {"epoch": epoch, "file": file, "group": group, "row": row}


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        paths = options["paths"].split("\n")
        shard, shards = int(options.get("shard", 0)), int(options.get("shards", 1))
        self.skip, self.rows, self.columns = options.get("on_error", "fail") == "skip", int(options.get("rows_per_batch", 10_000)), columns
        self.known: dict[str, list[int]] = {}
        self.course = Course(paths[shard::shards], int(options.get("epochs", 0)), options.get("seed", ""), self._sizes)
        self.seen: dict | None = None

    def _sizes(self, path: str) -> list[int]:
        if path not in self.known:
            try:
                self.known[path] = files.group_rows(path)
            except (OSError, pa.ArrowException):
                if not self.skip:
                    raise
                self.known[path] = []
        return self.known[path]

    def initialOffset(self) -> dict:
        return self.course.start()

    def latestOffset(self) -> dict:
        return self.course.advance(self.seen or self.initialOffset(), self.rows)[1]

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Spark also calls this with the last offset of its log when a query goes on; the next batch starts there."""
        self.seen = end
        return self.course.advance(start, end=end)[0]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        try:
            t = files.read_group(partition.path, partition.group, self.columns)
        except (OSError, pa.ArrowException):
            if not self.skip:
                raise
            return
        t = t.slice(partition.first, partition.stop - partition.first)
        n = t.num_rows
        place = [pa.array([partition.epoch] * n, pa.int64()), pa.array([partition.path] * n), pa.array([partition.group] * n, pa.int32()), pa.array(range(partition.first, partition.stop), pa.int64())]
        t = pa.table(dict(zip(self.columns, t.select(self.columns).columns, strict=True)) | dict(zip(PLACE.fieldNames(), place, strict=True)))
        yield from t.to_batches(max_chunksize=1024)


class RepeatingParquet(DataSource):
    """Options: paths (one a line), columns (comma-separated; all), rows_per_batch, epochs (0: endless), seed (none: files in the
    given order), shard and shards (every shards-th file), on_error (fail, skip)."""

    @classmethod
    def name(cls) -> str:
        return "repeating_parquet"

    def _schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found, error = None, None
        for path in self.options["paths"].split("\n"):
            try:
                found = from_arrow_schema(files.arrow_schema(path))
                break
            except (OSError, pa.ArrowException) as e:
                error = e
                if self.options.get("on_error", "fail") != "skip":
                    raise
        if found is None:
            raise ValueError("no file can be opened") from error
        named = self.options.get("columns")
        return StructType([found[c] for c in named.split(",")] if named else found.fields)

    def schema(self) -> StructType:
        return StructType([*self._schema().fields, *PLACE.fields])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options), [c for c in schema.fieldNames() if c not in PLACE.fieldNames()])


def repeating(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """A stream of the files' rows with their places; options as RepeatingParquet's."""
    spark.dataSource.register(RepeatingParquet)
    reader = spark.readStream.format(RepeatingParquet.name()).option("paths", "\n".join(paths))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()
