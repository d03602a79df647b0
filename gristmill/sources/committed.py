"""Rows and the audit of those that failed, as one output that is there whole or not at all.

Tasks write below a folder beside the target: good rows as Parquet shards with row groups of a bounded number of rows, rows
with an error as JSON lines. They report the files that they closed; what lost attempts left is removed. If the audit allows it,
the commit writes a manifest and renames the folder to the target in one step, so rows, audit and manifest appear together; if it
doesn't, or a task fails, the folder goes and nothing is there. Where a rename isn't one step (object stores), readers should
take the files that the manifest names, which is written last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gristmill.sources import files

MANIFEST = "_MANIFEST.json"


@dataclass
class Part(WriterCommitMessage):
    """Files that a task closed, below the folder, with their rows."""

    rows: dict[str, int]
    audit: dict[str, int]


class _Shards:
    """Rotating Parquet files of full row groups."""

    def __init__(self, store: fs.FileSystem, folder: str, task: str, group_rows: int, shard_rows: int, dictionary: list[str]):
        self.store, self.folder, self.task = store, folder, task
        self.group_rows, self.shard_rows, self.dictionary = group_rows, shard_rows, dictionary
        self.writer, self.name, self.held, self.pending, self.done = None, "", 0, [], {}

    def add(self, t: pa.Table) -> None:
        self.pending.append(t)
        while sum(p.num_rows for p in self.pending) >= self.group_rows:
            self._group()

    def _group(self) -> None:
        t = pa.concat_tables(self.pending)
        room = min(self.group_rows, self.shard_rows - self.held if self.writer else self.shard_rows)
        if self.writer is None:
            self.name = f"rows/part-{self.task}-{len(self.done):05d}.parquet"
            self.writer = pq.ParquetWriter(f"{self.folder}/{self.name}", t.schema, filesystem=self.store, compression="zstd", use_dictionary=self.dictionary)
        self.writer.write_table(t.slice(0, room), row_group_size=self.group_rows)
        self.held += min(room, t.num_rows)
        self.pending = [t.slice(room)] if t.num_rows > room else []
        if self.held >= self.shard_rows:
            self._shut()

    def _shut(self) -> None:
        self.writer.close()
        self.done[self.name], self.writer, self.held = self.held, None, 0

    def close(self) -> dict[str, int]:
        while self.pending:
            self._group()
        if self.writer:
            self._shut()
        return self.done

    def drop(self) -> None:
        if self.writer:
            self.writer.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.error = options["path"].rstrip("/"), options.get("error")
        self.group_rows, self.shard_rows = int(options.get("group_rows", 256)), int(options.get("shard_rows", 1000))
        self.dictionary = [c for c in options.get("dictionary", "").split(",") if c]
        self.most_errors = float(options.get("most_errors", "inf"))
        self.schema, self.overwrite, self.aside = schema, overwrite, f"{self.path}.{uuid.uuid4().hex[:12]}"
        missing = [c for c in [*self.dictionary, *([self.error] if self.error else [])] if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        store, target = files.store_of(self.path)
        if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = files.store_of(self.aside)
        for kind in ("rows", "audit"):
            store.create_dir(f"{folder}/{kind}", recursive=True)
        task, bad, name, out = uuid.uuid4().hex[:12], 0, "", None
        shards = _Shards(store, folder, task, self.group_rows, self.shard_rows, self.dictionary)
        try:
            for b in iterator:
                t = pa.Table.from_batches([b])
                if self.error:
                    failed = t.filter(pc.is_valid(t.column(self.error)))
                    t = t.filter(pc.is_null(t.column(self.error))).drop_columns([self.error])
                    if failed.num_rows:
                        if out is None:
                            name = f"audit/part-{task}.json"
                            out = store.open_output_stream(f"{folder}/{name}")
                        for row in failed.to_pylist():
                            out.write((json.dumps(row, sort_keys=True, default=str, ensure_ascii=False) + "\n").encode())
                        bad += failed.num_rows
                if t.num_rows:
                    shards.add(t)
            return Part(shards.close(), {name: bad} if bad else {})
        finally:
            shards.drop()
            if out is not None:
                out.close()

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = files.store_of(self.aside)
        _, target = files.store_of(self.path)
        parts = [m for m in messages if m is not None]
        rows = {k: v for m in parts for k, v in m.rows.items()}
        audit = {k: v for m in parts for k, v in m.audit.items()}
        errors = sum(audit.values())
        if errors > self.most_errors:
            raise ValueError(f"{errors} rows with an error, {self.most_errors:g} are allowed")
        for kind in ("rows", "audit"):
            store.create_dir(f"{folder}/{kind}", recursive=True)
            for info in store.get_file_info(fs.FileSelector(f"{folder}/{kind}")):
                if f"{kind}/{info.base_name}" not in rows and f"{kind}/{info.base_name}" not in audit:
                    store.delete_file(info.path)
        if not rows:
            rows = self._empty(store, folder)
        manifest = {"rows": rows, "audit": audit, "total_rows": sum(rows.values()), "errors": errors}
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            raise FileExistsError(self.path)
        if there:
            store.move(target, f"{folder}.old")
        store.move(folder, target)
        if there:
            store.delete_dir(f"{folder}.old")

    def _empty(self, store: fs.FileSystem, folder: str) -> dict[str, int]:
        """A file without rows, for its schema."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(StructType([f for f in self.schema if f.name != self.error]))
        pq.write_table(schema.empty_table(), f"{folder}/rows/part-none.parquet", filesystem=store)
        return {"rows/part-none.parquet": 0}

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = files.store_of(self.aside)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class CommittedShards(DataSource):
    """Options: path, error (a column: rows where it isn't null are the audit's), group_rows, shard_rows, dictionary (columns,
    comma-separated), most_errors (more than so many undo the write)."""

    @classmethod
    def name(cls) -> str:
        return "committed_shards"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)


def write(rows: DataFrame, path: str, error: str | None = None, force: bool = False, **options) -> None:
    """Rows to path/rows, those with an error to path/audit, both or neither; refuses a path that exists unless forced."""
    rows.sparkSession.dataSource.register(CommittedShards)
    writer = rows.write.format(CommittedShards.name()).mode("overwrite" if force else "append").option("path", path)
    for key, value in (options | ({"error": error} if error else {})).items():
        writer = writer.option(key, value)
    writer.save()
