"""Files behind a URI, for code on executors and for footers that a driver plans with."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyarrow import parquet as pq


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and the path in it; a bare path and file: are local."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path) if u.scheme else uri
    return fs.FileSystem.from_uri(uri)


def group_rows(uri: str) -> list[int]:
    """Rows of each row group of a Parquet file, from its footer."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        return [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]


def arrow_schema(uri: str):
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        return pq.ParquetFile(f).schema_arrow


def read_group(uri: str, group: int, columns: list[str] | None = None):
    """One row group as an Arrow table; no other group is read."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        return pq.ParquetFile(f).read_row_group(group, columns=columns)
