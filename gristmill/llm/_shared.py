"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="gristmill-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours; a session that has ended takes no more calls and the folder stays."""
    try:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the gateway is gone at exit
        return


#: Bytes of rows that Spark sends to a Python worker at once, on either side of the socket.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts are long: Spark's own bound of 64 MB is replaced, one that a user chose stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):
        spark.conf.set(key, str(ARROW_BYTES))


@contextmanager
def sized_tasks(spark: SparkSession) -> Iterator[None]:
    """Settings under which tables are written: few files, and shuffles that go when the table is there.

    Shuffled partitions are merged up to their advisory size, so that a table has files by its bytes and not by the number
    of cores: a local file system without Hadoop's native library starts four programs for every file that it creates.
    A table that is written needs its shuffles no more, a lost executor included, so Spark may delete their files at once.
    """
    wanted = {
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, what)
    with sized_tasks(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a table of written() that nothing will read again."""
    remove(df.sparkSession, df._folder)


def store_of(uri: str):
    """Arrow's file system and path for a URI, for code on executors."""
    from pyarrow import fs

    u = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(u.path)) if u.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def pieces(batches, most_bytes: int = 4 << 20):
    """Arrow batches cut so that few megabytes are turned into Python objects, or sent back, at once."""
    for b in batches:
        step = max(1, b.num_rows * most_bytes // max(1, b.nbytes))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What make() gives, which this worker process keeps for its next tasks; anything kept under another key goes.

    Spark hands a worker from step to step. So a worker never holds the tables of two steps, and steps with tables of their
    own call release() first.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what kept() holds for an earlier step."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
