"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A store is a folder of parts and one manifest. Part k has <name>.ids (unsigned integers of one width, nothing
else), <name>.offsets (documents + 1 little-endian 64-bit integers, the first 0) and <name>.docs (64-bit
document ids, ascending). Parts cover ascending ranges of document ids; where a part's ids begin in the whole
is the prefix sum of the parts before it and stands in manifest.json, which is written last. Files are memory-
mapped for reading. A task writes under a name of its own attempt and the manifest names only what succeeded,
so lost executors and repeated tasks leave nothing that a reader would see.

Defined results for odd input: a null or empty text has the end id alone; a null document id sorts first and is
kept as the least 64-bit integer; rows with one id are ordered by text; very long texts are encoded whole; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import fresh_path, hadoop, pieces, table
from gristmill.llm.chunking import tokenizer_encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 2
NO_ID = -(1 << 63)


def _local(uri: str) -> str | None:
    """The path of a file URI; None for another store."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Part:
    """The three files of one part, appended to batch by batch."""

    def __init__(self, root: str, name: str, dtype: str):
        self.name, self.dtype = name, dtype
        self.n_docs = self.n_tokens = 0
        self.first: int | None = None
        kinds = ("ids", "offsets", "docs")
        if (path := _local(root)) is not None:
            os.makedirs(path, exist_ok=True)
            self.out = {k: open(f"{path}/{name}.{k}", "wb") for k in kinds}  # noqa: SIM115
        else:
            fs, path = _store(root)
            fs.create_dir(path, recursive=True)
            self.out = {k: fs.open_output_stream(f"{path}/{name}.{k}") for k in kinds}
        self.out["offsets"].write(np.zeros(1, "<i8").tobytes())

    def append(self, docs: list[int], ids: list[bytes]) -> None:
        """ids: little-endian unsigned 32-bit, a value for each document."""
        if not docs:
            return
        if self.first is None:
            self.first = docs[0]
        lengths = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
        self.out["ids"].write(np.frombuffer(b"".join(ids), "<u4").astype(self.dtype).tobytes())
        self.out["offsets"].write((self.n_tokens + np.cumsum(lengths)).astype("<i8").tobytes())
        self.out["docs"].write(np.array(docs, "<i8").tobytes())
        self.n_docs += len(docs)
        self.n_tokens += int(lengths.sum())

    def close(self) -> None:
        for f in self.out.values():
            f.close()


def write(
    docs: DataFrame, root: str, path: str, end_id: int = END_ID, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the store; dtype must hold every id of the vocabulary.

    Texts are dealt by ranges of id before they are encoded: they are smaller than their ids, and each task then
    writes the ids it makes.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = tokenizer_encoder(path, False)
        end = np.array([end_id], "<u4").tobytes()
        part = None
        for b in pieces(batches):
            if part is None:
                part = _Part(root, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", dtype)
            ids = [i + end for i in encoder.texts(b.column(1).to_pylist())]
            part.append(b.column(0).to_pylist(), ids)
        if part is not None:
            part.close()
            if part.n_docs:
                yield pa.RecordBatch.from_pylist(
                    [{"name": part.name, "first": part.first, "n_docs": part.n_docs, "n_tokens": part.n_tokens}]
                )

    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), docs[text_col].alias("text"))
    dealt = rows.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    parts = dealt.mapInArrow(run, "name string, first long, n_docs long, n_tokens long").collect()  # one row a part
    parts.sort(key=lambda r: r["first"])
    bases = [0, *accumulate(r["n_tokens"] for r in parts)]
    manifest = {
        "dtype": dtype,
        "n_tokens": bases[-1],
        "parts": [{"name": r["name"], "base": base, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]} for r, base in zip(parts, bases, strict=False)],
    }
    spark = docs.sparkSession
    fs, p = hadoop(spark, f"{root}/manifest.json.tmp")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")):
        raise OSError(f"{root} holds a store already")


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/manifest.json").collect()))


def _mapped(root: str, name: str, kind: str, dtype: str, held: list) -> np.ndarray:
    path = _local(root)
    if path is None:  # copied beside the worker for the time of the mapping
        fs, base = _store(root)
        own = tempfile.NamedTemporaryFile()  # noqa: SIM115
        held.append(own)
        with fs.open_input_stream(f"{base}/{name}.{kind}") as f:
            while block := f.read(1 << 22):
                own.write(block)
        own.flush()
        file = own.name
    else:
        file = f"{path}/{name}.{kind}"
    return np.memmap(file, dtype, "r") if os.path.getsize(file) else np.zeros(0, dtype)


def read(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and ids as unsigned 32-bit binary if asked for."""
    manifest = read_manifest(spark, root)
    dtype = manifest["dtype"]

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held: list = []
                ids, offsets, docs = (_mapped(root, name, k, d, held) for k, d in (("ids", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for lo in range(0, len(docs), 4096):
                    bounds = offsets[lo : lo + 4097].tolist()
                    raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
                    doc = docs[lo : lo + 4096]
                    columns = [
                        pa.array(doc, mask=doc == NO_ID),
                        pa.array([base + x for x in bounds[:-1]], pa.int64()),
                        pa.array([len(r) // 4 for r in raw], pa.int64()),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    ] + ([pa.array(raw, pa.binary())] if with_ids else [])
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    parts = spark.createDataFrame([(p["name"], p["base"]) for p in manifest["parts"]], "name string, base long")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op4_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded, written in ascending order of id, and read back."""
    import public_tokenizers

    root = fresh_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), root, vocabulary or public_tokenizers.path(VOCABULARY))
    return read(spark, root)
