"""Token F1 of every document with a stated set of items, in blocks of items.

Documents stay where they are read: a task counts a document's tokens once, and looks up only those that an item of the block
holds, so the work is linear in the text and no token is a join key. Items come in blocks of a few megabytes of text,
one pass over the documents each; the best of the blocks are merged by a maximum.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of items that meet the documents in one pass, and rows that are turned into Python objects at once.
ITEM_BYTES, ROWS = 4 << 20, 256

#: White space of ASCII, as Spark's own regular expressions take \s.
BLANK = re.compile(rb"[ \t\n\x0b\f\r]+")


class Items:
    """Items by number, with the numbers and counts of those that hold a token."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        bags = [Counter(BLANK.split(raw)) for _, raw in rows]
        self.sizes = np.array([b.total() for b in bags], np.int64)
        self.tokens = {t: n for n, t in enumerate(sorted({t for b in bags for t in b}))}
        held = sorted((self.tokens[t], i, n) for i, b in enumerate(bags) for t, n in b.items())
        token, self.item, self.count = (np.array(x, np.int64) for x in zip(*held, strict=True))
        self.bounds = np.searchsorted(token, np.arange(len(self.tokens) + 1))

    def f1(self, raw: bytes) -> np.ndarray:
        """Of a text with every item: twice the common tokens, as multisets, by the tokens of both; to nine places."""
        tokens = BLANK.split(raw)
        bag = Counter(tokens)
        known = [(self.tokens[t], bag[t]) for t in self.tokens.keys() & bag.keys()]
        if not known:
            return np.zeros(len(self.ids))
        at, times = np.array(known, np.int64).T
        long = self.bounds[at + 1] - self.bounds[at]
        entry = np.arange(long.sum()) + np.repeat(self.bounds[at] - np.cumsum(long) + long, long)
        common = np.bincount(self.item[entry], np.minimum(self.count[entry], np.repeat(times, long)), len(self.ids))
        return np.round(2.0 * common / (len(tokens) + self.sizes), 9)


def _lowered(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.lower(text).cast("binary").alias("raw"))


def _blocks(items: DataFrame, key: str, text: str):
    """Items in blocks of about ITEM_BYTES; of rows with one key the smallest text counts."""
    rows = _lowered(items, key, text).filter("id IS NOT NULL AND raw IS NOT NULL").groupBy("id").agg(F.min("raw").alias("raw"))
    n = 1 + (rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // ITEM_BYTES
    for i in range(n):
        found = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect()
        if found:
            yield Items(sorted((r.id, bytes(r.raw)) for r in found))


def _texts(batches):
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            yield part, part.column("raw").to_pylist()


def _each(batches, items: Items):
    """Every row's best F1 with an item of the block; 0 without a text."""
    for part, texts in _texts(batches):
        best = [0.0 if raw is None else float(items.f1(raw).max()) for raw in texts]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.float64())], ["id", "f1"])


def nearest_f1(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text") -> DataFrame:
    """doc_key, f1: every document's best F1 with an item; 0 where it shares no token with one."""
    rows, out = _lowered(docs, doc_key, text), None
    for block in _blocks(items, item_key, text):
        more = rows.mapInArrow(lambda batches, block=block: _each(batches, block), "id long, f1 double")
        out = more if out is None else out.unionByName(more).groupBy("id").agg(F.max("f1").alias("f1"))
    out = rows.select("id", F.lit(0.0).alias("f1")) if out is None else out
    return out.select(F.col("id").alias(doc_key), "f1")


def _best(batches, items: Items):
    """Of a task's rows the best with every item: highest F1, then smallest key."""
    top, who = np.zeros(len(items.ids)), np.full(len(items.ids), np.iinfo(np.int64).max)
    for part, texts in _texts(batches):
        for key, raw in zip(part.column("id").to_pylist(), texts, strict=True):
            if key is None or raw is None:
                continue
            f1 = items.f1(raw)
            better = (f1 > top) | (f1 == top) & (f1 > 0) & (key < who)
            top[better], who[better] = f1[better], key
    found = top > 0
    yield pa.RecordBatch.from_arrays([pa.array(items.ids[found]), pa.array(who[found]), pa.array(top[found])], ["item", "id", "f1"])


def best_documents(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text") -> DataFrame:
    """item_key, doc_key, f1: every item's best document; no row for an item that shares no token with one."""
    rows, out = _lowered(docs, doc_key, text), None
    for block in _blocks(items, item_key, text):
        more = rows.mapInArrow(lambda batches, block=block: _best(batches, block), "item long, id long, f1 double")
        out = more if out is None else out.unionByName(more)
    if out is None:
        return rows.filter(F.lit(False)).select(F.lit(0).cast("long").alias(item_key), F.col("id").alias(doc_key), F.lit(0.0).alias("f1"))
    rank = F.struct("f1", (-F.col("id")).alias("first"))
    best = out.groupBy("item").agg(F.max_by("id", rank).alias(doc_key), F.max("f1").alias("f1"))
    return best.withColumnRenamed("item", item_key)

