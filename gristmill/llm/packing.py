"""Best-fit packing after dominance reduction.

Documents become token ids and an end id; longer ones are cut, the first piece taking the remainder. What has to
be packed is a count for every length from 1 to the capacity, however many documents there are. On these counts
Martello and Toth's reduction first fixes small sets that provably dominate every alternative for a piece, then
best-fit decreasing places the rest. The outcome is a list of patterns with multiplicities, whose size depends
on the capacity only; a piece finds its place by its rank among pieces of its length. Ranks are counted where
the pieces are made, as file part and rank within the part, so no key is ever gathered in one task.

Defined results for odd input: a null or empty text is one piece holding the end id alone; repeated rows and
equal ids are packed as separate rows; a very long text becomes as many pieces as it needs; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm._shared import pieces, table, written
from gristmill.llm.chunking import tokenizer_encoder

VOCABULARY, CAPACITY, END_ID = "byte_bpe_50k.json", 2048, 0


class _Stock:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to most that is left after taking those of without away; 0 if none."""
        i = bisect.bisect_right(self.lengths, most)
        while i:
            i -= 1
            if self.n[self.lengths[i]] > without.count(self.lengths[i]):
                return self.lengths[i]
        return 0

    def least(self, k: int, without: tuple[int, ...] = ()) -> int | None:
        """Sum of the k smallest, or None if there aren't k."""
        total = 0
        for length in self.lengths:
            m = min(k, self.n[length] - without.count(length))
            total, k = total + m * length, k - m
            if not k:
                return total
        return None

    def partner(self, smaller: int, most: int, first: int) -> int | None:
        """A partner for ``smaller``: some length from smaller to most that is left beside first and smaller."""
        i = bisect.bisect_left(self.lengths, smaller)
        while i < len(self.lengths) and self.lengths[i] <= most:
            length = self.lengths[i]
            if self.n[length] > (length == first) + (length == smaller):
                return length
            i += 1
        return None


def reduce_by_dominance(stock: _Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix bins of at most three pieces that dominate all feasible bins holding their first piece."""
    fixed = []
    i = len(stock.lengths) - 1
    while i >= 0:
        first = stock.lengths[i]
        room = capacity - first
        second = stock.largest(room, (first,)) if room else 0
        best: tuple[int, ...] | None = None
        if not second:
            best = (first,)
        else:
            pair = stock.least(2, (first,))
            if second == room or pair is None or pair > room:
                best = (first, second)  # nothing fills the room better than one piece
            else:
                three = stock.least(3, (first,))
                third = stock.largest(room - second, (first, second))
                if third and (three is None or three > room):
                    # Two more pieces at most. These dominate if no feasible pair has a larger smaller piece.
                    smaller = stock.largest(room // 2, (first,))
                    while smaller and stock.partner(smaller, room - smaller, first) is None:
                        smaller = stock.largest(smaller - 1, (first,))
                    if smaller <= third:
                        best = (first, second, third)
        if best is None:
            i -= 1
            continue
        used = {x: best.count(x) for x in set(best)}
        times = min(stock.n[x] // c for x, c in used.items())
        fixed.append((best, times))
        for x, c in used.items():
            stock.take(x, c * times)
        i = min(bisect.bisect_right(stock.lengths, first), len(stock.lengths)) - 1
    return fixed


def best_fit(stock: _Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: bins with one content are kept as one pattern."""
    open_bins: dict[int, list[list]] = {}  # room -> [content, multiplicity]
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append([content, n])

    for length in reversed(stock.lengths):
        left = stock.n[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                content, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                room, content, n = capacity, (), -(-left // (capacity // length))
            each = room // length  # best fit stays with a bin while another one fits
            full = min(n, left // each)
            if full:
                put(room - each * length, content + (length,) * each, full)
                left -= full * each
            if full < n:
                some = min(left, each)
                if some:
                    put(room - some * length, content + (length,) * some, 1)
                    left -= some
                if n - full - bool(some) and room < capacity:
                    put(room, content, n - full - bool(some))
    return [(content, n) for group in open_bins.values() for content, n in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) with multiplicities that use up all counts."""
    stock = _Stock(counts)
    fixed = reduce_by_dominance(stock, capacity)
    return fixed + best_fit(stock, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from the first on go to sequences from the first on."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, n in patterns:
        at = 0
        for length in content:
            r = ranks.get(length, 0)
            rows.setdefault(length, []).append((r, sequence, at))
            ranks[length] = r + n
            at += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, with their part of the input and their rank in it among pieces of their length."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encoder = tokenizer_encoder(path, True)
        end = np.array([end_id], "<u4").tobytes()
        for b in pieces(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.texts(b.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                at, piece, n = 0, 0, total % capacity or min(total, capacity)
                while at < total:
                    rows.append((doc, piece, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), part, int(seen[n])))
                    seen[n] += 1
                    at, piece, n = at + n, piece + 1, capacity
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, PIECES)


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces from cut() with sequence_id and offset.

    The pieces are written once, so that ranks stay what they are, as few files: their rows are some dozens of bytes for each
    document, so the tasks that encode texts send them on instead of making a file each. A lost task makes the same pieces again
    if its documents come from a table, as those of the pipeline and of a scan do.
    """
    cuts = written(cuts.hint("rebalance"), "pieces")
    counts = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan(totals, capacity))  # bounded by the capacity, not by the rows

    def run(batches):
        for b in pieces(batches):
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = place[int(n)]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cuts.join(base, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document packed into sequences."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return pack(cut(table(spark, sf_dir, "documents"), path))
