"""Ranked lexical search by the threshold algorithm.

Documents stay where they are read. A task indexes them block by block, for the terms of the queries: a list for each
term, sorted by impact (what the term adds to a document's score), and a forward index that finds a document's count of a
term. Every query walks its lists in rounds, some entries of each list a round; documents met for the first time get
their whole score by lookups in the forward index. The threshold is the score of a document that would stand at the
last entry read of every list; once it falls strictly below the k-th score so far, no unread document can enter, equal
scores included, and the walk ends. The k-th score is carried from block to block of a task. The best of all tasks
are merged by query. Two passes read the documents: one counts documents, terms and each term's documents, one searches;
only counts and k rows for each query and task are shuffled.

Queries are taken in blocks of a few megabytes of text, so that neither the driver nor a task holds more of them.

Defined results for odd input: a null or empty text has no terms and is never found; a row without id takes no part, in
counts either; repeated documents count, and are found, as often; of queries with one id the smallest text counts; a
query without terms, or whose terms no document holds, has no rows; a very long text is one entry of its block, whole; an
empty table gives an empty table; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm._shared import pieces, small_batches, table, written

#: Bytes of text that are indexed at once, and of queries that are searched in one pass.
BLOCK_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Entries that the first round reads of each list; later ones read twice as many as the one before.
FIRST_STEP = 8

#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A to Z become small.
_FOLD = bytes((c | 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of UTF-8 text in order."""
    return raw.translate(_FOLD).split()


class Query:
    """A query's terms by number, each with its weight times its repeats."""

    def __init__(self, terms: np.ndarray, gain: np.ndarray):
        self.terms, self.gain = terms, gain


class Best:
    """The k best documents so far: highest score first, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores > 0
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


class Block:
    """Impact-sorted lists and forward index of some documents, for n_terms terms."""

    def __init__(self, n_terms: int):
        self.n_terms = n_terms
        self.ids, self.m = array("q"), array("q")
        self.doc, self.term, self.count = array("i"), array("i"), array("q")

    def add(self, doc_id: int, m: int, counts: list[tuple[int, int]]) -> None:
        """counts: (term, times) of the query terms that the document holds, by term."""
        at = len(self.ids)
        self.ids.append(doc_id)
        self.m.append(m)
        for t, c in counts:
            self.doc.append(at)
            self.term.append(t)
            self.count.append(c)

    def close(self) -> None:
        self.doc_ids = np.frombuffer(self.ids, np.int64)
        doc, term, count = np.frombuffer(self.doc, np.int32), np.frombuffer(self.term, np.int32), np.frombuffer(self.count, np.int64)
        impact = (1_000_000_000 * count) // (1000 * count + 12 * np.frombuffer(self.m, np.int64)[doc])
        self.forward_key, self.forward_impact = doc.astype(np.int64) * self.n_terms + term, impact
        order = np.lexsort((doc, -impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(self.n_terms + 1))

    def scores(self, q: Query, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents by lookups in the forward index."""
        key = docs.astype(np.int64)[:, None] * self.n_terms + q.terms[None, :]
        at = np.minimum(np.searchsorted(self.forward_key, key), len(self.forward_key) - 1)
        return (np.where(self.forward_key[at] == key, self.forward_impact[at], 0) * q.gain).sum(axis=1)

    def search(self, q: Query, best: Best) -> int:
        """Walk the query's lists until no other document can enter; returns how many documents were looked up."""
        lo, hi = self.bounds[q.terms], self.bounds[q.terms + 1]
        seen, met, read, step = np.zeros(len(self.doc_ids), bool), 0, lo.copy(), FIRST_STEP
        while (read < hi).any():
            to = np.minimum(read + step, hi)
            docs = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(read, to, strict=True)]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            met += len(docs)
            if len(docs):
                best.add(self.scores(q, docs), self.doc_ids[docs])
            read, step = to, step * 2
            last = np.where(read < hi, self.list_impact[np.maximum(read - 1, 0)], 0)  # a list read to its end holds no other document
            if int((last * q.gain).sum()) < best.floor():
                break
        return met


def _counts(docs: DataFrame, ids: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and each numbered term's documents."""
    n_terms = len(ids)

    def run(batches):
        found, n, length = np.zeros(n_terms, np.int64), 0, 0
        for b in pieces(batches):
            for raw in b.column("raw").to_pylist():
                terms = terms_of(raw)
                n += bool(terms)
                length += len(terms)
                held = [ids[t] for t in ids.keys() & set(terms)]
                found[held] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*found[at].tolist(), n, length], pa.int64())], ["term", "n"])

    rows = docs.select("raw").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r.term: r.n for r in rows}
    df = np.array([by_term.get(t, 0) for t in range(n_terms)], np.int64)
    return by_term.get(-1, 0), by_term.get(-2, 0), df


def _searched(docs: DataFrame, ids: dict[bytes, int], queries: list[tuple[int, Query]], n: int, length: int, k: int) -> DataFrame:
    """query_id, doc_id, score: the best k of each task."""
    n_terms = len(ids)

    def run(batches):
        best = [Best(k) for _ in queries]
        block, held = Block(n_terms), 0

        def flush():
            block.close()
            if len(block.forward_key):
                for (_, q), b in zip(queries, best, strict=True):
                    block.search(q, b)

        for b in pieces(batches):
            for doc_id, raw in zip(b.column("id").to_pylist(), b.column("raw").to_pylist(), strict=True):
                terms = terms_of(raw)
                counts = Counter(terms)
                own = sorted((ids[t], counts[t]) for t in ids.keys() & counts.keys())
                if own:
                    block.add(doc_id, 100 - 25 + (25 * len(terms) * n) // length, own)
                held += len(raw)
                if held >= BLOCK_BYTES:
                    flush()
                    block, held = Block(n_terms), 0
        flush()
        asked = np.repeat(np.array([q for q, _ in queries], np.int64), [len(b.ids) for b in best])
        cols = [asked, np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "doc_id", "score"])

    return docs.mapInArrow(run, "query_id long, doc_id long, score long")


def _block_of_queries(docs: DataFrame, texts: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    split = [(q, Counter(terms_of(raw))) for q, raw in texts]
    ids = {t: i for i, t in enumerate(sorted({t for _, c in split for t in c}))}
    if not ids:
        return None
    n, length, df = _counts(docs, ids)
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
    queries = []
    for q, c in split:
        own = sorted((ids[t], times * weight[ids[t]]) for t, times in c.items() if df[ids[t]])
        if own:
            queries.append((q, Query(*(np.array(x, np.int64) for x in zip(*own, strict=True)))))
    return _searched(docs, ids, queries, n, length, k) if queries else None


def ranked(
    docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """query_id, rank, doc_id, score: every query's k best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw")).filter("id IS NOT NULL AND raw IS NOT NULL")
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("q"), F.col(f"`{query_text}`").cast("binary").alias("raw")).filter("q IS NOT NULL AND raw IS NOT NULL")
    asked = asked.groupBy("q").agg(F.min("raw").alias("raw"))
    blocks = 1 + (asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // QUERY_BYTES
    found = []
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else asked
        hits = _block_of_queries(rows, [(r.q, bytes(r.raw)) for r in own.orderBy("q").collect()], k)
        if hits is not None:
            found.append(written(hits, "hits") if blocks > 1 else hits)
    hits = found[0] if found else spark.createDataFrame([], "query_id long, doc_id long, score long")
    for more in found[1:]:
        hits = hits.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


#: The query's rows by the score of every document that shares a term with an item; for small tables.
OP13_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
  b AS (SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
  q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
  p AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS size, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
  z AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * (SELECT n FROM s)) // (SELECT l FROM s)))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM z WHERE score > 0 QUALIFY rank <= 20"""
