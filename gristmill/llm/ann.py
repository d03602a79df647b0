"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; a task gets one block of each. Vectors become int8 with a scale
each; the product of two int8 tiles, exact in floating point, approximates all inner products of the tile. By
Cauchy and Schwarz it errs by at most |q'||c - c'| + |q - q'||c| (primes: as quantised), so only pairs whose upper
bound reaches the k-th best score so far survive. These are computed again in double precision from the original
vectors and kept in a heap for each query; heaps of blocks are merged by query. The result is exact: no pair is
dropped unless k better ones are at hand.

Defined results for odd input: a vector that is null, zero, empty or holds a null or non-finite component takes no
part, nor does a row without id; of rows with one id the first by its vector counts; vectors meet only vectors of
their own length; ties go to the smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import table

QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 2048, 8192, 1024
HITS = "query_id long, vec_id long, score double"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and the lengths of the rows as quantised and of what quantising took away."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best of these candidates as a heap of (score, -id)."""
    q8, qs, qn, qe = quantised(q)
    c8, cs, _, ce = quantised(c)
    cn = np.linalg.norm(c, axis=1)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = q8.astype(exact)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    floor = np.full(len(qid), -np.inf)
    for lo in range(0, len(cid), TILE):
        part = slice(lo, lo + TILE)
        near = (left @ c8[part].astype(exact).T) * qs[:, None] * cs[None, part]
        off = (qn[:, None] * ce[None, part] + qe[:, None] * cn[None, part]) * (1 + 1e-9) + 1e-12 * np.outer(qn + qe, cn[part])
        own = qid[:, None] == cid[None, part]
        sure = np.where(own, -np.inf, near - off)
        if sure.shape[1] > k:  # k candidates score at least this; one more as the query itself may be among them
            floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((near + off >= floor[:, None]) & ~own)
        for at in range(0, len(rows), 1 << 14):
            r, j = rows[at : at + (1 << 14)], cols[at : at + (1 << 14)] + lo
            scores = np.add.accumulate(q[r] * c[j], axis=1)[:, -1]  # components in order, as any plain loop adds them
            for i, s, v in zip(r.tolist(), scores.tolist(), cid[j].tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        full = [i for i, h in enumerate(heaps) if len(h) == k]
        floor[full] = np.maximum(floor[full], [heaps[i][0][0] for i in full])
    return heaps


def _rows(t: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(f"{side}id").to_numpy()
    v = t.column(f"{side}v").combine_chunks()
    flat = (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.astype(np.float64).reshape(len(ids), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, dim of rows that take part."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.simpleString()
    sent = kind if kind == "array<float>" else "array<double>"  # floats are shuffled as floats; products are of doubles in any case
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(sent).alias("v")).filter(
        F.col("id").isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists(v, lambda x: x != 0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score; queries: a condition on the column ``id``."""
    rows = usable(vectors, id_col, vector_col)
    n, n_queries = rows.agg(F.count("*"), F.count_if(queries)).first()
    q_blocks, c_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n / CANDIDATE_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Both sides come from one frame: names and expressions of their own keep a cogroup from mixing them up.
    q = rows.filter(queries).select(
        F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("dim").alias("q_dim"), block(q_blocks).alias("q_qb"), every(c_blocks).alias("q_cb")
    )
    c = rows.select(
        F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.col("dim").alias("c_dim"), block(c_blocks).alias("c_cb"), every(q_blocks).alias("c_qb")
    )

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            (qid, qv), (cid, cv) = _rows(left, "q_"), _rows(right, "c_")
            for i, heap in zip(qid.tolist(), search_block(qid, qv, cid, cv, k), strict=True):
                out += [(i, -v, s) for s, v in heap]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def merge(hits: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip((-s for s in hits.column("score").to_pylist()), hits.column("vec_id").to_pylist(), strict=True))
        return pa.table(
            {
                "query_id": pa.array([hits.column("query_id")[0].as_py()] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()),
                "score": pa.array([-s for s, _ in best], pa.float64()),
            }
        )

    hits = q.groupBy("q_dim", "q_qb", "q_cb").cogroup(c.groupBy("c_dim", "c_qb", "c_cb")).applyInArrow(join, HITS)
    return hits.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


#: The query's rows by comparing all pairs; for small tables.
OP8_SQL = """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
  v AS (SELECT vec_id, min(e) AS e FROM x WHERE len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0 GROUP BY 1),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
