"""Centroid clustering by weighted deduplication.

Vectors are turned into integers and grouped: every distinct one stands once, with its multiplicity. Lloyd's rounds run
over the distinct vectors only; a task adds up multiplicity times component in whole numbers, so sums, means and
distances are exact and don't depend on how rows are dealt. What the driver holds is the centroids: k times the number
of components. At the end the assignments of distinct vectors are joined back to all ids; vectors that make up a
256th of all rows or more, hence 256 at most, are joined by broadcast, so a vector that a third of all rows share
is no hot key.

Defined results for odd input: a vector that is null, of another length or holds a null or non-finite component takes no
part; a null id stays, but is no first centroid (without any id there are no clusters and no rows); repeated rows stay
repeated and count as often; fewer than k vectors give as many centroids; equal centroids keep their numbers and the smaller takes all; an empty table gives an empty
table; other columns are ignored. Quantised components stop at 2^53 on either side, distances and sums at the largest long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import pieces, small_batches, table, written

#: Quantised components beyond this are cut to it; a double holds every integer up to it.
WIDEST = 1 << 53
LARGEST_LONG = (1 << 63) - 1
#: A vector of one in so many rows is joined by broadcast; there can't be more of them.
HEAVY = 256
#: Rows whose distances need Python's integers are compared so many at once.
ODD_ROWS = 256


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, q (array<long>) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    whole = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(WIDEST)), F.lit(-WIDEST))
    return rows.filter(good).select("id", F.transform(v, whole).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.filter(F.col("id").isNotNull()).select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return [list(r.q) for r in found]


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid and squared distance of each row, exactly; ties go to the smaller number."""
    c = np.array(centroids, dtype=np.int64)
    widest = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * x.shape[1] * widest * widest < WIDEST:  # every sum is a whole number that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        far = (xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]
        who = far.argmin(axis=1)
        return who, far[np.arange(len(x)), who].astype(np.int64).tolist()
    who, dist = np.empty(len(x), np.int64), []
    for lo in range(0, len(x), ODD_ROWS):
        gap = x[lo : lo + ODD_ROWS, None, :].astype(object) - c.astype(object)[None]
        for i, far in enumerate((gap * gap).sum(axis=2).tolist()):
            who[lo + i] = far.index(min(far))
            dist.append(min(far))
    return who, dist


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(distinct: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """(centroid, 0): its number of rows; (centroid, 1 + i): the sum of their i-th components."""
    dims = len(centroids[0])

    def run(batches):
        sums = [[0] * (1 + dims) for _ in centroids]
        for b in (p for p in pieces(batches) if p.num_rows):
            x, n = _matrix(b), b.column("n").to_numpy()
            who, _ = assigned(x, centroids)
            wide = int(np.abs(x).max()) * int(n.sum()) >= 1 << 62
            for c in np.unique(who).tolist():
                own = who == c
                weights = n[own].astype(object) if wide else n[own]
                parts = [int(weights.sum()), *(weights[:, None] * x[own]).sum(axis=0).tolist()]
                sums[c] = [a + p for a, p in zip(sums[c], parts, strict=True)]
        used = [c for c, s in enumerate(sums) if s[0]]
        values = pa.array([sums[c] for c in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], ["c", "sums"])

    parts = distinct.mapInArrow(run, "c int, sums array<decimal(38,0)>").select("c", F.posexplode("sums").alias("i", "s"))
    return {(r.c, r.i): int(r.s) for r in parts.groupBy("c", "i").agg(F.sum("s").alias("s")).collect()}


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round of Lloyd: every centroid that has rows becomes the floor of their mean."""
    sums = _sums(distinct, centroids)
    mean = lambda c: [sums[c, 1 + i] // sums[c, 0] for i in range(len(centroids[0]))]
    return [mean(c) if (c, 0) in sums else old for c, old in enumerate(centroids)]


def _labelled(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """h, q, n with cluster, distance and total: distance times multiplicity."""

    def run(batches):
        for b in (p for p in pieces(batches) if p.num_rows):
            who, dist = assigned(_matrix(b), centroids)
            total = [min(d * n, 10**37) for d, n in zip(dist, b.column("n").to_pylist(), strict=True)]
            new = [pa.array(who, pa.int32()), pa.array([min(d, LARGEST_LONG) for d in dist], pa.int64()), pa.array(total, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], ["h", "q", "n", "cluster", "distance", "total"])

    return distinct.mapInArrow(run, "h long, q array<long>, n long, cluster int, distance long, total decimal(38,0)")


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, cluster, distance) of every vector that takes part; the centroids; the sum of distances of each cluster."""
    small_batches(vectors.sparkSession)
    rows = quantised(vectors, dims, scale, id_col, vector_col)
    keyed = rows.withColumn("h", F.xxhash64("q"))
    distinct = written(keyed.groupBy("h", "q").agg(F.count("*").alias("n")), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.filter(F.lit(False)).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    done = written(_labelled(distinct, centroids), "assigned")
    inertia = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum("total").alias("s")).collect()}
    n = distinct.agg(F.sum("n")).first()[0]
    heavy = F.col("n") * HEAVY >= n
    few = done.filter(heavy).select("h", "q", "cluster", "distance")
    by_copy = keyed.join(F.broadcast(few), ["h", "q"])
    rest = keyed.join(F.broadcast(few.select("h", "q")), ["h", "q"], "left_anti")
    by_key = rest.join(done.filter(~heavy).select("h", "q", "cluster", "distance"), ["h", "q"])
    out = by_copy.select("id", "cluster", "distance").unionByName(by_key.select("id", "cluster", "distance"))
    return out, centroids, [inertia.get(c, 0) for c in range(len(centroids))]


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster of eight after ten rounds, with the sums of distances and a digest of its centroid."""
    found, centroids, inertia = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        of_cluster([min(i, LARGEST_LONG) for i in inertia] or [0], "bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertia), LARGEST_LONG)).cast("long").alias("inertia"),
        of_cluster(digests or [""], "string").alias("centroid_sha256"),
    )


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The query's rows in SQL: every round compares each vector with each centroid."""
    near = """SELECT id, q, {c}.c AS c, list_sum(list_transform(list_zip(q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {c}
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, {c}.c) = 1"""
    ctes = [
        f"""v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || id)) - 1)::INT AS c, q AS m FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS ({near.format(c=f'c{r}')})")
        ctes.append(
            f"""c{r + 1} AS (SELECT c, coalesce(n, m) AS m FROM c{r} LEFT JOIN (SELECT c, list(s ORDER BY i) AS n FROM
              (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s FROM (SELECT c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) USING (c))"""
        )
    ctes.append(f"z AS ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(ctes)} SELECT id AS vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
      sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (c)"""
