"""Connected components by alternating stars; edges and components stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): longs. Returns (node, component) for every node of an edge; component: its smallest node.

    A large star hangs the larger neighbours of every node on the smallest around it, a small star the smaller
    ones and itself; in turn they reach stars in a number of rounds logarithmic in the nodes. Each step is a
    minimum by key and an equi-join, so a node with many edges is pre-aggregated, and split by a skewed join.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        last, e = e, written(small.filter("u <> v").distinct(), "edges")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()


def dealt_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows under (key, _i, _j), which every two blocks of a key's rows share, with the row's own block _own.

    size: the key's number of rows. Its rows are dealt into blocks of about ``block`` by a hash of the node, so that a long list is
    many tasks' work.
    """
    k = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("node"), k).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), k - 1)))
    dealt = dealt.select(*rows.columns, "_own", F.least("_own", "_to").alias("_i"), F.greatest("_own", "_to").alias("_j"))
    return dealt.repartition(key, "_i", "_j")
