"""Ranked search against scoring every document, early ends, and odd input."""

import math
import os
import re

import duckdb
import numpy as np
import pytest

from gristmill.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, queries, k=20):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(i, split(t)) for i, t in docs if i is not None]
    n, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    texts = {}
    for q, t in queries:
        if q is not None and t is not None:
            texts[q] = min(texts.get(q, t), t, key=lambda x: x.encode())
    out = []
    for q, t in texts.items():
        scored = []
        for i, d in docs:
            score = 0
            for term in split(t):
                df, tf = sum(term in x for _, x in docs), d.count(term)
                if tf:
                    m = 100 - 25 + (25 * len(d) * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, docs, queries, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(map(tuple, X.ranked(d, q, k).collect()))


def made(n, seed=3, words=120):
    rng = np.random.default_rng(seed)
    pick = lambda size: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, size), words))
    return [(i, pick(rng.integers(0, 60))) for i in range(n)], [(i, pick(12)) for i in range(9)]


def test_equals_scoring_all(spark):
    docs, queries = made(300)
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    assert run(spark, docs, queries) == plain(docs, queries)
    assert run(spark, docs, queries, 3) == plain(docs, queries, 3)


def test_blocks_of_documents_and_queries(spark, monkeypatch):
    docs, queries = made(200, 4)
    monkeypatch.setattr(X, "QUERY_BYTES", 100)
    assert run(spark, docs, queries, 5) == plain(docs, queries, 5)
    ids = {t: i for i, t in enumerate(sorted({t for _, q in queries for t in X.terms_of(q.encode())}))}
    q = X.Query(np.arange(len(ids)), np.ones(len(ids), np.int64))
    whole, parts = X.Best(5), X.Best(5)
    blocks = [X.Block(len(ids)) for _ in range(4)]
    for at, (i, t) in enumerate(docs):
        terms = X.terms_of(t.encode())
        own = sorted((ids[x], terms.count(x)) for x in set(terms) & ids.keys())
        for b in (blocks[0], blocks[1 + at % 3]):
            b.add(i, 100, own)
    for b, best in zip(blocks, (whole, parts, parts, parts), strict=True):
        b.close()
        b.search(q, best)
    assert whole.ids.tolist() == parts.ids.tolist() and whole.scores.tolist() == parts.scores.tolist()


def test_walk_ends_early():
    block = X.Block(2)
    for i in range(10_000):
        block.add(i, 100, [(0, 10_000 - i), (1, 10_000 - i)])
    block.close()
    best = X.Best(3)
    met = block.search(X.Query(np.array([0, 1]), np.array([5, 7])), best)
    assert best.ids.tolist() == [0, 1, 2] and met < 200


def test_ties_at_the_last_place_take_the_smaller_id():
    block = X.Block(1)
    for i in range(5000, 0, -1):
        block.add(i, 100, [(0, 1)])
    block.close()
    best = X.Best(3)
    block.search(X.Query(np.array([0]), np.array([5])), best)
    assert best.ids.tolist() == [1, 2, 3]


def test_odd_input(spark):
    docs = [(1, None), (2, ""), (3, "-- !!"), (4, "ÄB äb Äb x1 X1"), (4, "ÄB äb Äb x1 X1"), (None, "x1 x1"), (5, "x1 " * 50_000), (6, "日本 x1 y"), (7, "a\x00b\x7fc")]
    queries = [(1, "X1 äb"), (1, "zz"), (2, None), (3, ""), (None, "x1"), (4, "absent"), (5, "日本 a b a"), (6, "x1 y ÄB")]
    assert run(spark, docs, queries) == plain(docs, queries)
    assert run(spark, [], queries) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], queries) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "q")], "doc_id long, text string, id int, raw string")
    q = spark.createDataFrame([(1, "a", 5, "q")], "item_id long, text string, q int, score string")
    got = X.ranked(d, q)
    assert got.columns == ["query_id", "rank", "doc_id", "score"] and [tuple(r) for r in got.collect()] == plain([(1, "a b")], [(1, "a")])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    rel = duck.execute(X.OP13_SQL)
    names = [c[0] for c in rel.description]
    got = X.op13_ranked_search(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and len(got) > 100
