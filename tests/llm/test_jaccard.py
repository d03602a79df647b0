import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import hashing, jaccard
from gristmill.llm.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    """{doc: (size, component)} by comparing all pairs."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted((d, len(s), top(d)) for d, s in sets)


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.choice([4, 9, 12, 40, 130, 300]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 4]))))
    chain = rng.choices(vocabulary, k=200)
    for _ in range(8):
        chain = changed(rng, chain, 3)
        rows.append(" ".join(chain))
    for i in range(30):  # a passage that many share
        rows.append(" ".join(vocabulary + rng.choices(vocabulary, k=i % 7)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,num,frequent,block", [(3, 90, 4, 1024), (5, 80, 1, 3), (3, 90, 10**9, 1024)])
def test_no_link_is_lost(spark, monkeypatch, k, num, frequent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FREQUENT_LOAD", 0)
    rows = corpus(k * 7 + num)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.similarity_classes(df, k, num, 100)) == classes(rows, k, num, 100)


def test_long_words_have_hashes_of_their_own(monkeypatch):
    """Thue-Morse words and their complements, which polynomials modulo a power of two can't tell apart."""
    word, pairs = "a", []
    while len(word) < 4096:
        other = word.translate(str.maketrans("ab", "ba"))
        pairs.append((word, other))
        word += other
    for one, two in pairs:
        found = [next(hashing.words_of([t]))[0].tolist() for t in (one, two)]
        assert found[0] != found[1]


def test_words_of_texts_in_windows(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB \t\n\x0b\x0c\ré文") for _ in range(rng.randrange(300))) for _ in range(60)] + [None, "x" * 70, " "]
    whole = [w[b[i] : b[i + 1]].tolist() for w, b, n in hashing.words_of(texts) for i in range(n)]
    assert [len(w) for w in whole] == [len(WORD.findall(t or "")) for t in texts]
    monkeypatch.setattr(hashing, "GROUP_BYTES", 16)
    assert [w[b[i] : b[i + 1]].tolist() for w, b, n in hashing.words_of(texts) for i in range(n)] == whole


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(jaccard.op2_jaccard_join(spark, sf)) == classes(rows, 3, 90, 100)


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_similar_sets_share_an_entry(k, num):
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(2, 400))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate((x[int(rng.integers(0, n // 10 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 2)), dtype=np.uint64)))
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        share = rng.choice([0, 50, 100])  # per cent of frequent shingles
        count = lambda t, s=share: np.where(t % np.uint64(100) < s, 1000, t % np.uint64(97)).astype(np.int64)
        if 100 * common >= num * (len(x) + len(y) - common) and not np.array_equal(x, y):
            a, b = (jaccard.entries(t, count(t), 500, num, 100) for t in (x, y))
            assert len(np.intersect1d(a, b)), (trial, n)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one\ttwo "), (6, "one two three"), (7, "É b c d"), (8, "é b c d"),
        (9, "one two"), (9, "one two"), (10, "one two"), (10, "a b c d e f g"), (11, "a b c d e f g"), (None, "a b c d e f g"), (12, "x" * 200_000 + " y z"), (13, "w " * 50_000),
    ]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string")
    found = {}
    for r in jaccard.similarity_classes(df, 3, 90, 100).collect():
        found.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert found[1] == [(0, 1)] and found[2] == [(0, 2)] and found[3] == [(0, 3)]
    assert found[5] == [(1, 4)] and found[9] == [(1, 4)] * 2 and found[6] == [(1, 6)]
    assert found[7] == [(2, 7)] and found[8] == [(2, 8)]
    assert sorted(found[10]) == [(1, 4), (5, 4)] and found[11] == [(5, 4)] and found[13] == [(1, 13)]
    kept = jaccard.keep_one(df, 3, 90, 100)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 12, 13]
    assert jaccard.similarity_classes(df.limit(0)).count() == 0


def test_shingle_hashes_follow_the_words():
    texts = ["A b\tC d", "a B c D", "b c d", "", "c", None, "a  b c é", "x" * 3000 + " a b"]
    seen = {}
    for words, bounds, n in hashing.words_of(texts):
        for i in range(n):
            own = words[bounds[i] : bounds[i + 1]]
            plain = WORD.findall((texts[i] or "").translate(LOWER))
            assert len(own) == len(plain)
            for h, w in zip(own.tolist(), plain, strict=True):
                assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got(jaccard.op2_jaccard_join(spark, sf)) == sorted(con.execute(jaccard.OP2_SQL).fetchall())


def marked(rng, n):
    tokens = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    return tokens, [int(x) for x in jaccard.parities(tokens)]


def test_the_test_of_parities_is_short_code(spark):
    """A condition of all words written out is longer than what the JVM compiles."""
    p, q = F.array(*(F.col("id") + i for i in range(jaccard.PARITY_WORDS))), F.array(*(F.col("id") * i for i in range(jaccard.PARITY_WORDS)))
    rows = spark.range(50).select("id", p.alias("p"), q.alias("q"), (F.col("id") * 41 + 1).alias("m"), (F.col("id") * 40 + 9).alias("n"))
    found = rows.select("*", jaccard.may_link(F.col("p"), F.col("m"), F.col("q"), F.col("n"), 80, 100).alias("may")).localCheckpoint()
    want = lambda r: min(r.m, r.n) * 100 >= 80 * max(r.m, r.n) and sum((x ^ y).bit_count() for x, y in zip(r.p, r.q)) * 180 <= (r.m + r.n) * 20
    got = [(r.may, want(r)) for r in found.collect()]
    assert all(a == b for a, b in got) and {a for a, _ in got} == {True, False}
    condition = rows.filter(jaccard.may_link(F.col("p"), F.col("m"), F.col("q"), F.col("n"), 80, 100))._jdf.queryExecution().analyzed().toString()
    assert 0 < condition.count("bit_count(") <= 12


@pytest.mark.parametrize("block", [5, 1024])
def test_close_pairs_equal_all_pairs(spark, block):
    rng, rows, sets = np.random.default_rng(5), [], {}
    for entry, size in ((1, 2), (2, 40), (3, 1), (4, 17)):
        base, _ = marked(rng, 300)
        for i in range(size):
            node = entry * 1000 + i
            tokens = np.union1d(base[rng.integers(0, 30) :], marked(rng, rng.integers(1, 20))[0]) if i % 3 else marked(rng, 300)[0]
            sets[node] = (entry, node % 7, len(tokens), jaccard.parities(tokens))
            rows.append((entry, node, node % 7, len(tokens), [int(x) for x in sets[node][3]], size))
    df = spark.createDataFrame(rows, "entry long, node long, component long, n long, parity array<long>, m long").repartition(3)
    apart = lambda p, q: int(np.bitwise_count((p ^ q).view(np.uint64)).sum())
    want = sorted(
        (a, b)
        for a, (e, c, m, p) in sets.items()
        for b, (f, d, n, q) in sets.items()
        if a < b and e == f and c != d and min(m, n) * 100 >= 90 * max(m, n) and apart(p, q) * 190 <= (m + n) * 10
    )
    assert want and sorted((r.a, r.b) for r in jaccard.close_pairs(df, 90, 100, block).collect()) == want
