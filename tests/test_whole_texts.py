"""Queries over whole texts and tables, against plain Python."""

import hashlib
import re
import time
from collections import Counter

import pytest

from gristmill.plans import bench_plans, catalogue

SF = "/root/testdata/sf0.001"


def test_f1_over_whole_texts_and_all_items(spark, tmp_path):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items |= {1000: texts[min(texts)], 1001: "\u2603"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bags = lambda ts: {k: Counter(re.split(r"\s+", t.lower())) for k, t in ts.items()}
    a, b = bags(texts), bags(items)
    f1 = {(k, i): round(2 * (x & y).total() / (x.total() + y.total()), 9) for k, x in a.items() for i, y in b.items()}
    got = {r["doc_id"]: r["f1"] for r in catalogue.queries()["token_f1"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: max(f1[k, i] for i in b) for k in a}, abs=2e-9)
    got = {r["item_id"]: (r["doc_id"], r["f1"]) for r in catalogue.queries()["best_candidate"](spark, str(tmp_path)).collect()}
    best = {i: max(a, key=lambda k: (f1[k, i], -k)) for i in b}
    assert {i: x for i, (x, _) in got.items()} == best
    assert {i: y for i, (_, y) in got.items()} == pytest.approx({i: f1[best[i], i] for i in b}, abs=2e-9)


def test_f1_of_a_long_text_takes_linear_time(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{i % 20_000}" for i in range(200_000))
    texts = [(1, long), (2, None), (3, ""), (4, long.upper()), (5, " a  b"), (6, "w1")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "w1 w2 w3"), (2, None), (3, ""), (4, "\tb a"), (5, long), (5, "zz")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for block in (bench_plans.M.ITEM_BYTES, 500_000):
        monkeypatch.setattr(bench_plans.M, "ITEM_BYTES", block)
        began = time.perf_counter()
        got = {r["doc_id"]: r["f1"] for r in catalogue.queries()["token_f1"](spark, str(tmp_path)).collect()}
        assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 0.5}
        best = {r["item_id"]: (r["doc_id"], r["f1"]) for r in catalogue.queries()["best_candidate"](spark, str(tmp_path)).collect()}
        assert best == {1: (6, 0.5), 2: (1, 0.0), 3: (3, 1.0), 4: (5, 1.0), 5: (1, 1.0)}
        assert time.perf_counter() - began < 40


def test_mask_of_every_token(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    drawn = lambda *k: int(hashlib.sha256("\x1f".join(map(str, k)).encode()).hexdigest()[:13], 16) / 16**13
    p = {k: 0.001 + 0.999 * drawn("p", k) for k in texts}
    want = {k: sum(drawn("m", k, i + 1) < p[k] for i in range(len(t.split(" ")))) for k, t in texts.items()}
    assert {r["doc_id"]: r["masked"] for r in catalogue.queries()["mask_hash"](spark, SF).collect()} == want


def test_links_of_whole_titles(spark, tmp_path, monkeypatch):
    title, seen, plain = "word " * 30 + "end", [], bench_plans.L.best_links
    spark.createDataFrame([(1, f"<title>{title}</title>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(bench_plans.L, "best_links", lambda t, *a: (seen.append(t), plain(t, *a))[1])
    assert bench_plans.text_link(spark, str(tmp_path)).count() == 1
    assert [r["text"] for r in seen[0].collect()] == [title]
