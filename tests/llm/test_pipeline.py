import os
import sys

import corpus_pipeline

from gristmill.llm import langid

sys.path.insert(0, os.path.dirname(__file__))
from brute_pii import base_spans  # noqa: E402
from test_jaccard import classes  # noqa: E402
from test_tokens import check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    (_, language), (_, near), (_, personal), (_, packed) = corpus_pipeline.STAGES

    kept = language(spark, docs, SF).cache()
    assert kept.columns == columns
    scorer = langid.Scorer(langid.fit(docs))
    want = {r["doc_id"] for r in docs.collect() if scorer(r["text"])[0] != "und" and scorer(r["text"])[1] >= 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) >= 0.9 * docs.count()

    single = near(spark, kept, SF).cache()
    assert single.columns == columns
    found = classes([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in single.collect()) == [d for d, n, c in found if c == d]

    clean = personal(spark, single, SF).cache()
    assert clean.columns == columns
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert base_spans(r["text"]) == []
        assert r["n_chars"] == len(r["text"])
        if not base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    check_packing(packed(spark, clean, SF).collect(), {r["doc_id"]: r["text"] for r in clean.collect()})
    assert corpus_pipeline.run(spark, SF).count() == packed(spark, clean, SF).count()


def test_nulls_and_empty_tables_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the end of it", "en", "s", 13), (3, "the end of the day a@b.cd", "en", None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = sorted(r["text"] for r in docs.collect())
        assert got == (["the end of it", "the end of the day <EMAIL>"] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(got)


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    long = " ".join(f"the {w} of" for w in ("way", "day", "men", "sea") * 12_000)
    words = "the cat and the dog went to the house of the old man by the sea " * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int, node long, score double, v string"
    own = ("r", 1, 2, 0.5, "v")
    rows = [(5, words, "en", "s", len(words), *own), (5, words, "en", "s", len(words), *own), (4, words, "en", "t", len(words), *own), (9, long, "en", "s", len(long), *own), (None, "over the hills and far away", "en", "s", 27, *own)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    got = docs.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "9", "None"]
    assert all(tuple(r)[5:] == own for r in got) and {len(r["text"]) for r in got} == {len(words), len(long), 27}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("doc_id = 9").count() > 10
