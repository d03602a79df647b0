import math
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from gristmill.llm import langid
from gristmill.llm.chunking import tokenizer_encoder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op3_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and r["lang_pred"] != "und":
            total += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert right / total > 0.95, right / total


def test_word_first_then_shorter_grams():
    model = langid.Model(["a", "b"], ["yes"], np.array([[-1.0, -3.0]]), [" q", "z"], np.array([[-2.0, -1.0], [-1.0, -2.0]]))
    s = langid.Scorer(model)
    assert s("Yes YES")[0] == "a"
    assert s("qz")[0] == "b"  # the longer n-gram decides
    assert s("az")[0] == "a"
    assert s("kk")[1] == 0.5


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ² !!", "en"), (4, "the end of the word", "en"), (5, "der hund und das", "de"), (5, "der hund und das", "de"), (None, "der die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    assert langid.predict(df.limit(0), model).count() == 0
    nothing = langid.fit(df.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    long = spark.createDataFrame([(1, "the " * 200_000 + "x" * 100_000)], "doc_id long, text string")
    assert langid.predict(long, model).first()["lang_pred"] == "en"


def test_a_long_run_is_one_word(spark):
    """Only the far end of a run of more than 64 letters tells the language."""
    tail = "x" * 80
    rows = [(1, "ab" + tail + "q", "a"), (2, "ab" + tail + "z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    test = spark.createDataFrame([(3, "cd" + tail + "qq"), (4, "cd" + tail + "zz"), (5, "ab" + tail + "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(test, model).collect()} == {3: "a", 4: "b", 5: "b"}


def brute(rows, texts):
    """(language, share) of texts by the rule of the docstring, one word at a time."""
    words, parts = {}, {}
    for text, lang in rows:
        for w in langid.WORD.findall((text or "").lower()):
            words.setdefault(lang, Counter())[w] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    parts.setdefault(lang, Counter())[f" {w} "[i : i + n]] += 1
    langs = sorted(words)

    def logs(table):
        kinds = set().union(*table.values())
        return {t: [math.log(table[x][t] + 0.5) - math.log(table[x].total() + 0.5 * len(kinds) + 1) for x in langs] for t in kinds}

    words, parts = logs(words), logs(parts)

    def score(w):
        if w in words:
            return words[w]
        for n in range(4, 0, -1):
            found = [parts[g] for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in parts]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    for text in texts:
        own = langid.WORD.findall((text or "").lower())
        if not any(c.isalpha() for w in own for c in w):
            yield "und", 0.0
            continue
        total = [sum(x) / math.sqrt(len(own)) for x in zip(*map(score, own), strict=True)]
        share = [math.exp(x - max(total)) for x in total]
        yield langs[total.index(max(total))], 1 / sum(share)


def test_query_equals_the_rule(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = [(r["text"], r["lang"]) for r in docs if r["lang"] is not None and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = dict(zip((r["doc_id"] for r in docs), brute(learned, [r["text"] for r in docs]), strict=True))
    got = langid.op3_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-6


def test_ties_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "same words", "b", 1.5, "x"), (2, "same words", "a", 2.5, "y")], "doc_id long, text string, lang string, score double, kept string")
    model = langid.fit(df)
    got = langid.predict(df.union(df), model, keep=("doc_id", "kept", "score")).collect()
    assert [(r["doc_id"], r["kept"], r["lang_pred"], r["score"]) for r in sorted(got)] == [(1, "x", "a", 0.5)] * 2 + [(2, "y", "a", 0.5)] * 2
    assert langid.keep_identified(df, model).columns == df.columns


def test_a_worker_drops_the_cache_of_an_earlier_step():
    """Spark hands a worker on; with the chunks of a tokenizer beside the language model it would hold the tables of two steps."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenizer_encoder(path, True)
    assert tokenizer_encoder(path, True) is encoder and list(encoder.texts(["one two"]))
    gone = weakref.ref(encoder)
    del encoder
    model = langid.Model(["aa", "bb"], ["one"], np.array([[0.0, -1.0]]), ["o"], np.array([[-1.0, 0.0]]))
    broadcast = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    docs = SimpleNamespace(columns=["text"], schema=None, sparkSession=SimpleNamespace(sparkContext=broadcast), mapInArrow=lambda run, schema: run)
    run = langid.keep_identified(docs, model)
    (out,) = run(iter([pa.RecordBatch.from_pydict({"text": ["one", None]})]))
    assert out.column(0).to_pylist() == ["one"] and gone() is None
