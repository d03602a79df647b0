import os
import sys

import pytest
from pyspark.sql import functions as F

from gristmill.llm import pii

sys.path.insert(0, os.path.dirname(__file__))
from brute_pii import base_spans, digest  # noqa: E402

ODD = [
    None,
    "",
    "plain words only",
    "a@b.c_d@e.fr x@y.z. me@host then a.b+c@sub-d.example.org!",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111",
    "+1 (724) 555-7058 +49.30.123456 +1-2 ++33 1 23 45 67 89 ((",
    "é😀 4111111111111111 ü \u0001 me@x.yz \u0001 +4930123456789",
    "1 2 3 4 5 6 7 8 9 " * 4000,
    "7" * 30000 + " " + "a" * 30000 + " " + "1." * 9000,
    "iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE89 3704 0044 0532 0130 01",
    "me@x.yz " * 300,
    "ssn 078-05-1120, 078-05-1120 ssn 000-05-1120 and 219-09-9999; the social security number 219-09-99991 219_09-9999",
    "tel 030 123 4567 then " + "x" * 40 + " 030 123 4567, fax (017) 555-7713 or Telefon 089)-555.1234_",
    'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" ' + "y" * 50 + " 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde API_KEY: reundindtitolaiauxx then Secret=abcdefgh12345678==",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_base_spans_match_brute_force(odd):
    got = {r["doc_id"]: r for r in pii.detect(odd).collect()}
    for i, text in enumerate(ODD):
        spans = [(s["kind"], s["start"], s["stop"]) for s in got[i]["spans"] if s["kind"] in pii.KINDS[:4]]
        assert spans == base_spans(text), (i, spans[:5])


def test_account_numbers_and_context(odd):
    got = next(r for r in pii.detect(odd).collect() if r["doc_id"] == 10)
    accounts = [s for s in got["spans"] if s["kind"] == "iban"]
    assert [s["match"] for s in accounts] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s["score"] for s in accounts] == [100, 100]


def test_context_decides_kinds_below_the_threshold(odd):
    got = {r["doc_id"]: r for r in pii.detect(odd).collect()}
    assert [(s["kind"], s["start"], s["score"]) for s in got[12]["spans"]] == [("ssn", 4, 65), ("ssn", 17, 65), ("ssn", 49, 65)]
    assert [(s["kind"], s["match"], s["score"]) for s in got[13]["spans"]] == [("local", m, 65) for m in ("030 123 4567", "017) 555-7713", "089)-555.1234")]
    found = [("secret", m, 60) for m in ("2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "abcdefgh12345678==")]
    assert [(s["kind"], s["match"], s["score"]) for s in got[14]["spans"]] == found
    every = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(odd, min_score=0).collect()}
    assert [len(every[i]) for i in (12, 13, 14)] == [3, 4, 3]


def test_redact_keeps_columns_and_replaces_every_span(spark):
    rows = [(1, "call +1 (724) 555-7058 or a@b.cd", 32, "s"), (2, None, None, "s"), (3, "nothing", 7, None), (1, "é a@b.cd", 8, "row")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.orderBy("doc_id", "text").collect()] == [
        (1, "call <PHONE> or <EMAIL>", 23, "s"),
        (1, "é <EMAIL>", 9, "row"),
        (2, None, None, "s"),
        (3, "nothing", 7, None),
    ]
    assert pii.detect(got).filter(F.size("spans") > 0).count() == 0


def test_query_matches_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op7_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(want)
        assert r["n_card"] == sum(k == "card" for k, _, _ in want)


def test_many_spans_in_one_text_take_linear_time(spark):
    import time

    text = "é me@x.yz 1.2.3.4, " * 50_000 + "write to a@b.cd"
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    got = pii.detect(df).collect()[0]["spans"]
    assert [(s["kind"], s["start"], s["stop"]) for s in got] == base_spans(text) and len(got) == 100_001
    assert pii.redact(df).collect()[0]["text"] == "é <EMAIL> <IP>, " * 50_000 + "write to <EMAIL>"
    assert time.perf_counter() - began < 60


def test_redacted_texts_equal_a_plain_loop(spark):
    import random

    r = random.Random(4)
    bits = ["a@b.cd", "4111 1111 1111 1111", " ", "é😀", "+49 30 1234567", "1.2.3.4", "x" * 130, "\n", "call 030 123 4567", "@", "1.2.3.4@b.cd", "\u0001"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x["doc_id"]: x["spans"] for x in pii.detect(df).collect()}
    for x in pii.redact(df).collect():
        out, at, text = [], 0, texts[x["doc_id"]]
        for s in spans[x["doc_id"]]:
            assert s["match"].replace("\u0002", "\u0001") == text[s["start"] : s["stop"]]
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = max(at, s["stop"])
        assert x["text"] == "".join(out) + text[at:]


def test_empty_table(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark, tmp_path):
    import duckdb

    texts = [t for t in ODD if t is None or len(t) < 5000] + ["x_GB82WEST12345698765432 1.2.3.0004 5.6.7.999999999999999999999999999999999999999999"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        con = duckdb.connect()
        path = f"{sf}/documents.parquet/*.parquet" if sf == str(tmp_path) else f"{sf}/documents.parquet"
        con.execute(f"create view documents as select * from read_parquet('{path}')")
        got = sorted(map(tuple, pii.op7_pii(spark, sf).collect()))
        rel = con.execute(pii.oracle_sql())
        assert [c[0] for c in rel.description] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "scores"]
        assert got == sorted(rel.fetchall())
