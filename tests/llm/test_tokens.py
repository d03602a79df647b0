import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import bytebpe, packing, tokenbin

ODD = [
    None,
    "",
    "   ",
    "a \n\n b\t\tc \n",
    "It's we'll 12345 naïve façade … <|endoftext|> x<|endoftext|>y",
    "nbsp\xa0 \xa0 here\x1c\x1d!　  x \x0b\x0cz  ",
    "😀😀 é ̸= Straße ΑΣ İ",
    "x" * 5000 + " " + "ab" * 3000 + "!?" * 2000,
    "word " * 3000,
    "word " * 3000,
]


def texts_df(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bytebpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.loaded(public_tokenizers.path(bytebpe.VOCABULARY), public_tokenizers.PATTERN)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_equals_the_library_on_odd_texts(tik, own):
    bpe, chunks = own
    for text, ids in zip(ODD, chunks.texts(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeiorstnhl ABé\n\t'0129\xa0!?\x1cß字"), max_size=60))
def test_bpe_equals_the_library_on_any_text(tik, own, text):
    bpe, chunks = own
    (ids,) = chunks.texts([text])
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abcsthe ABé\n\t'01\xa0!\x1c \x85<|>́字"), max_size=50))
def test_chunks_equal_whole_texts(name, byte_level, text):
    from gristmill.llm.chunking import tokenizer_encoder

    t = _kept.setdefault(name, tokenizer(name))
    (ids,) = tokenizer_encoder(public_tokenizers.path(name), byte_level).texts([text])
    assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_many_chunks_at_once_equal_the_library(name, byte_level):
    """Letters whose case or composed form has another length, wide blanks and marks, thousands of chunks a call."""
    from gristmill.llm.chunking import tokenizer_encoder

    rng = random.Random(5)
    odd = "abcXYZ'.19 \t\n\u0130\u3000\u0301\u0300\u2126\u00c5\ufb01\u1e9e\u03a3\x85\xa0\u2028\x0b\x1c\u200b\ufeff\u0345\uac00\u1100\u1161\u0958\U0001f600\u6587"
    texts = ["".join(rng.choice(odd) if rng.random() < 0.9 else chr(rng.randrange(1, 0xD800)) for _ in range(rng.choice([5, 20, 120]))) for _ in range(4000)]
    t = tokenizer(name)
    got = list(tokenizer_encoder(public_tokenizers.path(name), byte_level).texts(texts))
    assert got == [raw(t.encode(x, add_special_tokens=False).ids) for x in texts]


_kept = {}


def test_bpe_query(spark, tik):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bytebpe.op5_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_operators_round_trip(spark):
    path = public_tokenizers.path(bytebpe.VOCABULARY)
    tokens = bytebpe.encode(texts_df(spark), path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bytebpe.decode(tokens, path, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bytebpe.encode(texts_df(spark).limit(0), path, public_tokenizers.PATTERN).count() == 0


def expected_files(texts):
    t, start, out = tokenizer(tokenbin.VOCABULARY), 0, {}
    for doc, text in sorted(texts.items()):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out[doc] = (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    return out


def test_token_files_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.op4_token_files(spark, sf).collect()}
    assert got == expected_files(texts)


def test_token_files_of_odd_texts(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    tokenbin.write(texts_df(spark).repartition(3), root, public_tokenizers.path(tokenbin.VOCABULARY))
    got = tokenbin.read(spark, root, with_ids=True).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == expected_files(dict(enumerate(ODD)))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    with pytest.raises(OSError):
        tokenbin.write(texts_df(spark), root, public_tokenizers.path(tokenbin.VOCABULARY))


def test_token_files_null_ids_repeats_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (1, None)], "doc_id long, text string")
    tokenbin.write(df, f"{tmp_path}/a", public_tokenizers.path(tokenbin.VOCABULARY))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenbin.read(spark, f"{tmp_path}/a").collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 3, 2), (5, 3, 2)]
    tokenbin.write(df.limit(0), f"{tmp_path}/b", public_tokenizers.path(tokenbin.VOCABULARY))
    assert tokenbin.read(spark, f"{tmp_path}/b").count() == 0


def check_packing(rows, texts, capacity=2048):
    t = tokenizer(packing.VOCABULARY)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, own in by_doc.items():
        ids = t.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == capacity or k == 0
            assert r["ids_crc32"] == zlib.crc32(raw(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(packing.op9_packing(spark, sf).collect(), texts)
    assert used <= least + max(1, least // 50)


def test_packing_of_odd_texts(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    check_packing(packing.pack(packing.cut(texts_df(spark).repartition(3), path)).collect(), dict(enumerate(ODD)))
    assert packing.pack(packing.cut(texts_df(spark).limit(0), path)).count() == 0


def best(counts, capacity):
    """The fewest bins, by search over all ways."""
    items = sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)
    best_n = [len(items)]

    def go(i, bins):
        if len(bins) >= best_n[0]:
            return
        if i == len(items):
            best_n[0] = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values()):
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best_n[0]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=5))
def test_plan_uses_every_piece_and_reduction_keeps_the_optimum(counts):
    patterns = packing.plan(counts, 20)
    used = {}
    for content, n in patterns:
        assert sum(content) <= 20 and n > 0
        for x in content:
            used[x] = used.get(x, 0) + n
    assert used == counts
    stock = packing._Stock(counts)
    fixed = packing.reduce_by_dominance(stock, 20)
    assert sum(n for _, n in fixed) + best(stock.n, 20) == best(counts, 20)
