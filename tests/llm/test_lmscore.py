import numpy as np
import pytest

from gristmill.llm import lmscore
from gristmill.llm.lmscore import PAD, SIDE, VOCABULARY, Net, Trainer

SF = "/root/testdata/sf0.001"


def test_probabilities_add_up_to_one():
    net = Net.fresh(3)
    around = np.array([[1], [PAD], [5], [9]])
    p = [np.exp(lmscore.log_probs(net, around, np.array([t]))[0]) for t in range(VOCABULARY)]
    assert sum(p) == pytest.approx(1, abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, VOCABULARY, (2 * SIDE, 40)), rng.integers(0, VOCABULARY, 40)
    net = Net.fresh(1)
    loss = lambda n: -lmscore.log_probs(n, around, target).mean()
    before = loss(net)
    flat = net.flat().astype(np.float64)
    trainer = Trainer(Net.of(flat))
    seen = []
    trainer._apply = lambda k, grad, at=...: seen.append((k, grad, at))
    trainer.step(around, target)
    grad = [np.zeros(s) for s in Net.shapes()]
    for k, g, at in seen:
        grad[k][at] += g
    grad = np.concatenate([g.ravel() for g in grad])
    for i in rng.choice(np.flatnonzero(grad), 25):
        up = flat.copy()
        up[i] += 1e-2
        assert (loss(Net.of(up)) - before) / 1e-2 == pytest.approx(grad[i], rel=0.1, abs=2e-4)


def test_training_beats_frequencies_and_prefers_real_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(2)
    known = lmscore.frequent_words(docs.select("text"))
    net = lmscore.train(docs, known)
    texts = [r["text"] for r in docs.collect()]
    around, target, _ = (np.concatenate(x, axis=-1) for x in zip(*lmscore.contexts(texts, known), strict=True))
    own = lmscore.log_probs(net, around, target).mean()
    n = np.bincount(target, minlength=VOCABULARY) / len(target)
    assert own > np.log(n[target]).mean() + 0.05
    mixed = np.random.default_rng(0).permutation(around.T).T
    assert own > lmscore.log_probs(net, mixed, target).mean() + 0.05


def test_scores_match_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = lmscore.frequent_words(docs.select("text"))
    net = Net.fresh(5)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in lmscore.score(docs, net, known).collect()[:40]:
        ids = [int(x) for _, t, _ in lmscore.contexts([texts[r["doc_id"]]], known) for x in t]
        get = lambda i, ids=ids: ids[i] if 0 <= i < len(ids) else PAD
        around = np.array([[get(i + j) for i in range(len(ids))] for j in (-2, -1, 1, 2)])
        assert r["n_tokens"] == len(texts[r["doc_id"]].split()) == len(ids)
        assert r["log_likelihood"] == pytest.approx(float(lmscore.log_probs(net, around, np.array(ids)).sum()), rel=1e-4)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b a b", 5), (3, "a b a b", 5), (None, "c", 5), (4, "w " * 30_000 + "x" * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    known = lmscore.frequent_words(df.select("text"))
    net = lmscore.train(df, known)
    got = lmscore.score(df, net, known).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 4), (3, 4), (4, 30_001)]
    assert all((r["log_likelihood"], r["mean_log_prob"]) == (0, None) for r in got if not r["n_tokens"])
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 3}) == 1
    empty = df.limit(0)
    known = lmscore.frequent_words(empty.select("text"))
    assert lmscore.score(empty, lmscore.train(empty, known), known).count() == 0
    assert lmscore.op1_lm_score(spark, SF).columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"]


def test_words_that_share_an_id_are_told_apart(spark):
    """Before, a word never seen scored as a word of the corpus with its id."""
    first = " ".join(f"f{i}" for i in range(VOCABULARY - lmscore.HASHED))
    corpus = spark.createDataFrame([(1, f"{first} {first} {first} often often rare"), (2, "more")], "doc_id long, text string")
    counts = lmscore.word_counts(corpus.select("text"))
    known = lmscore.frequent_words(corpus.select("text"), counts)
    place = {w: int(ids[0]) for w in ("often", "rare", "more") for _, ids, _ in lmscore.contexts([w], known)}
    new = next(w for w in map("new{}".format, range(100_000)) if next(lmscore.contexts([w], known))[1][0] == place["rare"])
    tried = spark.createDataFrame([(1, "rare"), (2, new), (3, "rare"), (4, None), (5, "f1"), (None, "rare rare")], "doc_id long, text string")
    net = Net.fresh(1)
    plain = {r["doc_id"]: r["log_likelihood"] for r in lmscore.score(tried, net, known).collect()}
    rows = lmscore.score_words(tried, net, known, counts).collect()
    got = {r["doc_id"]: r["log_likelihood"] for r in rows}
    beside = [(w, {"often": 2, "rare": 1, "more": 1}[w]) for w in place if place[w] == place["rare"]]
    n, t = sum(k for _, k in beside), len(beside)
    assert plain[1] == plain[2]
    assert got[1] - plain[1] == pytest.approx(np.log(1 / (n + t)))
    assert got[2] - plain[2] == pytest.approx(np.log(t / (n + t)) - np.log(2.0**64 / lmscore.HASHED))
    assert got[None] - plain[None] == pytest.approx(2 * np.log(1 / (n + t)))
    assert got[1] == got[3] and got[4] == 0 and got[5] == plain[5]
    assert all(r["mean_log_prob"] == (r["log_likelihood"] / r["n_tokens"] if r["n_tokens"] else None) for r in rows)
