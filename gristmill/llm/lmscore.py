"""Masked pseudo-likelihood: a window network predicts every token from both sides.

Tokens are words; the most frequent of the corpus have ids of their own, the others share ids by hash, so every
word is a token. The network adds up a vector for each of the two words on either side (by their place), applies
tanh, and gives a distribution over classes of words and one over the words of a class; the product is a proper
distribution over ids. It is trained in numpy on every token of every document: partitions start a round from
common weights, run Adagrad over their tokens, and their weights are averaged by tokens. Round r of R trains on
the documents whose hash is r modulo R, so that the rounds together see each document once. A token's probability is
that of its id given its neighbours, times, where words share the id, that of the word among these: from the counts of
all words of the corpus (Witten-Bell; what is left for unseen words is even over all hashes). The counts grow with the
corpus and stay distributed. A document's score is the sum of the log-probabilities of all its tokens.

Defined results for odd input: a null or empty text has no tokens, sum 0 and a null mean; equal texts have equal
scores; repeated rows stay repeated and count as often in training; very long texts are taken whole, in batches of
tokens; an empty table gives an empty table; other columns are ignored. The weights are averages over partitions, so
scores depend a little on how the input is dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import hashing
from gristmill.llm._shared import pieces, table, written

SIDE, HIDDEN, CLASSES, PER_CLASS, HASHED = 2, 16, 24, 24, 128
VOCABULARY = CLASSES * PER_CLASS
PAD = VOCABULARY
ROUNDS, BATCH, RATE = 2, 8192, 0.1


@dataclass
class Net:
    """context: (2 * SIDE, VOCABULARY + 1, HIDDEN); to classes (HIDDEN, CLASSES); to words (CLASSES, HIDDEN, PER_CLASS)."""

    context: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.bias, self.classes, self.class_bias, self.words, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(2 * SIDE, VOCABULARY + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, PER_CLASS), (CLASSES, PER_CLASS)]

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        parts, at = [], 0
        for shape in cls.shapes():
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return cls(*parts)

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        return cls(*(rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in cls.shapes()))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _by_id(ids: np.ndarray) -> np.ndarray:
    """The order that sorts small ids and keeps ties; of 16 bits, numpy sorts by radix."""
    return np.argsort(ids.astype(np.int16), kind="stable")


def log_probs(net: Net, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its neighbours; around: (2 * SIDE, n) ids."""
    cls = target // PER_CLASS
    order = _by_id(cls)
    around, cls, word = around[:, order], cls[order], target[order] % PER_CLASS
    h = np.tanh(sum(net.context[j][around[j]] for j in range(2 * SIDE)) + net.bias)
    logs = _log_softmax(h @ net.classes + net.class_bias)[np.arange(len(cls)), cls]
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        lo, hi = bounds[c], bounds[c + 1]
        if lo < hi:
            logs[lo:hi] += _log_softmax(h[lo:hi] @ net.words[c] + net.word_bias[c])[np.arange(hi - lo), word[lo:hi]]
    out = np.empty_like(logs)
    out[order] = logs
    return out


class Trainer:
    """Adagrad on batches of tokens."""

    def __init__(self, net: Net):
        self.net = net
        self.seen = [np.full(p.shape, 1e-6, np.float32) for p in net.parts()]

    def _apply(self, k: int, grad: np.ndarray, at=...) -> None:
        p = self.net.parts()[k]
        self.seen[k][at] += grad * grad
        p[at] -= RATE * grad / np.sqrt(self.seen[k][at])

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        cls = target // PER_CLASS
        order = _by_id(cls)
        around, cls, word = around[:, order], cls[order], target[order] % PER_CLASS
        h = np.tanh(sum(net.context[j][around[j]] for j in range(2 * SIDE)) + net.bias)
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
        d = _softmax(h @ net.classes + net.class_bias)
        d[np.arange(n), cls] -= 1
        d /= n
        dh = d @ net.classes.T
        g_classes, g_class_bias = h.T @ d, d.sum(axis=0)
        for c in range(CLASSES):
            lo, hi = bounds[c], bounds[c + 1]
            if lo < hi:
                dw = _softmax(h[lo:hi] @ net.words[c] + net.word_bias[c])
                dw[np.arange(hi - lo), word[lo:hi]] -= 1
                dw /= n
                dh[lo:hi] += dw @ net.words[c].T
                self._apply(4, h[lo:hi].T @ dw, c)
                self._apply(5, dw.sum(axis=0), c)
        self._apply(2, g_classes)
        self._apply(3, g_class_bias)
        dh *= 1 - h * h
        self._apply(1, dh.sum(axis=0))
        for j in range(2 * SIDE):
            by = _by_id(around[j])
            ids = around[j][by]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            self._apply(0, np.add.reduceat(dh[by], first, axis=0), (j, ids[first]))


def token_ids(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ids of word hashes. known: sorted pairs (hash, id) of the frequent words, as two rows."""
    out = (VOCABULARY - HASHED + (words >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)
    if known.shape[1]:
        at = np.minimum(np.searchsorted(known[0], words), known.shape[1] - 1)
        hit = known[0][at] == words
        out[hit] = known[1][at[hit]].astype(np.int64)
    return out


def contexts(texts: list[str | None], known: np.ndarray):
    """For groups of texts: neighbours (2 * SIDE, n), targets, the texts' bounds in them."""
    for words, bounds, n in hashing.words_of(texts):
        ids, lengths = token_ids(words, known), np.diff(bounds)
        padded = np.full(len(ids) + SIDE * (n + 1), PAD)
        at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(n), lengths) + 1)
        padded[at] = ids
        yield np.stack([padded[at + j] for j in (*range(-SIDE, 0), *range(1, SIDE + 1))]), ids, bounds


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its hash), n: every word of all texts (the one column)."""

    def count(batches):
        for b in pieces(batches):
            for words, _, _ in hashing.words_of(b.column(0).to_pylist()):
                word, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """The most frequent words of all texts (the one column): hashes and ids, by hash. counts: of word_counts(), if known."""
    counts = word_counts(texts) if counts is None else counts
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - HASHED).collect()]
    words = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(words)
    return np.stack([words[order], order.astype(np.uint64)])


def train(docs: DataFrame, known: np.ndarray, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Net:
    """Weights after all rounds over all documents."""
    spark, net = docs.sparkSession, Net.fresh()
    rows = docs.select(F.pmod(F.xxhash64(docs[id_col], F.length(docs[text_col])), F.lit(rounds)).alias("round"), docs[text_col].alias("text"))
    words = spark.sparkContext.broadcast(known)
    schema = "part int, n long, weights binary"
    for r in range(rounds):
        start = spark.sparkContext.broadcast(net.flat())

        def learn(batches, start=start):
            from pyspark import TaskContext

            trainer, total = Trainer(Net.of(start.value)), 0
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for b in pieces(batches):
                for around, target, _ in contexts(b.column(0).to_pylist(), words.value):
                    order = rng.permutation(len(target))
                    for lo in range(0, len(order), BATCH):
                        at = order[lo : lo + BATCH]
                        trainer.step(around[:, at], target[at])
                    total += len(target)
            if total:
                yield pa.RecordBatch.from_pylist(
                    [{"part": TaskContext.get().partitionId() % 32, "n": total, "weights": (trainer.net.flat().astype(np.float64) * total).tobytes()}],
                    pa.schema([("part", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())]),
                )

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("weights"))
            return pa.table({"part": t.column("part")[:1], "n": pa.array([sum(t.column("n").to_pylist())]), "weights": pa.array([total.tobytes()], pa.binary())})

        trained = rows.filter(F.col("round") == r).select("text").mapInArrow(learn, schema)
        sums = trained.groupBy("part").applyInArrow(add, schema).collect()  # 32 sums at most
        total = sum(s["n"] for s in sums)
        if total:
            net = Net.of(sum(np.frombuffer(s["weights"], np.float64) for s in sums) / total)
    return net


def score(docs: DataFrame, net: Net, known: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (sum), mean_log_prob."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((net.flat(), known))

    def run(batches):
        flat, words = shared.value
        own = Net.of(flat)
        for b in pieces(batches):
            ns, sums = [], []
            for around, target, bounds in contexts(b.column(1).to_pylist(), words):
                logs = [log_probs(own, around[:, i : i + BATCH], target[i : i + BATCH]) for i in range(0, len(target), BATCH)]
                logs = np.concatenate(logs).astype(np.float64) if logs else np.zeros(0)
                ns += np.diff(bounds).tolist()
                sums += [float(logs[x:y].sum()) for x, y in zip(bounds, bounds[1:], strict=False)]
            mean = [s / n if n else None for s, n in zip(sums, ns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())],
                ["id", "n_tokens", "log_likelihood", "mean_log_prob"],
            )

    out = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, n_tokens long, log_likelihood double, mean_log_prob double")
    return out.withColumnRenamed("id", id_col)


def within_ids(texts: DataFrame, known: np.ndarray, counts: DataFrame) -> DataFrame:
    """key, within: the log-probabilities, summed over a text, of its words among those that share their ids.

    texts: key (equal for equal texts), text. Of the words of an id, N tokens of T kinds, one that was seen n times has
    n / (N + T); T / (N + T) is for the unseen, over the 2^64 / HASHED hashes of an id.
    """
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast(known)  # of fixed size

    def rare(batches):
        for b in pieces(batches):
            owner, word, n, at = [], [], [], 0
            for hashes, bounds, m in hashing.words_of(b.column(1).to_pylist()):
                shared = token_ids(hashes, words.value) >= VOCABULARY - HASHED
                for i in range(m):
                    own, k = np.unique(hashes[bounds[i] : bounds[i + 1]][shared[bounds[i] : bounds[i + 1]]], return_counts=True)
                    owner.append(np.full(len(own), at + i))
                    word.append(own.view(np.int64))
                    n.append(k)
                at += m
            if owner:
                take = pa.array(np.concatenate(owner).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.concatenate(word)), pa.array(np.concatenate(n).astype(np.int32))], ["key", "word", "k"])

    place = F.shiftrightunsigned("word", 40) % HASHED
    frequent = spark.createDataFrame([(w,) for w in known[0].view(np.int64).tolist()], "word long")
    sums = counts.join(F.broadcast(frequent), "word", "left_anti").groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect()
    seen, kinds = [0] * HASHED, [0] * HASHED
    for row in sums:  # HASHED rows at most
        seen[row["place"]], kinds[row["place"]] = row["n"], row["t"]
    total = F.array(*(F.lit(float(np.log(max(n + t, 1)))) for n, t in zip(seen, kinds, strict=True)))
    unseen = F.array(*(F.lit(float(np.log(t / (n + t)) if t else 0.0) - float(np.log(2.0**64 / HASHED))) for n, t in zip(seen, kinds, strict=True)))
    at = place.cast("int")
    log_prob = F.coalesce("seen", unseen[at])
    known_words = counts.select("word", (F.log("n") - total[at]).alias("seen"))
    found = texts.select("key", "text").mapInArrow(rare, "key binary, word long, k int").join(known_words, "word", "left")
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))
    summed = found.groupBy("key").agg(F.sum(F.col("k") * log_prob).alias("within"))
    return summed.join(copies, "key").select("key", (F.col("within") / F.col("copies")).alias("within"))


def score_words(docs: DataFrame, net: Net, known: np.ndarray, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As score(), of words and not only of their ids. counts: of word_counts()."""
    keyed = docs.select(F.struct(docs[id_col].alias("id"), F.unhex(F.md5(docs[text_col])).alias("key")).alias("row"), docs[text_col].alias("text"))
    within = within_ids(keyed.select("row.key", "text"), known, counts)
    ids = score(keyed, net, known, "row", "text").select("row.id", "row.key", "n_tokens", "log_likelihood")
    total = F.col("log_likelihood") + F.coalesce("within", F.lit(0.0))
    return ids.join(within, "key", "left").select(
        F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob")
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = written(word_counts(docs.select("text")), "words")
    known = frequent_words(docs.select("text"), counts)
    return score_words(docs, train(docs, known), known, counts)
