"""Language of a text: known words by their frequency in each language, unseen words by ever shorter n-grams.

The model is fit on labelled rows, a sample of bounded size chosen by a hash (``max_rows`` documents); its tables hold
every word and every character n-gram of that sample (a word is padded with a blank on either side). A word
scores its log frequency in each language. A word that the table lacks takes the mean over its n-grams of the
greatest length, from the longest down, at which the table knows any. Scores add up over the text; divided by the
root of the number of words they give the languages' shares, the largest of which is the score.

Defined results for odd input: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing was learned; ties go to the language first by name; a run of letters is one word, however long; equal texts
have equal results; repeated rows stay repeated; an empty table gives an empty table; other columns are ignored, and
a kept column that is called lang_pred or score gives way to the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gristmill.llm._shared import pieces, release, small_batches, table

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: About how many documents are learned from, and the longest n-gram.
MAX_ROWS, LONGEST_GRAM = 10_000, 4
#: Unseen words that a worker remembers, and the longest that it does.
MOST_KEPT, LONGEST_KEPT = 100_000, 64


@dataclass
class Model:
    """Words and n-grams, and a row of log frequencies by language for each."""

    langs: list[str]
    words: list[str]
    word_logs: np.ndarray
    grams: list[str]
    gram_logs: np.ndarray


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _counted(rows: DataFrame) -> tuple[pa.Table, pa.Table]:
    """lang, token, n of all words and n-grams; counted where the rows are, then summed by key."""

    def count(batches):
        release()
        for b in pieces(batches):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(words_of(text))
            out = [(lang, w, n) for lang, c in by_lang.items() for w, n in c.items()]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "token", "n"])

    def split(batches):
        release()
        for b in pieces(batches):
            c: Counter = Counter()
            for lang, w, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for g in grams(w, size):
                        c[lang, g] += n
            cols = list(zip(*((lang, g, n) for (lang, g), n in c.items()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "token", "n"])

    schema = "lang string, token string, n long"
    words = rows.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    gram_counts = words.mapInArrow(split, schema).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    return words.toArrow(), gram_counts.toArrow()


def _logs(counts: pa.Table, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Tokens in order, and for each its log frequency in each language, half a count added."""
    token = counts.column("token").combine_chunks().dictionary_encode()
    token = token.chunk(0) if isinstance(token, pa.ChunkedArray) else token
    tokens = token.dictionary.to_pylist()
    n = np.zeros((len(tokens), len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(n, (token.indices.to_numpy(), [at[x] for x in counts.column("lang").to_pylist()]), counts.column("n").to_numpy())
    return tokens, np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * len(tokens) + 1)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn from rows with a label and a text; of more than max_rows about max_rows are taken, by a hash of the id."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")
    ).filter(F.col("lang").isNotNull())
    n = rows.select("h").count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < (1 << 30) * max_rows // n)
    words, parts = _counted(rows.filter(F.col("text").isNotNull()))
    langs = sorted(set(words.column("lang").to_pylist()))
    return Model(langs, *_logs(words, langs), *_logs(parts, langs))


class Scorer:
    """Applies a model; remembers words that it has met."""

    def __init__(self, model: Model):
        self.model, k = model, len(model.langs)
        self.known = len(model.words)
        self.at: dict[str, int] = {w: i for i, w in enumerate(model.words)}
        self.met: dict[str, int] = {}
        self.scores = np.concatenate((model.word_logs.reshape(self.known, k), np.zeros((MOST_KEPT, k))))
        self.grams = {g: i for i, g in enumerate(model.grams)}

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            found = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if found:
                return self.model.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.model.langs))

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' scores."""
        places, other = [], np.zeros(len(self.model.langs))
        if len(self.met) + len(words) > MOST_KEPT:
            self.met.clear()
        for w in words:
            at = self.at.get(w)
            if at is None:
                at = self.met.get(w)
                if at is None:
                    own = self.unseen(w)
                    if len(w) > LONGEST_KEPT:
                        other += own
                        continue
                    at = self.met[w] = self.known + len(self.met)
                    self.scores[at] = own
            places.append(at)
        return other + self.scores[places].sum(axis=0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = sum(self.total(words[lo : lo + MOST_KEPT]) for lo in range(0, len(words), MOST_KEPT))
        total = (total - total.max()) / math.sqrt(len(words))
        share = np.exp(total)
        best = int(total.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score; a prediction sees the text alone."""
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample
    schema = StructType([rows.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        release()
        scorer = Scorer(shared.value)
        for b in pieces(batches):
            found = [scorer(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select("kept.*", "lang_pred", "score")


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold(F.col("doc_id")) != 0))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is found with at least min_score; columns and rows stay as they are."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample

    def run(batches):
        release()
        scorer = Scorer(shared.value)
        for b in pieces(batches):
            found = [scorer(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
