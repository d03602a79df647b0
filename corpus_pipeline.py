"""A corpus pipeline over documents: language, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages stands a table in the
shared folder, so a lost executor costs a part of one stage.

Defined results for odd input: a null or empty text has no language and goes in the first stage; of rows with equal or near
texts one stays, that of the smallest id, once for each row of that id; a null id stays with its row, as no one's copy; very long
texts are taken whole by every stage and cut by the last one alone; columns beside those of documents stay, whatever they are
called, up to the last stage; an empty table passes every stage and gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import jaccard, langid, packing, pii
from gristmill.llm._shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter, or that no language fits better than the rest, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingles with a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, cut and packed into sequences."""
    import public_tokenizers

    return packing.pack(packing.cut(docs, public_tokenizers.path(packing.VOCABULARY)))


STAGES = [("language_id", language), ("jaccard_join", near_copies), ("pii", personal_data), ("packing", packed)]

#: No SQL can train and apply the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
