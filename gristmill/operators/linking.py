"""Links between descriptions and detected texts."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gristmill.functions import geometry as G
from gristmill.operators.spatial import near_pairs

WORD = re.compile(r"[a-z0-9]+")


def normalized(text) -> str:
    return " ".join(WORD.findall(unicodedata.normalize("NFKC", text or "").casefold()))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two arrays of tokens as multisets."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def similarity(a: str, b: str) -> float:
    """Of two texts: the best of matching blocks, common tokens, and containment of three characters or more."""
    a, b = normalized(a), normalized(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    left, right = a.split(), b.split()
    common = sum(min(left.count(t), right.count(t)) for t in set(left))
    best = max(SequenceMatcher(None, a, b, autojunk=False).ratio(), 2.0 * common / (len(left) + len(right)))
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and short in long:
        best = max(best, 0.82 + 0.18 * len(short) / len(long))
    return min(1.0, best)


@pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of distinct pairs, in batches."""
    kept: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in kept:
            kept[pair] = similarity(*pair)
        out.append(kept[pair])
    return pd.Series(out, dtype="float64")


def best_links(targets: DataFrame, detections: DataFrame, key: str) -> DataFrame:
    """Per target the best detection near it with a text like its own, or none with the reason.

    targets: key, text, box, width, height. detections: key, index, text, confidence, box. Confidence and distance
    are cheap and native, so they are applied before texts are compared; the far bound holds for any similarity.
    """
    t = targets.select(key, F.col("text").alias("target_text"), F.col("box").alias("source_box"), "width", "height")
    d = detections.filter(F.col("confidence") >= G.LEAST_CONFIDENCE)
    pairs = near_pairs(t, d, key, G.MOST_DISTANCE * G.NEAR_EXACT_FACTOR, "source_box", "box")
    pairs = pairs.withColumn("similarity", text_similarity("target_text", "text"))
    pairs = pairs.filter((F.col("similarity") >= G.LEAST_SIMILARITY) & (F.col("distance") <= G.allowed_distance(F.col("similarity"))))
    overlap = G.iou(F.col("source_box"), F.col("box"))
    pairs = pairs.withColumn("score", G.match_score(F.col("similarity"), F.col("distance"), F.col("confidence"), overlap))
    rank = F.struct("score", "confidence", (-F.col("distance")).alias("near"), (-F.col("index")).alias("first"))
    link = F.struct("index", F.col("text").alias("matched_text"), "similarity", "confidence", "distance", "score", F.col("box").alias("matched_box"))
    best = pairs.groupBy(key).agg(F.max_by(link, rank).alias("link"))
    reason = F.when(F.col("link").isNotNull(), "matched_nearby_ocr_text").when(~F.lower("target_text").rlike("[a-z0-9]"), "empty_target_text")
    return t.join(best, key, "left").select(
        key, F.col("link").isNotNull().alias("accepted"), reason.otherwise("no_credible_nearby_text").alias("reason"),
        F.coalesce("link.matched_box", "source_box").alias("box"), "source_box", "link",
    )
