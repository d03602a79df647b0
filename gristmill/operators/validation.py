"""Validation, reject reasons, counters, nested elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.actions import is_answer


def reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does. A rule over nulls doesn't hold."""
    out = None
    for name, holds in rules:
        ok = F.coalesce(holds, F.lit(False))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out


def counters(rows: DataFrame, why: str, prefix: str = "rejected:") -> DataFrame:
    """counter, n: valid rows and those rejected for each reason."""
    name = F.when(F.col(why).isNull(), "valid").otherwise(F.concat(F.lit(prefix), F.col(why)))
    return rows.groupBy(name.alias("counter")).agg(F.count("*").alias("n"))


def split_rejects(rows: DataFrame, why: str) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(why).isNull()).drop(why), rows.filter(F.col(why).isNotNull())


def unnest(rows: DataFrame, elements: str, good: Column, keep: list[str]) -> DataFrame:
    """One row an element with its position; ``valid`` tells which meet the condition on ``element``."""
    return rows.select(*keep, F.posexplode(elements).alias("position", "element")).withColumn("valid", F.coalesce(good, F.lit(False)))


def token_window(rows: DataFrame, tokens: str, low: int, high: int) -> tuple[DataFrame, Column]:
    """Rows with low < tokens <= high, and the counter that any row goes to."""
    t = F.col(tokens)
    counter = F.when(t <= low, "filtered:short").when(t > high, "filtered:long").otherwise("valid")
    return rows.filter((t > low) & (t <= high)), counter


def fits(tokens: Column, plan_rows: Column, most: int, mandatory: bool = False) -> Column:
    """Whether a sample fits: two marks a plan row; a mandatory one must stay below the bound."""
    n = tokens + 2 * plan_rows
    return n < most if mandatory else n <= most


def corpus_report(rows: DataFrame, required: tuple[str, ...], key: str, source: str, answer: str | None = None, content: str | None = None) -> DataFrame:
    """One row of counts in one pass; raises if the schema lacks a required column."""
    if lacking := set(required) - set(rows.columns):
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    aggs = [F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_distinct(source).alias("n_sources")]
    if answer is not None:
        aggs.append(F.count_if(~is_answer(F.col(answer))).alias("bad_answers"))
    if content is not None:
        aggs.append(F.count_distinct(F.sha2(content, 256)).alias("n_contents"))
    return rows.agg(*aggs)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def box_problem(box: Column, width: Column, height: Column) -> Column:
    """Why a target's box can't be used on an image: missing_box, zero_size or off_screen; null if it can, and is at least partly visible."""
    ends = [box[i].cast("double") for i in range(4)]
    lacking = box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull())
    return reason(
        ("missing_box", lacking), ("zero_size", (ends[2] <= ends[0]) | (ends[3] <= ends[1])),
        ("off_screen", (ends[2] <= 0) | (ends[3] <= 0) | (ends[0] >= width) | (ends[1] >= height)),
    )


def record_problem(content: Column, answer: Column, required: dict[str, Column]) -> Column:
    """Why a record isn't made: empty_content, invalid_answer, or missing:<name> of a required field that is null or blank."""
    blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    empty = content.isNull() | (F.octet_length(content) == 0)
    return reason(("empty_content", empty), *((f"missing:{name}", blank(c)) for name, c in required.items()), ("invalid_answer", ~F.coalesce(is_answer(answer), F.lit(False))))


def special_tokens(vocabulary: dict[str, int], wanted: list[str]) -> tuple[dict[str, int], int]:
    """Ids of the wanted tokens, and how many of them are new: those get the ids after the greatest one, in order."""
    found, after = {}, max(vocabulary.values(), default=-1) + 1
    for token in dict.fromkeys(wanted):
        found[token] = vocabulary.get(token, after)
        after += token not in vocabulary
    return found, sum(t not in vocabulary for t in found)
