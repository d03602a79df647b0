"""Records before and after a run: scans with their skip rules, external records, realigned targets, checks, orders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import actions as A
from gristmill.functions import geometry as G
from gristmill.functions.actions import grounding_prompt, history_prompt, replace_box
from gristmill.functions.hashing import stable_hex

# Sources that count as the web, prefixes of its files, and the names of box encodings.
WEB_SOURCES, WEB_PREFIX = ("web", "gitlab", "shop", "forum", "tool"), "web_"
UNIT_BOXES, SCALED_BOXES, EXTENT_BOXES = ("xyxy_0_1", "normalized", "normalized_0_1"), ("xyxy_1000", "normalized_1000"), "xywh_pixels"
PROTOCOLS = ("target_grounding", "task_history")


def training_scan(rows: DataFrame, images: Column, elements: Column, need_image: bool = True) -> DataFrame:
    """Rows that can be trained on: with an image (if need be), with a text that isn't blank, with an element that carries loss."""
    texts = F.exists(elements, lambda e: (e["type"] == "text") & (F.length(F.trim(F.coalesce(e["text"], F.lit("")))) > 0))
    loss = F.exists(elements, lambda e: e["loss"] == 1)
    seen = (F.size(F.filter(images, lambda i: F.length(i) > 0)) > 0) if need_image else F.lit(True)
    return rows.filter(F.coalesce(seen & texts & loss, F.lit(False)))


def parsed_rows(rows: DataFrame, hook: Callable[[DataFrame], Column], name: str = "sample") -> DataFrame:
    """What a hook makes of each row: an array of structs, of which an empty or null one drops the row."""
    return rows.select(*rows.columns, F.explode(hook(rows)).alias(name))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Members under the names that a parser expects; names that aren't there are left out."""
    return rows.withColumnsRenamed(names)


def seeded_lines(rows: DataFrame, file: str, line: str, seed: int, limit: int | None = None) -> DataFrame:
    """Lines of every file in an order drawn by the seed, the first of them up to a limit; adds ``place`` from 1."""
    place = F.row_number().over(W.partitionBy(file).orderBy(stable_hex(seed, F.col(file), F.col(line)), line))
    placed = rows.withColumn("place", place)
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def ordered_prefix(rows: DataFrame, order: str, key: str, limit: int | None = None) -> DataFrame:
    """The first rows by line; a key that comes twice among them is an error when the rows are read."""
    first = rows if limit is None else rows.orderBy(order).limit(limit)
    twice = F.count("*").over(W.partitionBy(key)) > 1
    checked = F.when(twice, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.col(key).cast("string"))
    return first.withColumn("_checked", checked).filter(F.col("_checked").isNotNull() | F.col(key).isNull()).drop("_checked")


def loaded(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """Shards of predictions found by a pattern, as one table; no shard, or a key that comes twice, is an error."""
    return ordered_prefix(spark.read.schema(schema).json(pattern), key, key)


def numbered_image(path: Column) -> Column:
    """struct prompt, image of ``.../<digits>/.../<digits>.png``; null for other files."""
    pattern = r"/(\d+)/(?:[^/]+/)?(\d+)\.png$"
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).cast("long").alias("prompt"), F.regexp_extract(path, pattern, 2).cast("long").alias("image")))


def latest_step(path: str) -> Column:
    """An aggregate: of folders named by a step the one with the greatest number."""
    return F.max_by(path, F.regexp_extract(path, r"(\d+)/?$", 1).try_cast("long"))


def external_box(kind: Column, box: Column, width: Column, height: Column, target: Column | None = None) -> Column:
    """A box of an external record as whole numbers to 1000, by its encoding; a given target box wins."""
    whole = lambda b, times: F.transform(b, lambda v: F.rint(v * times).cast("int"))
    kind = F.lower(F.coalesce(kind, F.lit("xyxy_pixels")))
    corners = F.when(kind == EXTENT_BOXES, F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])).otherwise(box)
    found = F.when(kind.isin(*UNIT_BOXES), whole(box, 1000)).when(kind.isin(*SCALED_BOXES), whole(box, 1)).otherwise(G.normalize_box(corners, width, height))
    return found if target is None else F.when(target.isNotNull(), whole(target, 1)).otherwise(found)


def is_web(file: Column, source: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(file).startswith(WEB_PREFIX) | low(source).isin(*WEB_SOURCES)


def text_or_icon(kind: Column) -> Column:
    return F.when(F.lower(F.coalesce(kind, F.lit(""))) == "text", "text").otherwise("icon")


def prompt_by(protocol: Column, operation: Column, description: Column, value: Column, task: Column, actions: Column, index: Column) -> Column:
    """The prompt of a protocol; an unknown one is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown protocol "), protocol)).cast("string")
    return F.when(protocol == PROTOCOLS[0], grounding_prompt(operation, description, value)).when(protocol == PROTOCOLS[1], history_prompt(task, actions, index)).otherwise(unknown)


def with_last_answer(conversation: Column, box: Column, role: str = "gpt") -> Column:
    """array<struct<from,value>> with another box in its last answer; one without an answer is an error."""
    places = F.filter(F.transform(conversation, lambda t, i: F.when(t["from"] == role, i)), lambda i: i.isNotNull())
    last = F.array_max(places)
    new = lambda t: F.struct(t["from"].alias("from"), replace_box(t["value"], box).alias("value"))
    changed = F.transform(conversation, lambda t, i: F.when(i == last, new(t)).otherwise(F.struct(t["from"].alias("from"), t["value"].alias("value"))))
    return F.when(last.isNotNull(), changed).otherwise(F.raise_error(F.lit("no answer in the conversation")))


def realigned(own: Column, found: Column, accepted: Column, error: Column) -> Column:
    """struct box, accepted, fallback, dom, ocr, error: the found box where it was accepted, else the row's own."""
    good = F.coalesce(accepted & found.isNotNull() & error.isNull(), F.lit(False))
    return F.struct(
        F.when(good, found).otherwise(own).alias("box"), good.alias("accepted"), (~good).alias("fallback"),
        own.alias("dom"), F.when(good, found).alias("ocr"), error.alias("error"),
    )


def match_rates(result: str = "result") -> list[Column]:
    good, failed = F.count_if(F.col(f"{result}.accepted")), F.count_if(F.col(f"{result}.error").isNotNull())
    return [F.count("*").alias("n"), good.alias("matched"), F.count_if(F.col(f"{result}.fallback")).alias("fallback"), failed.alias("errors"), (good / F.count("*")).alias("match_rate")]


def with_questions(images: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Images with their questions; one without any stays, with a reason, and no questions."""
    return images.join(questions, key, "left").withColumn("reason", F.when(F.col(questions.columns[-1]).isNull(), "no_questions"))


def last_crop_categories(rows: DataFrame, item: str, crop: str, label: str, score: str) -> DataFrame:
    """label, mean, n over the scores before gating of each item's last crop."""
    last = F.max(crop).over(W.partitionBy(item))
    return rows.withColumn("_last", last).filter(F.col(crop) == F.col("_last")).groupBy(label).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def benchmark_checks(rows: DataFrame, key: str, benchmark: str, action: str, box: str, actions: tuple[str, ...]) -> DataFrame:
    """One row of counts over prepared records: rows, repeated keys, benchmarks, unknown actions, bad boxes."""
    b = F.col(box)
    good = G.valid_box(b) & F.forall(b, lambda v: (v >= 0) & (v <= 1000) & (v == F.floor(v)))
    return rows.agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct(key)).alias("repeated"), F.count_distinct(benchmark).alias("benchmarks"),
        F.count_if(~F.coalesce(F.col(action).isin(*actions), F.lit(False))).alias("bad_actions"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_boxes"),
    )


def expected_counts(manifest: dict | None, folders: list[str], fallback: int) -> dict[str, int]:
    """Rows by source as a manifest tells them; without any, the fallback for every folder."""
    told = {s: int(x["rows"]) for s, x in (manifest or {}).get("sources", {}).items() if isinstance(x, dict) and "rows" in x}
    return told or dict.fromkeys(sorted(folders), fallback)


def chosen(wanted: str | None, available: list[str]) -> tuple[list[str], list[str]]:
    """Of a comma-separated list what is available, in its order, and what is not; nothing left is an error."""
    names = [n.strip() for n in (wanted or ",".join(available)).split(",") if n.strip()]
    found = [n for n in names if n in available]
    if not found:
        raise ValueError(f"none of {names} is available; there are {available}")
    return found, [n for n in names if n not in available]


def whole_steps(text: str | None) -> tuple[int, ...]:
    """Steps from a comma-separated list; blanks are skipped, negative and repeated ones are errors."""
    steps = tuple(int(s) for s in (text or "").split(",") if s.strip())
    if any(s < 0 for s in steps) or len(set(steps)) < len(steps):
        raise ValueError(f"steps must be different and not negative: {text}")
    return steps


def fraction_or_none(text: str) -> float | None:
    """A number from 0 to 1; none, null, off and fixed mean that there is none."""
    if re.fullmatch("none|null|off|fixed", text, re.I):
        return None
    value = float(text)
    if not 0 <= value <= 1:
        raise ValueError(f"{text} is not in [0, 1]")
    return value


def seeded_files(files: DataFrame, path: str, seed: int, epoch: Column, ranks: int, workers: int) -> DataFrame:
    """Files in an order drawn by seed and epoch, dealt evenly to ranks and workers, each worker's in reverse.

    rank, worker and turn are null for the files that even parts leave over.
    """
    place = F.row_number().over(W.partitionBy(epoch).orderBy(stable_hex(seed, epoch, F.col(path)), path)) - 1
    n = F.count("*").over(W.partitionBy(epoch))
    per_rank = F.floor(F.col("_n") / ranks)
    per_worker = F.floor(per_rank / workers)
    out = files.withColumns({"_place": place, "_n": n})
    rank = F.when(per_rank > 0, F.floor(F.col("_place") / per_rank)).cast("int")
    at = F.pmod(F.col("_place"), F.greatest(per_rank, F.lit(1)))
    worker = F.when(per_worker > 0, F.floor(at / per_worker)).cast("int")
    good = (rank < ranks) & (worker < workers)
    turn = per_worker - 1 - F.pmod(at, F.greatest(per_worker, F.lit(1)))
    return out.select(*files.columns, F.when(good, rank).alias("rank"), F.when(good, worker).alias("worker"), F.when(good, turn).cast("int").alias("turn"))


def same_names(a: DataFrame, b: DataFrame) -> bool:
    """Whether two columns of names hold the same set."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def cursor_of(cursors: DataFrame, rank: str, own: int) -> int | None:
    """The position that a rank saved; None if it saved none."""
    found = cursors.filter(F.col(rank) == own).agg(F.max("position").alias("p")).first()
    return found["p"]


def lookup(rows: DataFrame, key: str, value, what: str = "row"):
    """The one row of a key; a named error without it."""
    found = rows.filter(F.col(key) == value).limit(1).collect()
    if not found:
        raise KeyError(f"no {what} {value!r}")
    return found[0]


def prediction_records(outputs: DataFrame, keep: list[str], text: str, error: str, measured: list[str]) -> DataFrame:
    """Records of a run: what the model said, read as an action, or for a sample that failed an empty prediction and the error.

    Keeps the sample's columns; measured ones are null where the run failed. A null text without an error is an empty prediction.
    """
    failed = F.col(error).isNotNull()
    said = F.when(failed, "").otherwise(F.coalesce(F.col(text), F.lit("")))
    rows = outputs.select(*keep, said.alias("prediction"), A.parsed_prediction(said).alias("_p"), F.col(error).alias("error"), *(F.when(~failed, F.col(c)).alias(c) for c in measured))
    return rows.select(
        *keep, "prediction", F.col("_p.action").alias("predicted_action"), F.when(F.col("_p.error").isNull(), F.col("_p.box")).alias("predicted_box"),
        F.col("_p.value").alias("predicted_value"), F.when(F.col("error").isNotNull(), "inference_error").otherwise(F.col("_p.error")).alias("parse_error"), *measured, "error",
    )
