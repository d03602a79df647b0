"""Text: white space, redaction, small grammar, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address and as a password, and their stand-ins.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PASSWORD = r"(?i)(password\s*[:=]\s*)([^\s,;]+)"
EMAIL_MARK, PASSWORD_MARK = "<EMAIL>", "$1<REDACTED>"
#: White space: Unicode's, and the four information separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\x00", " "), SPACES, " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"{SPACES[:4]}\A{SPACES[4:]}|{SPACES[4:]}\z", "")


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, EMAIL_MARK), PASSWORD, PASSWORD_MARK)


def compact(text: Column, limit: int = 2000) -> Column:
    """Squeezed, redacted, then cut."""
    return F.substring(redact(squeeze(text)), 1, limit)


def canonicalize(text: Column, keep: str = "") -> Column:
    """Without ASCII punctuation but for the characters to keep; squeezed."""
    marks = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in keep)
    return squeeze(F.translate(F.coalesce(text, F.lit("")), marks, ""))


def with_article(noun: Column) -> Column:
    return F.concat(F.when(F.substring(noun, 1, 1).isin(*"aeiou"), "an ").otherwise("a "), noun)


def plural(noun: Column) -> Column:
    return F.concat(noun, F.when(F.substring(noun, -1, 1) == "s", "es").otherwise("s"))


def broad_category(label: Column) -> Column:
    """What stands before the first parenthesis, and of that what stands before the first hyphen."""
    return F.trim(F.split_part(detailed_category(label), F.lit("-"), F.lit(1)))


def detailed_category(label: Column) -> Column:
    return F.trim(F.split_part(label, F.lit("("), F.lit(1)))


def final_answer(text: Column, end: str = "<|endoftext|>") -> Column:
    """What follows the last end of thought, without end marks."""
    return F.trim(F.replace(F.substring_index(text, "</think>", -1), F.lit(end), F.lit("")))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def pick_caption(captions: list[Column], *seed) -> Column:
    """One of the non-blank captions by hash; a blank if there is none."""
    from gristmill.functions.hashing import stable_int

    filled = F.filter(F.array(*captions), lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    at = (stable_int(*seed) % F.greatest(F.size(filled), F.lit(1))).cast("int")
    return F.when(F.size(filled) == 0, " ").otherwise(F.get(filled, at))


def with_frames(turns: Column, frames: Column, video: str = "<video>", image: str = "<image>") -> Column:
    """Turns of which the first names a video, its mark replaced by one of an image for every frame; else an error."""
    first = F.get(turns, F.lit(0))
    new = F.replace(first, F.lit(video), F.repeat(F.lit(image), frames))
    checked = F.when(F.contains(first, F.lit(video)), new).otherwise(F.raise_error(F.lit("the first turn names no video")).cast("string"))
    return F.concat(F.array(checked), F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))))


def marked_images(text: Column) -> Column:
    """array<struct<text,image>>: what stands between numbered image marks, stripped, and the marks' numbers, in order."""
    mark = r"<img><\|image_(\d+)\|></img>"
    numbers = F.regexp_extract_all(text, F.lit(mark), 1)
    said = lambda t: F.struct(strip(t).alias("text"), F.lit(None).cast("int").alias("image"))
    shown = lambda n: F.struct(F.lit(None).cast("string").alias("text"), n.cast("int").alias("image"))
    each = F.transform(F.split(text, mark, -1), lambda t, i: F.when(i < F.size(numbers), F.array(said(t), shown(F.get(numbers, i)))).otherwise(F.array(said(t))))
    return F.filter(F.flatten(each), lambda e: e["image"].isNotNull() | (e["text"] != ""))
