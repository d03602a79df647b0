"""Arrays of tokens, frames and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.hashing import stable_hex, uniform


def until(ids: Column, end: int) -> Column:
    """Ids up to and including the first end id; all if there is none."""
    at = F.array_position(ids, F.lit(end)).cast("int")
    return F.when(at > 0, F.slice(ids, 1, at)).otherwise(ids)


def with_end(ids: Column, end: int, single: Column, *seed) -> Column:
    """Ids and an end id; by hash more end ids, up to as many as there are ids, for single turns more often."""
    base = F.concat(ids, F.array(F.lit(end)))
    chance = F.when(single, 0.15).otherwise(0.10)
    more = F.floor(uniform("n", *seed) * (F.size(base) + 1)).cast("int")
    return F.when(uniform("e", *seed) < chance, F.concat(base, F.array_repeat(F.lit(end), more))).otherwise(base)


def masked_places(n: Column, p: Column, *seed) -> Column:
    """Places from 0 that are masked with probability p, by hash; at least one if there are any."""
    drawn = F.filter(F.sequence(F.lit(0), n - 1), lambda i: uniform("m", *seed, i) < p)
    one = F.array(F.floor(uniform("o", *seed) * n).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(F.size(drawn) == 0, one).otherwise(drawn)


def mask_probability(u: Column, least: float = 1e-3) -> Column:
    return (1 - least) * u + least


def supervised(ids: Column, masked: Column, start: Column, bos: int, mask: int, single: Column) -> Column:
    """A response as it is packed: the noisy copy behind a start id and, unless it is the only turn, the clean one.

    struct of ids, label_ids, label_places (from start), lengths of the segments and their modes.
    """
    noisy = F.concat(F.array(F.lit(bos)), F.transform(ids, lambda x, i: F.when(F.array_contains(masked, i), F.lit(mask)).otherwise(x)))
    clean = F.concat(F.array(F.lit(bos)), ids)
    return F.struct(
        F.when(single, noisy).otherwise(F.concat(noisy, clean)).alias("ids"),
        F.transform(masked, lambda i: F.get(ids, i)).alias("label_ids"),
        F.transform(masked, lambda i: start + i + 1).alias("label_places"),
        F.when(single, F.array(F.size(noisy))).otherwise(F.array(F.size(noisy), F.size(clean))).alias("lengths"),
        F.when(single, F.array(F.lit("noise"))).otherwise(F.array(F.lit("noise"), F.lit("full"))).alias("modes"),
    )


def padded(ids: Column, n: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def middle_frames(n: Column, frames: Column) -> Column:
    """n frames from the middles of equal intervals; a short video repeats its last one."""
    k = F.least(n, frames)
    at = lambda i: F.floor(i * frames / k).cast("int")
    found = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor((at(i) + at(i + 1) - 1) / 2).cast("int"))
    return F.when(k > 0, F.concat(found, F.array_repeat(F.element_at(found, -1), n - k)))


def _intervals(n: Column, frames: Column) -> Column:
    """Of min(n, frames) equal intervals the first frame and the one behind the last."""
    k = F.least(n, frames)
    at = lambda i: F.floor(i * frames / k).cast("int")
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(at(i).alias("lo"), at(i + 1).alias("hi"))))


def _to_length(found: Column, n: Column) -> Column:
    return F.transform(F.array(found), lambda f: F.concat(f, F.array_repeat(F.element_at(f, -1), n - F.size(f))))[0]


def started_frames(n: Column, frames: Column, start: int) -> Column:
    """n frames, each so far behind the start of its interval; a short video repeats the last one."""
    return _to_length(F.transform(_intervals(n, frames), lambda s: s["lo"] + start), n)


def drawn_frames(n: Column, frames: Column, *seed) -> Column:
    """n frames drawn by a seed: one of each interval but its last frame or, where an interval has no other, any of the video in order.

    A short video repeats the last one.
    """

    def draw(spans):
        each = F.transform(spans, lambda s, i: s["lo"] + F.floor(uniform("frame", *seed, i) * (s["hi"] - 1 - s["lo"])).cast("int"))
        every = F.transform(F.sequence(F.lit(0), frames - 1), lambda f: F.struct(stable_hex("frame", *seed, f).alias("h"), f.alias("f")))
        some = F.array_sort(F.transform(F.slice(F.array_sort(every), 1, F.size(spans)), lambda s: s["f"]))
        return F.when(F.forall(spans, lambda s: s["hi"] - 1 > s["lo"]), each).otherwise(some)

    return _to_length(F.transform(F.array(_intervals(n, frames)), draw)[0], n)


def rate_frames(fps: float, frames: Column, input_fps: Column, most: int = -1) -> Column:
    """Frames at a rate, each from the middle of its span, half to even."""
    gap = 1.0 / fps
    n = F.ceil(frames / input_fps / gap).cast("int")
    found = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.rint((gap / 2 + i * gap) * input_fps).cast("int"))
    kept = F.filter(found, lambda f: f < frames)
    return F.slice(kept, 1, most) if most > 0 else kept


# Fixed value: how a frame's file ends.
FRAME_NAME = r"_(\d+).jpg$"


def frame_number(name: Column) -> Column:
    """The number before .jpg; -1 without."""
    return F.coalesce(F.regexp_extract(name, FRAME_NAME, 1).try_cast("int"), F.lit(-1))


def edit_span(images: Column, *seed) -> Column:
    """start, end of a chain of edits: one of the images but the last, and one to two further."""
    start = F.floor(uniform("s", *seed) * (images - 1)).cast("int")
    choices = F.least(start + 3, images) - start - 1
    end = start + 1 + F.floor(uniform("t", *seed) * choices).cast("int")
    return F.struct(start.alias("start"), end.alias("end"))


def largest_number(names: Column, pattern: str = r"^image_(\d+)\.jpg$") -> Column:
    return F.coalesce(F.array_max(F.transform(names, lambda n: F.regexp_extract(n, pattern, 1).try_cast("int"))), F.lit(0))


def weighted_loss(weight: Column, loss: Column) -> Column:
    return F.sum(weight * loss) / F.sum(weight)


def sin_cos(position: Column, size: int) -> Column:
    """size / 2 sines, then as many cosines, of falling frequencies."""
    half = size // 2
    angle = lambda i: position / F.pow(F.lit(10000.0), i / float(half))
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def adapted(ids: Column, end: int, *seed) -> Column:
    """By hash one in ten is extended by 1 to n end ids, one in ten of more than 16 cut to 1 to n - 1."""
    n, u, v = F.size(ids), uniform("a", *seed), uniform("b", *seed)
    more = F.concat(ids, F.array_repeat(F.lit(end), (F.floor(v * n) + 1).cast("int")))
    less = F.slice(ids, 1, (F.floor(v * (n - 1)) + 1).cast("int"))
    return F.when((u < 0.1) & (n > 0), more).when((u >= 0.1) & (u < 0.2) & (n > 16), less).otherwise(ids)


def merged_segments(types: Column, lengths: Column, modes: Column) -> Column:
    """struct lengths, modes: one full segment for plans of texts and understood images alone."""
    one = F.forall(types, lambda t: t.isin("text", "vit_image")) & (F.size(lengths) > 0)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    same = F.transform(lengths, lambda x: x.cast("long"))
    return F.struct(F.when(one, F.array(total)).otherwise(same).alias("lengths"), F.when(one, F.array(F.lit("full"))).otherwise(modes).alias("modes"))


def edit_steps(images: Column, merge: Column, *seed) -> Column:
    """struct start, end, merged: an edit_span() of which a longer one is told at once if it is to be merged, up to the last but one image."""
    span = edit_span(images, *seed)
    merged = ((span["end"] - span["start"]) > 1) & merge
    end = F.when(merged & (span["end"] == images - 1), span["end"] - 1).otherwise(span["end"])
    return F.struct(span["start"].alias("start"), end.alias("end"), merged.alias("merged"))


def token_loss(loss: Column, tokens: Column, world: int = 1) -> Column:
    """Summed loss over summed tokens, times the number of ranks."""
    return F.sum(loss) * world / F.sum(tokens)


def byte_tokens(text: Column) -> Column:
    """Ids of a text's bytes, a tokenizer that needs no vocabulary."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def byte_text(ids: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2, "0")), "")), "UTF-8")


def patches(values: Column, channels: int, height: int, width: int, size: int) -> Column:
    """An image of channels x height x width numbers as rows of patches, each by row, column and channel."""
    if height % size or width % size:
        raise ValueError("patches must fill the image")
    across, each = width // size, size * size * channels

    def number(patch: Column, k: Column) -> Column:
        row = F.floor(patch / across) * size + F.floor(k / (size * channels))
        col = patch % across * size + F.floor(k / channels) % size
        return F.get(values, (k % channels * (height * width) + row * width + col).cast("int"))

    many = F.sequence(F.lit(0), F.lit(height // size * across - 1))
    return F.transform(many, lambda p: F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: number(p, k)))
