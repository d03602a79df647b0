"""Suites of generation prompts, drawn from one random stream by many tasks.

Prompts of six kinds are drawn one after the other from numpy's default generator. A sample takes a known number of the stream's
32-bit words unless a word is rejected, so a task jumps ahead to its first one (the generator can skip any number of words)
and draws a block of samples at once, as numpy would: bounded numbers by multiplication and rejection, two different ones by Floyd's
method and a swap. Rejections (a few in a billion words) shift all later samples; tasks report theirs first, and the
shifts are taken up until they agree. The order of the stream is the place of a sample; of equal samples the first one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of objects, colours, sides and numbers, and the wording of prompts.
OBJECTS = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball",
    "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop",
    "computer mouse", "tv remote", "computer keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear",
    "hair drier", "toothbrush",
)
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white")
SIDES = ("left of", "right of", "above", "below")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
PHOTO, UNCOLOURED = "a photo of ", "person"

N = len(OBJECTS)
#: Of each kind but the first, how many numbers its draws are below, in order; a pair of different ones takes three.
PAIR = lambda n: (n - 1, n, 2)
BOUNDS = {
    "two_object": PAIR(N), "counting": (N, 3), "colors": (N - 1, len(COLOURS)), "position": (*PAIR(N), len(SIDES)), "color_attr": (*PAIR(N - 1), *PAIR(len(COLOURS))),
}
SCHEMA = (
    "place long, tag string, prompt string, include array<struct<class:string,count:int,color:string,side:string,of:int>>, exclude array<struct<class:string,count:int>>"
)


class Words:
    """The 32-bit words of numpy's default generator from any place on; of 64 bits the lower half comes first."""

    def __init__(self, seed: int):
        self.seed = seed

    def at(self, place: int, n: int) -> np.ndarray:
        skipped = place // 2
        raw = np.random.PCG64(self.seed).advance(skipped).random_raw((place % 2 + n + 1) // 2)
        return np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1).ravel()[place % 2 : place % 2 + n]


def drawn(words: Words, place: int, bounds: tuple[int, ...], n: int) -> tuple[np.ndarray, int]:
    """n rows of numbers below the bounds, from a place of the stream on, and the words that were rejected."""
    below, out, done, extra = np.array(bounds, np.uint64), np.empty((n, len(bounds)), np.int64), 0, 0
    floor = (np.uint64(1 << 32) - below) % below
    while done < n:
        product = words.at(place + done * len(bounds) + extra, (n - done) * len(bounds)).reshape(-1, len(bounds)) * below
        bad = ((product & np.uint64(0xFFFFFFFF)) < floor).any(axis=1)
        good = int(bad.argmax()) if bad.any() else n - done
        out[done : done + good] = (product[:good] >> np.uint64(32)).astype(np.int64)
        done += good
        if done < n:  # this row draws word by word
            at = place + done * len(bounds) + extra
            for i, (b, least) in enumerate(zip(bounds, floor.tolist(), strict=True)):
                while (p := int(words.at(at, 1)[0]) * b) & 0xFFFFFFFF < least:
                    at, extra = at + 1, extra + 1
                out[done, i], at = p >> 32, at + 1
            done += 1
    return out, extra


def pair(numbers: np.ndarray, n: int) -> np.ndarray:
    """Two different numbers below n of each row of three draws."""
    first, second = numbers[:, 0], np.where(numbers[:, 1] == numbers[:, 0], n - 1, numbers[:, 1])
    swap = numbers[:, 2] == 0
    return np.stack([np.where(swap, second, first), np.where(swap, first, second)], axis=1)


def all_objects(words: Words) -> tuple[list[int], int]:
    """Every object once in a drawn order, and the words that took."""
    place, order = 0, []
    for j in range(N):
        value = 0
        if j:
            rows, extra = drawn(words, place, (j + 1,), 1)
            value, place = int(rows[0, 0]), place + 1 + extra
        order.append(j if value in order else value)
    for i in range(N - 1, 0, -1):
        rows, extra = drawn(words, place, (i + 1,), 1)
        j, place = int(rows[0, 0]), place + 1 + extra
        order[i], order[j] = order[j], order[i]
    return order, place


def _a(noun: str) -> str:
    return f"{'an' if noun[0] in 'aeiou' else 'a'} {noun}"


def _thing(name: str, count: int = 1, color: str | None = None, side: str | None = None) -> dict:
    return {"class": name, "count": count, "color": color, "side": side, "of": None if side is None else 0}


def _samples(tag: str, numbers: np.ndarray) -> Iterator[tuple[str, list, list]]:
    """prompt, include, exclude of each row of draws."""
    coloured = lambda i: OBJECTS[(i + 1 + OBJECTS.index(UNCOLOURED)) % N]
    if tag in ("two_object", "position"):
        for (a, b), row in zip(pair(numbers, N).tolist(), numbers.tolist(), strict=True):
            one, other = OBJECTS[a], OBJECTS[b]
            if tag == "two_object":
                yield f"{_a(one)} and {_a(other)}", [_thing(one), _thing(other)], []
            else:
                yield f"{_a(one)} {SIDES[row[3]]} {_a(other)}", [_thing(other), _thing(one, side=SIDES[row[3]])], []
    elif tag == "counting":
        for i, more in numbers.tolist():
            name, count = OBJECTS[i], more + 2
            yield f"{NUMBERS[count]} {name}{'es' if name[-1] == 's' else 's'}", [_thing(name, count)], [{"class": name, "count": count + 1}]
    elif tag == "colors":
        for i, c in numbers.tolist():
            yield f"{_a(COLOURS[c])} {coloured(i)}", [_thing(coloured(i), color=COLOURS[c])], []
    else:
        for (a, b), (c, d) in zip(pair(numbers[:, :3], N - 1).tolist(), pair(numbers[:, 3:], len(COLOURS)).tolist(), strict=True):
            one, other = (coloured(a), COLOURS[c]), (coloured(b), COLOURS[d])
            yield f"{_a(one[1])} {one[0]} and {_a(other[1])} {other[0]}", [_thing(one[0], color=one[1]), _thing(other[0], color=other[1])], []


def prompt_suite(spark: SparkSession, n: int = 100, seed: int = 43, block: int = 10_000) -> DataFrame:
    """place, tag, prompt, include, exclude: all objects, then n samples of each other kind, without repeats."""
    words, bounds_of, samples = Words(seed), dict(BOUNDS), _samples
    order, place = all_objects(words)
    tasks, first = [], N
    for tag, bounds in bounds_of.items():
        for lo in range(0, n, block):
            m = min(block, n - lo)
            tasks.append((len(tasks), tag, first, place, m))
            first, place = first + m, place + m * len(bounds)
    frame = spark.createDataFrame(tasks, "task int, tag string, first long, place long, n int").repartitionByRange(max(1, len(tasks)), "task")

    def rejected(shifts: dict[int, int]) -> dict[int, int]:
        def count(batches):
            for b in batches:
                extra = [drawn(words, p + shifts.get(t, 0), bounds_of[tag], m)[1] for t, tag, _, p, m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("task"), pa.array(extra, pa.int32())], ["task", "extra"])

        found = {r.task: r.extra for r in frame.mapInArrow(count, "task int, extra int").filter("extra > 0").collect()}
        out, total = {}, 0
        for t in range(len(tasks)):
            if total:
                out[t] = total
            total += found.get(t, 0)
        return out

    shifts: dict[int, int] = {}
    while (found := rejected(shifts)) != shifts:
        shifts = found
    kinds = pa.schema([
        ("place", pa.int64()), ("tag", pa.string()), ("prompt", pa.string()),
        ("include", pa.list_(pa.struct([("class", pa.string()), ("count", pa.int32()), ("color", pa.string()), ("side", pa.string()), ("of", pa.int32())]))),
        ("exclude", pa.list_(pa.struct([("class", pa.string()), ("count", pa.int32())]))),
    ])

    def rows(places, tag, samples) -> pa.RecordBatch:
        found = [(p, tag, PHOTO + text, include, exclude) for p, (text, include, exclude) in zip(places, samples, strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, f, strict=True)) for f in found], kinds)

    def make(batches):
        for b in batches:
            for t, tag, at, p, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                numbers, _ = drawn(words, p + shifts.get(t, 0), bounds_of[tag], m)
                yield rows(range(at, at + m), tag, samples(tag, numbers))

    single = [(i, "single_object", PHOTO + _a(OBJECTS[o]), [tuple(_thing(OBJECTS[o]).values())], []) for i, o in enumerate(order)]
    every = spark.createDataFrame(single, SCHEMA).unionByName(frame.mapInArrow(make, SCHEMA))
    spec = [c for c in every.columns if c != "place"]
    return every.groupBy(*spec).agg(F.min("place").alias("place")).select("place", *spec)
