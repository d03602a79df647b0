"""The standard library's seeded whole numbers, for many seeds at once.

Python's ``random.Random(seed).randint`` draws from a Mersenne Twister that is seeded by the 32-bit words of the seed. Here the
states of a batch of seeds are columns of one array, so every step of the seeding is one numpy operation for all of them; as
few draws are needed, only the first words of the next state are made.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from gristmill.functions import geometry as G

# Fixed values of the generator: words of state, distance of the word mixed in, the seed before the key is mixed in, the factors of
# seeding, the matrix, and the masks and shifts of tempering.
WORDS, APART, BEFORE_KEY = 624, 397, 19650218
FIRST_FACTOR, KEY_FACTOR, LAST_FACTOR = 1812433253, 1664525, 1566083941
MATRIX, UPPER, LOWER = 0x9908B0DF, 0x80000000, 0x7FFFFFFF
TEMPER_B, TEMPER_C = 0x9D2C5680, 0xEFC60000
#: Seeds whose states are held at once: 2.5 KB each.
BATCH = 1024


def _start() -> np.ndarray:
    words = [BEFORE_KEY]
    for i in range(1, WORDS):
        words.append((FIRST_FACTOR * (words[-1] ^ (words[-1] >> 30)) + i) & 0xFFFFFFFF)
    return np.array(words, np.uint32)


START = _start()


def states(keys: np.ndarray) -> np.ndarray:
    """(WORDS, n) states of n seeds; keys: (words of a seed, n)."""
    state = np.repeat(START[:, None], keys.shape[1], axis=1)
    at, word = 1, 0

    def mixed(factor: int) -> np.ndarray:
        before = state[at - 1]
        return state[at] ^ ((before ^ (before >> np.uint32(30))) * np.uint32(factor))

    for _ in range(WORDS):
        state[at] = mixed(KEY_FACTOR) + keys[word] + np.uint32(word)
        word = (word + 1) % len(keys)
        at += 1
        if at == WORDS:
            state[0], at = state[-1], 1
    for _ in range(WORDS - 1):
        state[at] = mixed(LAST_FACTOR) - np.uint32(at)
        at += 1
        if at == WORDS:
            state[0], at = state[-1], 1
    state[0] = UPPER
    return state


def output(state: np.ndarray, i: int) -> np.ndarray:
    """The i-th number of each state, of the first WORDS - APART."""
    y = (state[i] & np.uint32(UPPER)) | (state[i + 1] & np.uint32(LOWER))
    v = state[i + APART] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(MATRIX), np.uint32(0))
    v ^= v >> np.uint32(11)
    v ^= (v << np.uint32(7)) & np.uint32(TEMPER_B)
    v ^= (v << np.uint32(15)) & np.uint32(TEMPER_C)
    return v ^ (v >> np.uint32(18))


def _drawn(seeds: list[int], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One draw after the other of each seed between its bounds, ends included; all seeds have as many words."""
    words = max(1, -(-seeds[0].bit_length() // 32))
    state = states(np.array([[(s >> (32 * w)) & 0xFFFFFFFF for s in seeds] for w in range(words)], np.uint32))
    span = high - low + 1
    bits = np.array([[int(n).bit_length() for n in row] for row in span]).reshape(span.shape)
    out, turn, rows = low.copy(), np.zeros(len(seeds), np.int64), np.arange(len(seeds))
    for i in range(WORDS - APART):
        if not len(rows):
            return out
        d = turn[rows]
        r = output(state, i)[rows].astype(np.int64) >> (32 - bits[rows, d])
        good = r < span[rows, d]
        out[rows[good], d[good]] = low[rows[good], d[good]] + r[good]
        turn[rows[good]] += 1
        rows = rows[turn[rows] < span.shape[1]]
    for r in rows.tolist():  # so long a run of draws beyond the bounds has a chance below 2^-100
        own = random.Random(seeds[r])
        out[r] = [own.randint(int(a), int(b)) for a, b in zip(low[r], high[r], strict=True)]
    return out


def bounded(seeds: list[int], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(n, d) whole numbers: what random.Random(seed).randint(low, high) gives for d pairs of bounds in turn; low <= high < low + 2^32."""
    if len(seeds) and ((high < low).any() or (high - low >= (1 << 32) - 1).any()):
        raise ValueError("bounds must be in order and less than 2^32 apart")
    out = np.zeros(low.shape, np.int64)
    by_words: dict[int, list[int]] = {}
    for i, s in enumerate(seeds):
        by_words.setdefault(max(1, -(-s.bit_length() // 32)), []).append(i)
    for own in by_words.values():
        for lo in range(0, len(own), BATCH):
            part = own[lo : lo + BATCH]
            out[part] = _drawn([seeds[i] for i in part], low[part], high[part])
    return out


@pandas_udf(ArrayType(LongType()))
def seeded_between(seed: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Draws of a seed (hex digits) between pairs of bounds (arrays); null where any of them is null."""
    there = seed.notna() & low.notna() & high.notna()
    out = pd.Series([None] * len(seed), index=seed.index, dtype=object)
    if there.any():
        drawn = bounded([int(s, 16) for s in seed[there]], np.stack(low[there].to_list()).astype(np.int64), np.stack(high[there].to_list()).astype(np.int64))
        out[there] = pd.Series([list(map(int, d)) for d in drawn], index=out.index[there], dtype=object)
    return out


def seeded_crop(box: Column, width: Column, height: Column, crop: int, seed: Column) -> Column:
    """x1, y1, x2, y2 of a window that holds the box, at the place that the standard library draws with this seed (hex digits)."""
    x, y = G.crop_range(box[0], box[2], width, crop), G.crop_range(box[1], box[3], height, crop)
    bounds = lambda i: F.when(box.isNotNull(), F.array(x[i], y[i]).cast("array<long>"))
    at = seeded_between(seed, bounds(0), bounds(1))
    return F.when(box.isNotNull(), F.array(at[0], at[1], at[0] + x[2], at[1] + y[2]))
