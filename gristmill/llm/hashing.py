"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time in numpy.

A word is a run of bytes other than ASCII white space, with A-Z lowered. The hash of a word of up to ``LONG`` bytes
mixes its length and then its bytes, eight at a time, each step a bijection; that of a longer one is XXH3. A shingle's
is a mixed sum over its words by position. Two different shingles of a pair of documents share a hash with probability
about 2**-64 for each pair of shingles; that is the one way in which results built on these could err. A text is
hashed in windows of ``GROUP_BYTES`` that end between words, so what is held at once is the hashes, not a multiple
of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_RNG = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
for _b in (0x20, *range(0x09, 0x0E)):
    _SPACE[_b] = True
_BLANKS = b" \t\n\x0b\x0c\r"
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: (1 << 8 n) - 1 for n bytes, up to eight.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LONG = 32
GROUP_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _window(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a buffer, in order, and where they begin."""
    low = data.lower() + b" " * 8
    raw = np.frombuffer(low, np.uint8)
    space = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.concatenate((np.zeros(1, turns.dtype), turns))
    starts, lengths = turns[0::2], turns[1::2] - turns[0::2]
    eights = np.ndarray(len(raw) - 7, "<u8", low, strides=(1,))
    words = lengths.astype(np.uint64) * _LENGTH
    at = None  # all words
    for lo in range(0, LONG, 8):
        if lo:
            at = np.flatnonzero(lengths > lo) if at is None else at[lengths[at] > lo]
            if not len(at):
                break
        left = (lengths if at is None else lengths[at]) - lo
        part = eights[(starts if at is None else starts[at]) + lo] & _MASK[np.minimum(left, 8)]
        if at is None:
            words = mix(words ^ part)
        else:
            words[at] = mix(words[at] ^ part)
    for i in np.flatnonzero(lengths > LONG).tolist():
        words[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + lengths[i]])
    return words, starts


def _long(data: bytes) -> np.ndarray:
    """Word hashes of a text of any size, a window at a time; windows end where white space begins."""
    found, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + GROUP_BYTES)
        if hi < len(data):
            cut = max(data.rfind(bytes((b,)), lo, hi) for b in _BLANKS)
            if cut <= lo:  # a word longer than the window
                after = [p for b in _BLANKS if (p := data.find(bytes((b,)), hi)) >= 0]
                cut = min(after, default=len(data))
            hi = cut
        found.append(_window(data[lo:hi])[0])
        lo = hi
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For groups of texts: word hashes, the texts' bounds in them, the number of texts. A null text is empty."""
    group: list[bytes] = []
    size = 0

    def done():
        words, starts = _window(b" ".join(group))
        return words, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in group)])), len(group)

    for t in texts:
        data = (t or "").encode()
        if size + len(data) > GROUP_BYTES and group:
            yield done()
            group, size = [], 0
        if len(data) > GROUP_BYTES:
            words = _long(data)
            yield words, np.array([0, len(words)]), 1
        else:
            group.append(data)
            size += len(data)
    if group:
        yield done()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; fewer words are one shingle, none are none."""
    n = len(words)
    if n >= k:
        total = words[: n - k + 1] * _PLACES[0]
        for j in range(1, k):
            total += words[j : n - k + 1 + j] * _PLACES[j]
        return mix(total)
    if n:
        return mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.full(1, n, np.uint64) * _SHORT)
    return words[:0]
