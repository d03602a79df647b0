"""Images as arrays of bytes: reading, flattening, resampling, patches and grids in numpy, over Arrow batches.

An image is a binary column: a PNG of 8 bits a sample without interlacing, or a portable graymap or pixmap. In Python it is an array
(height, width, channels) of one, three or four channels. What isn't such an image gives null. Every choice is seeded by a
hash, so results don't depend on partitions or retries.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

# The signature and colour types of the format, the weights of brightness in 65,536ths, the cubic's parameter, and the bits
# that a resampling weight is rounded to.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
BRIGHTNESS = (19595, 38470, 7471)
CUBIC, WEIGHT_BITS = -0.5, 22
WHITE = 255


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that are each told by their difference to the left, the upper, or both neighbours."""
    if len(raw) != height * (stride + 1):
        raise ValueError("rows are missing")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            left, up, own, corner = [0] * step + [0] * stride, above.tolist(), line.tolist(), [0] * step + above.tolist()
            for x in range(stride):
                a, b = left[x], up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = corner[x]
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                left[x + step] = (own[x] + guess) & 255
            out[y] = left[step:]
        else:
            raise ValueError("an unknown filter")
        above = out[y]
    return out


def decode(data: bytes | None) -> np.ndarray | None:
    """An image's array; None for what isn't an image of these kinds."""
    try:
        return _png(data) if data and data[:8] == SIGNATURE else _portable(data or b"")
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def _portable(data: bytes) -> np.ndarray | None:
    m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data)
    if not m:
        return None
    w, h, c = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    pixels = np.frombuffer(data, np.uint8, offset=m.end())
    return pixels[: w * h * c].reshape(h, w, c).copy() if w and h and len(pixels) >= w * h * c else None


def _png(data: bytes) -> np.ndarray:
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or not w or not h:
        raise ValueError("not of 8 bits a sample, or interlaced")
    c = CHANNELS[colour]
    pixels = _unfiltered(zlib.decompress(b"".join(body)), h, w * c, c).reshape(h, w, c)
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        full = np.concatenate([palette, alpha[:, None]], axis=1)[pixels[:, :, 0]]
        return full if clear is not None else full[:, :, :3]
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear.tobytes(), ">u2").astype(np.uint8)
        rgb = np.repeat(pixels, 3, axis=2) if colour == 0 else pixels
        return np.concatenate([rgb, np.where((pixels == key).all(axis=2), 0, 255).astype(np.uint8)[:, :, None]], axis=2)
    return np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2) if colour == 4 else pixels


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """A PNG of an array of one, three or four channels."""
    h, w, c = image.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def _by_255(t: np.ndarray) -> np.ndarray:
    """Rounded division of products by 255."""
    t = t + 128
    return ((t >> 8) + t) >> 8


def flattened(image: np.ndarray) -> np.ndarray:
    """Three channels; what is see-through lies on white."""
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 3:
        return image
    colour, alpha = image[:, :, :3].astype(np.int32), image[:, :, 3:].astype(np.int32)
    return _by_255(colour * alpha + WHITE * (255 - alpha)).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """As many channels as before (three of a see-through one), each the brightness."""
    rgb = flattened(image).astype(np.int64)
    level = ((rgb @ np.array(BRIGHTNESS) + 0x8000) >> 16).astype(np.uint8)[:, :, None]
    return level if image.shape[2] == 1 else np.repeat(level, 3, axis=2)


def _weights(size: int, new: int) -> np.ndarray:
    """(new, size) whole-number weights of a cubic that is widened to what a new sample covers."""
    scale = size / new
    wide = max(scale, 1.0)
    out = np.zeros((new, size), np.int64)
    for i in range(new):
        mid = (i + 0.5) * scale
        lo, hi = max(0, int(mid - 2 * wide + 0.5)), min(size, int(mid + 2 * wide + 0.5))
        x = np.abs((np.arange(lo, hi) - mid + 0.5) / wide)
        near, far = (CUBIC + 2) * x**3 - (CUBIC + 3) * x**2 + 1, CUBIC * (x**3 - 5 * x**2 + 8 * x - 4)
        w = np.where(x < 1, near, np.where(x < 2, far, 0.0))
        w = w / w.sum() * (1 << WEIGHT_BITS)
        out[i, lo:hi] = np.trunc(w + np.copysign(0.5, w))
    return out


def _along(weights: np.ndarray, image: np.ndarray) -> np.ndarray:
    total = np.tensordot(weights, image.astype(np.int64), axes=(1, 0)) + (1 << (WEIGHT_BITS - 1))
    return np.clip(total >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Cubic resampling along rows, then columns; a side that keeps its length stays as it is."""
    if width != image.shape[1]:
        image = _along(_weights(image.shape[1], width), image.transpose(1, 0, 2)).transpose(1, 0, 2)
    return _along(_weights(image.shape[0], height), image) if height != image.shape[0] else image


def downscaled(image: np.ndarray, factor: float) -> np.ndarray:
    return resized(image, max(1, round(image.shape[1] * factor)), max(1, round(image.shape[0] * factor)))


def normalised(image: np.ndarray, mean: float = 0.5, spread: float = 0.5) -> np.ndarray:
    return ((image.astype(np.float32) / 255 - mean) / spread).astype(np.float32)


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")


def cropped(image: np.ndarray, height: int, width: int, seed: str) -> np.ndarray:
    """A window at a seeded place; a window larger than the image is an error."""
    h, w = image.shape[:2]
    if height > h or width > w:
        raise ValueError("the window is larger than the image")
    y, x = _hash(seed, "y") % (h - height + 1), _hash(seed, "x") % (w - width + 1)
    return image[y : y + height, x : x + width]


def line_kernel(size: int, angle: float) -> np.ndarray:
    """A line of size samples through the middle, turned by degrees; its weights add up to 1."""
    out, mid = np.zeros((size, size)), (size - 1) / 2
    for t in np.arange(size) - mid:
        x, y = mid + t * math.cos(math.radians(angle)), mid - t * math.sin(math.radians(angle))
        x0, y0 = math.floor(x), math.floor(y)
        for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
            weight = (1 - abs(x - x0 - dx)) * (1 - abs(y - y0 - dy))
            if 0 <= x0 + dx < size and 0 <= y0 + dy < size:
                out[y0 + dy, x0 + dx] += weight
    return out / out.sum()


def blurred(image: np.ndarray, size: int = 15, angle: float = 0.0) -> np.ndarray:
    """Every sample as the mean along a line; beyond the edges the image is mirrored."""
    before, after = size // 2, size - 1 - size // 2
    wide = np.pad(image.astype(np.float64), ((before, after), (before, after), (0, 0)), mode="symmetric")
    total, kernel = np.zeros(image.shape), line_kernel(size, angle)
    for dy, dx in np.argwhere(kernel).tolist():
        total += kernel[dy, dx] * wide[dy : dy + image.shape[0], dx : dx + image.shape[1]]
    return np.clip(np.rint(total), 0, 255).astype(np.uint8)


def _patches(image: np.ndarray, rows: int, columns: int) -> tuple[list[int], list[int]]:
    """Where patches begin and the last ends, along both sides; the last patch takes the rest."""
    edges = lambda n, k: [i * (n // k) for i in range(k)] + [n]
    return edges(image.shape[0], rows), edges(image.shape[1], columns)


def shuffled(image: np.ndarray, rows: int, columns: int, seed: str, gap: int = 2) -> np.ndarray:
    """The patches in a seeded order, with white gaps; where a patch is larger than its new place, the next ones lie over it."""
    ys, xs = _patches(image, rows, columns)
    patches = [image[ys[i] : ys[i + 1], xs[j] : xs[j + 1]] for i in range(rows) for j in range(columns)]
    order = sorted(range(len(patches)), key=lambda i: (_hash(seed, i), i))
    out = np.full((image.shape[0] + (rows - 1) * gap, image.shape[1] + (columns - 1) * gap, image.shape[2]), WHITE, np.uint8)
    for place, i in enumerate(order):
        y, x = ys[place // columns] + place // columns * gap, xs[place % columns] + place % columns * gap
        part = patches[i][: out.shape[0] - y, : out.shape[1] - x]
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def blanked(image: np.ndarray, rows: int, columns: int, seed: str, share: float = 0.3) -> np.ndarray:
    """A seeded share of the patches, rounded down, is white."""
    ys, xs = _patches(image, rows, columns)
    n = rows * columns
    out = image.copy()
    for i in sorted(range(n), key=lambda i: (_hash(seed, i), i))[: max(0, min(n, int(n * share)))]:
        out[ys[i // columns] : ys[i // columns + 1], xs[i % columns] : xs[i % columns + 1]] = WHITE
    return out


def grid(images: list[np.ndarray], side: int) -> np.ndarray:
    """Up to four images as squares in two rows, on white; a single one alone."""
    tiles = [resized(flattened(i), side, side) for i in images[:4]]
    if len(tiles) == 1:
        return tiles[0]
    out = np.full((2 * side, 2 * side, 3), WHITE, np.uint8)
    for i, t in enumerate(tiles):
        out[i // 2 * side : (i // 2 + 1) * side, i % 2 * side : (i % 2 + 1) * side] = t
    return out


#: Steps by name, each of an image, a seed and parameters.
STEPS: dict[str, Callable] = {
    "flatten": lambda i, seed: flattened(i), "grey": lambda i, seed: grey(i), "resize": lambda i, seed, width, height: resized(i, width, height),
    "downscale": lambda i, seed, factor: downscaled(i, factor), "crop": lambda i, seed, height, width: cropped(i, height, width, seed),
    "blur": lambda i, seed, size=15, angle=0.0: blurred(i, size, angle), "shuffle": lambda i, seed, rows, columns, gap=2: shuffled(i, rows, columns, seed, gap),
    "blank": lambda i, seed, rows, columns, share=0.3: blanked(i, rows, columns, seed, share),
}


def stepped(image: Column, steps: list[tuple[str, dict]], seed: Column | None = None) -> Column:
    """A PNG of the image after the named steps; null for what isn't an image. Without a seed it shares a Python worker with what makes the image."""
    for name, _ in steps:
        if name not in STEPS:
            raise KeyError(f"unknown step {name!r}; known: {', '.join(STEPS)}")

    def one(raw, k):
        found = decode(raw)
        for i, (name, parameters) in enumerate(steps if found is not None else ()):
            found = STEPS[name](found, f"{k}\x1f{i}", **parameters)
        return None if found is None else encode(found)

    @pandas_udf(BinaryType())
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([one(d, k) for d, k in zip(data, key, strict=True)], dtype=object)

    @pandas_udf(BinaryType())
    def alone(data: pd.Series) -> pd.Series:
        return pd.Series([one(d, "") for d in data], dtype=object)

    return alone(image) if seed is None else run(image, seed.cast("string"))


def grids(rows: DataFrame, key: str, order: str, image: str, side: int, most: int = 4) -> DataFrame:
    """key, grid: a PNG of each key's first images by order, of those that can be read; no more than ``most`` rows of a key meet."""
    first = W.partitionBy(key).orderBy(order)
    kept = rows.select(key, order, image).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        images = [i for i in map(decode, pdf.sort_values("_r")[image]) if i is not None]
        return pd.DataFrame([(pdf[key].iloc[0], encode(grid(images, side)))] if images else [], columns=[key, "grid"])

    return kept.groupBy(key).applyInPandas(make, f"`{key}` {kinds[key]}, grid binary")


def _listed(raw: bytes | None) -> list[int] | None:
    found = decode(raw)
    return None if found is None else [*found.shape, *found.ravel().tolist()]


@pandas_udf(ArrayType(IntegerType()))
def samples(image: pd.Series) -> pd.Series:
    """Height, width, channels and all samples of an image, row by row."""
    return image.map(_listed)


def signed_samples(image: Column) -> Column:
    """As samples(), of PNGs alone; others give null. A filter on the result stays behind it, so that Spark makes the images once."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([_listed(d) if d is not None and d[:8] == SIGNATURE else None for d in data], dtype=object)

    return run.asNondeterministic()(image)


@pandas_udf(BinaryType())
def see_through(image: pd.Series) -> pd.Series:
    """Every four samples of a graymap as one pixel of colour and alpha: a PNG of half the width and height."""

    def one(raw):
        found = decode(raw)
        return None if found is None else encode(found.reshape(found.shape[0] // 2, found.shape[1] // 2, 4))

    return image.map(one)
