"""Image kernels against plain loops, and formats by round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import raster as R

RNG = np.random.default_rng(3)


def image(h, w, c):
    return RNG.integers(0, 256, (h, w, c), dtype=np.uint8)


def png(rows, w, h, colour, *extra):
    chunk = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
    return R.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + b"".join(chunk(k, p) for k, p in extra) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(pixels, kinds):
    """Rows as the format's filters tell them, one sample at a time."""
    h, w, c = pixels.shape
    flat, out = pixels.reshape(h, w * c).astype(int), b""
    for y in range(h):
        line = []
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            p = a + b - d
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
        out += bytes([kinds[y], *line])
    return out


@pytest.mark.parametrize("c,colour", [(1, 0), (3, 2), (4, 6)])
def test_every_filter_is_read(c, colour):
    x = image(10, 7, c)
    assert (R.decode(png(filtered(x, [0, 1, 2, 3, 4, 4, 3, 1, 2, 0]), 7, 10, colour)) == x).all()
    assert (R.decode(R.encode(x)) == x).all()


def test_palettes_clear_colours_and_other_formats():
    index = RNG.integers(0, 3, (2, 4, 1), dtype=np.uint8)
    colours = bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])
    plain, clear = (R.decode(png(filtered(index, [0, 0]), 4, 2, 3, (b"PLTE", colours), *more)) for more in ((), ((b"tRNS", bytes([0, 100])),)))
    assert plain.shape == (2, 4, 3) and clear.shape == (2, 4, 4)
    for y in range(2):
        for x in range(4):
            i = int(index[y, x, 0])
            assert plain[y, x].tolist() == list(colours[3 * i : 3 * i + 3]) and clear[y, x, 3] == (0, 100, 255)[i]
    grey_alpha = image(3, 3, 2)
    got = R.decode(png(filtered(grey_alpha, [0, 1, 4]), 3, 3, 4))
    assert (got[:, :, :3] == grey_alpha[:, :, :1]).all() and (got[:, :, 3] == grey_alpha[:, :, 1]).all()
    keyed = R.decode(png(filtered(image(2, 2, 3) * 0 + 5, [0, 0]), 2, 2, 2, (b"tRNS", bytes([0, 5, 0, 5, 0, 5]))))
    assert keyed.shape == (2, 2, 4) and (keyed[:, :, 3] == 0).all()
    assert R.decode(b"P6 2 1 255\n" + bytes(6)).shape == (1, 2, 3) and R.decode(b"P5\n1 1\n255\n\x07")[0, 0, 0] == 7
    for bad in (None, b"", b"GIF89a", b"P5 9 9 255\n12", R.SIGNATURE, R.SIGNATURE + b"xx", png(b"short", 2, 2, 0), png(bytes([9, 0, 0, 9, 0, 0]), 2, 2, 0)):
        assert R.decode(bad) is None


def test_flattening_and_grey():
    x = image(6, 5, 4)
    got, level = R.flattened(x), R.grey(x[:, :, :3])
    for y in range(6):
        for i in range(5):
            a = int(x[y, i, 3])
            assert got[y, i].tolist() == [round((int(v) * a + 255 * (255 - a)) / 255) for v in x[y, i, :3]]
            r, g, b = map(int, x[y, i, :3])
            assert (level[y, i] == (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536).all()
    assert R.grey(image(2, 2, 1)).shape == (2, 2, 1)


@pytest.mark.parametrize("size", [(7, 3), (20, 11), (1, 1), (13, 40), (12, 9)])
def test_resampling_equals_a_plain_sum(size):
    x = image(9, 12, 3)
    w, h = size

    def along(values, new):
        n, out = len(values), []
        scale = n / new
        wide = max(1.0, scale)
        for i in range(new):
            mid, weights, total = (i + 0.5) * scale, [], 0.0
            for j in range(max(0, int(mid - 2 * wide + 0.5)), min(n, int(mid + 2 * wide + 0.5))):
                t = abs((j - mid + 0.5) / wide)
                weights.append((j, 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0))
            norm = sum(v for _, v in weights)
            total = sum(values[j] * v / norm for j, v in weights)
            out.append(min(255, max(0, int(np.floor(total + 0.5)))))
        return out

    rows = np.array([[along(x[y, :, c].tolist(), w) if w != 12 else x[y, :, c].tolist() for c in range(3)] for y in range(9)]).transpose(0, 2, 1)
    want = np.array([[along(rows[:, i, c].tolist(), h) if h != 9 else rows[:, i, c].tolist() for c in range(3)] for i in range(w)]).transpose(2, 0, 1)
    got = R.resized(x, w, h)
    assert got.shape == (h, w, 3) and np.abs(got.astype(int) - want).max() <= 1 and (got == want).mean() > 0.98
    flat = np.full((9, 12, 1), 77, np.uint8)
    assert (R.resized(flat, w, h) == 77).all()


def test_patches_crops_and_blur():
    x = image(11, 13, 3)
    out = R.shuffled(x, 2, 3, "s", 0)
    assert out.shape == x.shape and not (out == x).all() and (R.shuffled(x, 2, 3, "s", 0) == out).all()
    assert R.shuffled(x, 2, 3, "s", 2).shape == (13, 17, 3)
    even = image(4, 6, 1)
    parts = lambda i: sorted(i[y : y + 2, z : z + 2].tobytes() for y in (0, 2) for z in (0, 2, 4))
    assert parts(R.shuffled(even, 2, 3, "k", 0)) == parts(even)
    holes = R.blanked(even * 0, 2, 3, "k", 0.5)
    assert (holes == 255).sum() == 12 and (R.blanked(even, 2, 3, "k", 0.1) == even).all()
    part = R.cropped(x, 4, 5, "q")
    assert any((x[y : y + 4, z : z + 5] == part).all() for y in range(8) for z in range(9))
    with pytest.raises(ValueError):
        R.cropped(x, 12, 5, "q")
    for size, angle in ((3, 0), (5, 90), (4, 37)):
        kernel = R.line_kernel(size, angle)
        assert kernel.sum() == pytest.approx(1) and (R.blurred(np.full((5, 6, 1), 9, np.uint8), size, angle) == 9).all()
    wide = np.concatenate([x[:, :1], x, x[:, -1:]], axis=1).astype(float)
    assert np.abs(R.blurred(x, 3, 0) - np.rint((wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]) / 3)).max() <= 1
    assert R.normalised(np.array([[[0, 255]]], np.uint8)).tolist() == [[[-1.0, 1.0]]]
    assert R.downscaled(x, 0.5).shape == (6, 6, 3) and R.downscaled(x, 0.001).shape == (1, 1, 3)


def test_steps_and_grids_on_tables(spark):
    images = [R.encode(image(8, 8, c)) for c in (1, 3, 4, 3, 1, 3)]
    rows = [("a", i, d) for i, d in enumerate(images)] + [("b", 9, b"none"), ("b", 10, images[0]), ("c", 11, None)]
    df = spark.createDataFrame(rows, "k string, i int, image binary")
    got = {r.k: R.decode(bytes(r.grid)) for r in R.grids(df, "k", "i", "image", 5).collect()}
    assert set(got) == {"a", "b"} and got["a"].shape == (10, 10, 3) and got["b"].shape == (5, 5, 3)
    for i in range(4):
        assert (got["a"][i // 2 * 5 :, i % 2 * 5 :][:5, :5] == R.resized(R.flattened(R.decode(images[i])), 5, 5)).all()
    steps = [("flatten", {}), ("grey", {}), ("downscale", {"factor": 0.5}), ("shuffle", {"rows": 2, "columns": 2, "gap": 1}), ("blank", {"rows": 2, "columns": 2}), ("crop", {"height": 2, "width": 2}), ("blur", {"size": 3})]
    once, again = ({r.i: r.o and hashlib.md5(r.o).hexdigest() for r in df.repartition(n).select("i", R.stepped(F.col("image"), steps, F.col("i")).alias("o")).collect()} for n in (1, 4))
    assert once == again and once[9] is None and once[11] is None and sum(v is not None for v in once.values()) == 7
    with pytest.raises(KeyError, match="unknown step"):
        R.stepped(F.col("image"), [("nothing", {})], F.col("i"))


def test_samples_of_signed_images_alone(spark):
    x = image(2, 4, 4)
    rows = [(1, R.encode(x)), (2, b"P5 1 1 255\n\x07"), (3, None), (4, b"none"), (5, R.encode(x[:, :, :1]))]
    df = spark.createDataFrame(rows, "i int, image binary")
    got = {r.i: r.p for r in df.select("i", R.signed_samples(R.stepped(F.col("image"), [])).alias("p")).filter("p IS NOT NULL").collect()}
    assert got == {1: [2, 4, 4, *x.ravel().tolist()], 2: [1, 1, 1, 7], 5: [2, 4, 1, *x[:, :, 0].ravel().tolist()]}
    assert [r.i for r in df.select("i", R.signed_samples(F.col("image")).alias("p")).filter("p IS NOT NULL").orderBy("i").collect()] == [1, 5]
