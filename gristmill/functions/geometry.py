"""Boxes (arrays x1, y1, x2, y2), windows, tiles and token arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.arrays import bound


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, v))


def _axis(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """Of whole numbers inside the scale, an empty extent grows by one, to the left at the far edge."""
    empty = b <= a
    return F.when(empty & (a >= scale), scale - 1).otherwise(a), F.when(empty & (a >= scale), scale).when(empty, a + 1).otherwise(b)


def scaled_box(x1: Column, y1: Column, x2: Column, y2: Column, scale: int = 1000) -> Column:
    """Whole numbers, half to even, inside the scale; an empty extent grows by one. Each end is computed once."""

    def whole(v):
        (a, c), (b, d) = _axis(v[0], v[2], scale), _axis(v[1], v[3], scale)
        return F.array(a, b, c, d)

    return bound(F.array(*(F.rint(clamp(v, 0.0, float(scale))).cast("int") for v in (x1, y1, x2, y2))), whole)


def scale_unit_box(box: Column, scale: int = 1000) -> Column:
    return scaled_box(*(box[i] * scale for i in range(4)), scale)


def normalize_box(box: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """Ends in order, inside the image, scaled; null if nothing is left or the image is empty.

    box, width and height are computed once.
    """

    def inside(v):
        w, h = v["w"].cast("double"), v["h"].cast("double")
        x = [clamp(v["b"][i].cast("double"), 0.0, w) for i in (0, 2)]
        y = [clamp(v["b"][i].cast("double"), 0.0, h) for i in (1, 3)]
        return F.struct(v["w"].alias("w"), v["h"].alias("h"), F.least(*x).alias("x1"), F.greatest(*x).alias("x2"), F.least(*y).alias("y1"), F.greatest(*y).alias("y2"))

    def scaled(v):
        good = (v["w"] > 0) & (v["h"] > 0) & (v["x2"] > v["x1"]) & (v["y2"] > v["y1"])
        ends = (scale * v[n] / v[side].cast("double") for n, side in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h")))
        return F.when(good, scaled_box(*ends, scale))

    return bound(bound(F.struct(box.alias("b"), width.alias("w"), height.alias("h")), inside), scaled)


def unscale(box: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    return F.array(*(box[i].cast("double") * (width, height)[i % 2] / scale for i in range(4)))


def valid_box(box: Column) -> Column:
    """Four finite numbers and a positive area."""
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return (F.size(box) == 4) & finite & (box[2] > box[0]) & (box[3] > box[1])


def center(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0)


def point_in_box(x: Column, y: Column, box: Column, inclusive: bool = True) -> Column:
    if inclusive:
        return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    return (x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3])


def iou(a: Column, b: Column, pixel: int = 0) -> Column:
    """Intersection over union; pixel=1 counts both end pixels."""

    def area(x1, y1, x2, y2):
        return F.greatest(x2 - x1 + pixel, F.lit(0)) * F.greatest(y2 - y1 + pixel, F.lit(0))

    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*(a[i] for i in range(4))) + area(*(b[i] for i in range(4))) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def edge_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Distance between the nearest edges as a share of the image's diagonal."""
    zero = F.lit(0)
    dx, dy = F.greatest(b[0] - a[2], a[0] - b[2], zero), F.greatest(b[1] - a[3], a[1] - b[3], zero)
    return F.hypot(dx.cast("double"), dy.cast("double")) / F.hypot(width.cast("double"), height.cast("double"))


def polygon_box(points: Column) -> Column:
    """Of an array of (x, y) arrays; null for fewer than three points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) >= 3, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


# Fixed values of a link between a description and a detected text.
LEAST_CONFIDENCE, LEAST_SIMILARITY, MOST_DISTANCE = 0.20, 0.68, 0.22
NEAR_EXACT, NEAR_EXACT_FACTOR = 0.92, 1.5
SIMILARITY_WEIGHT, SPATIAL_WEIGHT, CONFIDENCE_WEIGHT, OVERLAP_WEIGHT = 0.72, 0.18, 0.07, 0.03


def allowed_distance(similarity: Column) -> Column:
    return F.when(similarity >= NEAR_EXACT, MOST_DISTANCE * NEAR_EXACT_FACTOR).otherwise(MOST_DISTANCE)


def match_score(similarity: Column, distance: Column, confidence: Column, overlap: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - distance / allowed_distance(similarity))
    return (
        SIMILARITY_WEIGHT * similarity
        + SPATIAL_WEIGHT * near
        + CONFIDENCE_WEIGHT * clamp(confidence, 0.0, 1.0)
        + OVERLAP_WEIGHT * F.least(F.lit(1.0), overlap * 4.0)
    )


def crop_range(lo: Column, hi: Column, size: Column, crop: int) -> tuple[Column, Column, Column]:
    """First and last possible start, and length, of a window along one axis that holds the target [lo, hi]."""
    length = F.least(size, F.greatest(F.lit(crop), F.ceil(hi - lo).cast("int") + 64))
    first = F.greatest(F.lit(0), F.ceil(hi).cast("int") - length)
    last = F.least(F.floor(lo).cast("int"), size - length)
    first = F.least(first, F.greatest(last, F.lit(0)))
    return first, F.greatest(first, last), length


def crop_axis(lo: Column, hi: Column, size: Column, crop: int, u: Column | None = None) -> tuple[Column, Column]:
    """Start and length of a window along one axis that holds the target [lo, hi].

    In the middle of the starts that are possible, half to even, or at the share u of them.
    """
    first, last, length = crop_range(lo, hi, size, crop)
    if u is None:
        return F.rint((first + last) / 2.0).cast("int"), length
    return first + F.floor(u * (last - first + 1)).cast("int"), length


def tile_layout(width: Column, height: Column, tile: int = 980, patch: int = 14) -> Column:
    """Tiles in row-major order with their patch grids."""
    cols, rows = F.ceil(width / tile).cast("int"), F.ceil(height / tile).cast("int")

    def one(i):
        x, y = (i % cols) * tile, F.floor(i / cols).cast("int") * tile
        w, h = F.least(F.lit(tile), width - x), F.least(F.lit(tile), height - y)
        gw, gh = F.ceil(w / patch).cast("int"), F.ceil(h / patch).cast("int")
        box = F.array(x, y, x + w, y + h)
        return F.struct(i.alias("index"), box.alias("box_xyxy"), gw.alias("grid_width"), gh.alias("grid_height"), (gw * gh).alias("patch_tokens"))

    return F.when((width > 0) & (height > 0), F.transform(F.sequence(F.lit(0), cols * rows - 1), one))


def sequence_tokens(patches: Column, tiles: Column, prompt: Column, generation: int = 64) -> Column:
    """Patches, two marks a tile, the prompt with two marks, the generation."""
    return patches + 2 * tiles + (prompt + 2) + generation


def context_bucket(tokens: Column) -> Column:
    """Fixed bounds of context lengths; null stays null."""
    return (
        F.when(tokens.isNull(), None).when(tokens <= 32768, "16k_32k").when(tokens <= 49152, "32k_48k").when(tokens <= 65536, "48k_64k").otherwise("over_64k")
    )


def resize_dims(width: Column, height: Column, longest: int, shortest: int, stride: int, most_pixels: int, images: int = 1) -> Column:
    """(width, height) after scaling to the edges' limits in steps of the stride, within the pixel budget."""
    w, h = width.cast("double"), height.cast("double")
    scale = F.least(F.lit(float(longest)) / F.greatest(w, h), F.lit(1.0))
    scale = F.greatest(scale, F.lit(float(shortest)) / F.least(w, h))
    step = lambda v: F.greatest(F.lit(stride), F.rint(v / stride).cast("int") * stride)
    w1, h1 = step(w * scale), step(h * scale)
    over = w1 * h1 > most_pixels // images
    shrink = F.sqrt(F.lit(most_pixels / images) / (w1 * h1))
    w2, h2 = F.when(over, step(w1 * shrink)).otherwise(w1), F.when(over, step(h1 * shrink)).otherwise(h1)
    long = F.greatest(w2, h2)
    cut = F.when(long > longest, F.lit(float(longest)) / long).otherwise(1.0)
    return F.array(step(w2 * cut), step(h2 * cut))


def image_tokens(width: Column, height: Column, stride: int) -> Column:
    return F.floor(width * height / (stride * stride)).cast("long")


def relative_positions(a: Column, b: Column, dead_zone: float = 0.1) -> Column:
    """Names of where a lies of b: offsets beyond the dead zone, over the whole offset's length, beyond a half."""
    offset = [(a[i] + a[i + 2]) / 2.0 - (b[i] + b[i + 2]) / 2.0 for i in (0, 1)]
    sizes = [F.abs(a[i + 2] - a[i]) + F.abs(b[i + 2] - b[i]) for i in (0, 1)]
    left = [F.greatest(F.abs(o) - dead_zone * s, F.lit(0.0)) * F.signum(o) for o, s in zip(offset, sizes, strict=True)]
    length = F.hypot(offset[0], offset[1])
    still = (F.abs(left[0]) < 1e-3) & (F.abs(left[1]) < 1e-3)
    dx, dy = (F.when(still, 0.0).otherwise(v / length) for v in left)
    names = F.array(F.when(dx < -0.5, "left of"), F.when(dx > 0.5, "right of"), F.when(dy < -0.5, "above"), F.when(dy > 0.5, "below"))
    return F.array_compact(names)


def length_weight(n: Column, mode: str) -> Column:
    """Loss weight of a sample of n tokens."""
    if mode == "token":
        return F.lit(1.0)
    if mode not in ("sample", "square"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(n == 0, 0.0).otherwise(F.lit(1.0) / (n if mode == "sample" else F.sqrt(n)))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is greater."""
    return F.when(n <= 0, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long"))))).cast("long")


def even_split(total: Column, parts: Column) -> Column:
    """Sizes that differ by one at most, the larger ones first."""
    base, more = F.floor(total / parts).cast("long"), total % parts
    return F.transform(F.sequence(F.lit(1), parts.cast("int")), lambda i: base + F.when(i <= more, 1).otherwise(0))


def chunk_count(total: Column, u: Column, least: int = 16, most: int = 512) -> Column:
    """A number of chunks, a power of two that keeps their size in bounds, smaller ones likelier; u in [0, 1) decides."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.pow(F.lit(2.0), i))
    valid = F.filter(powers, lambda k: (k >= total / most) & (k <= total / least))
    weight = F.aggregate(valid, F.lit(0.0), lambda acc, k: acc + 1.0 / (2.0 * k))

    def step(acc, k):
        reached = acc["sum"] + 1.0 / (2.0 * k)
        take = acc["k"].isNull() & (u * weight < reached)
        return F.struct(reached.alias("sum"), F.when(take, k).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("k"))
    chosen = F.aggregate(valid, start, step, lambda acc: acc["k"])
    return F.when(total <= least, 1).otherwise(F.coalesce(chosen, F.element_at(valid, -1))).cast("int")


def timesteps(n: int, shift: float) -> Column:
    """n shifted steps from 1 down to 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (lambda t: shift * t / (1 + (shift - 1) * t))(1.0 - i / float(n)))


def flat_positions(rows: Column, cols: Column, most: int) -> Column:
    """Ids r * most + c of a grid's cells, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: r * most + c)))


def spread_positions(rows: Column, cols: Column, most: int) -> Column:
    """Ids of a grid's cells, row by row, as if it were stretched over a grid of most x most."""
    at = lambda i, n: F.floor(i * most / n)
    each = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: at(r, rows) * most + at(c, cols)))
    return F.flatten(each)


def adaptive_length(n: Column) -> Column:
    """Three quarters of the next power of two, or that power beyond them."""
    power = next_power_of_two(n)
    part = F.floor(power * 3 / 4)
    return F.when(n > part, power).otherwise(part).cast("long")


def guided_scale(t: Column, scale: Column, low: float, high: float) -> Column:
    """A guidance scale inside its interval of steps, 1 outside; the lower end is outside."""
    return F.when((t > low) & (t <= high), scale).otherwise(1.0)


def quarter_crops(side: Column, n: Column) -> Column:
    """The first n crops of a picture of four, row by row; none for a single one."""
    cell = lambda i: F.array(*(F.lit(v) * side for v in (i % 2, i // 2, i % 2 + 1, i // 2 + 1)))
    every = F.array(*(cell(i) for i in range(4)))
    return F.when(n <= 1, F.slice(every, 1, 0)).otherwise(F.slice(every, 1, F.least(n, F.lit(4))))


def box_list(box: Column) -> Column:
    """A box as a list is written: [1.0, 2.5]."""
    return F.concat(F.lit("["), F.array_join(F.transform(box, lambda v: v.cast("double").cast("string")), ", "), F.lit("]"))
