"""Copies among images by local descriptors.

Corners (Harris) are found at two scales; the strongest, in proportion to the area, are kept. Each gets an
orientation from the intensity around it, and 128 binary tests rotated by it. Descriptors are cut into four
32-bit keys, one for each Hamming table, so two that differ in up to three bits share a key for certain. Tables
are built in two passes over packed keys dealt into buckets: one finds the keys that several images have, the other
lists the points under these. In a table entry every image is matched with a pivot image; pairs with enough matches
are compared by all their points, whose matches vote for a rotation, scale and shift, and images with enough agreeing
points, a share of the smaller image's, are copies. Images that linked become one class; entries that are still in
several classes, however long they are, then give the pairs across classes: an image's most crowded points need not look
for partners, as far as enough others are left to find every image that could agree. Entries of more than ``BLOCK``
points are dealt into blocks, and every two blocks of an entry meet in a task of their own.

An image is a two-dimensional array of bytes, in a column as a binary portable graymap (P5). Defined results for
odd input: null, empty or undecodable images have no keypoints and are copies of nothing; images with equal pixels
are copies; repeated rows get one class; a row without id has none; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm import hashing
from gristmill.llm._shared import discard, pieces, table, written
from gristmill.llm.graphs import components, dealt_blocks

RADIUS, MARGIN, TURNS, TESTS = 7, 11, 32, 128
AREA_PER_POINT, LEAST_POINTS = 3072, 16
MAX_DISTANCE, LEAST_INLIERS, LEAST_SHARE, SHIFT = 20, 4, 0.3, 16
#: Points of an entry that meet in one task, and points of one class that a task holds while no other class has come.
BLOCK, HELD = 1024, 1 << 16
#: Of the points that must agree, how many have to be found before two images of different classes are compared.
SPARE = 3
#: Pixels of images that are described together, and of a stack of images of one shape.
TOGETHER, STACK = 1 << 23, 1 << 16
#: Pairs of points that a task compares at once, and most matches that it holds for more than one pair of images.
PAIRS_AT_ONCE, MATCHES_AT_ONCE = 1 << 18, 1 << 20
#: Bits of a table's key with the table's number; keys that a task packs at once; keys of a bucket, and least buckets.
KEY_BITS, GROUP_KEYS, BUCKET_KEYS, LEAST_BUCKETS = 34, 1 << 20, 1 << 21, 64

_rng = np.random.default_rng(11)
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = np.stack([_y[_x**2 + _y**2 <= RADIUS**2], _x[_x**2 + _y**2 <= RADIUS**2]])
_TURN = np.arange(TURNS) * (2 * math.pi / TURNS)
_pairs = np.clip(_rng.normal(0, RADIUS / 2, (2, TESTS, 2)), -RADIUS, RADIUS)
#: (turn, end, test, (y, x)): the tests' places at every orientation.
_PLACES = np.rint(
    np.stack([_pairs @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) for t in _TURN])
).astype(np.int64)


@lru_cache(maxsize=64)
def _steps(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The disc in a flat image of a width, and the tests' places in its sums, which are two columns fewer."""
    return _DISC[0] * width + _DISC[1], _PLACES[..., 0] * (width - 2) + _PLACES[..., 1]


def encode_graymap(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_graymap(data: bytes | None) -> np.ndarray | None:
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m or len(data) - m.end() < int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(data, np.uint8, int(m[1]) * int(m[2]), m.end()).reshape(int(m[2]), int(m[1]))


def _box(a: np.ndarray) -> np.ndarray:
    """Sums over 3 x 3 places; two rows and columns fewer."""
    a = a[..., :-2, :] + a[..., 1:-1, :] + a[..., 2:, :]
    return a[..., :-2] + a[..., 1:-1] + a[..., 2:]


def _points(levels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a stack of images: image, row and column of the n strongest corners of each away from the border."""
    gx, gy = levels[:, 1:-1, 2:] - levels[:, 1:-1, :-2], levels[:, 2:, 1:-1] - levels[:, :-2, 1:-1]
    xy = _box(gx * gy)
    gx *= gx
    gy *= gy
    xx, yy = _box(gx), _box(gy)
    xy *= xy
    r = xx * yy
    r -= xy
    xx += yy
    xx *= xx
    xx *= 0.05
    r -= xx
    m = MARGIN - 2
    rows = np.maximum(np.maximum(r[:, m - 1 : -m - 1], r[:, m + 1 : r.shape[1] - m + 1]), r[:, m : r.shape[1] - m])
    top = np.maximum(np.maximum(rows[..., m - 1 : -m - 1], rows[..., m + 1 : rows.shape[2] - m + 1]), rows[..., m : rows.shape[2] - m])
    inner = r[:, m : r.shape[1] - m, m : r.shape[2] - m]
    k, y, x = np.nonzero((inner == top) & (top > 0))
    best = np.lexsort((-inner[k, y, x], k))  # keeps the order of equal ones
    best = best[np.arange(len(k)) - np.searchsorted(k, k) < n]
    return k[best], y[best] + MARGIN, x[best] + MARGIN


def _stacked(images: np.ndarray, area: int) -> list[np.ndarray]:
    """keypoints() of images of one shape."""
    rows, of = [np.zeros((0, 6), np.int64)], [np.zeros(0, np.int64)]
    levels = images.astype(np.float32)
    for octave in range(2):
        h, w = levels.shape[1:]
        if min(h, w) < 2 * MARGIN + 3:
            break
        image, y, x = _points(levels, max(LEAST_POINTS, h * w // area))
        if len(y):
            disc, places = _steps(w)
            patch = levels.ravel().take(((image * h + y) * w + x)[:, None] + disc)
            angle = np.arctan2(patch @ _DISC[0].astype(np.float32), patch @ _DISC[1].astype(np.float32))
            turn = np.rint(angle / (2 * math.pi / TURNS)).astype(np.int64) % TURNS
            smooth = _box(levels)
            values = smooth.ravel().take(((image * (h - 2) + y - 1) * (w - 2) + x - 1)[:, None, None] + places[turn])
            bits = np.packbits(values[:, 0] < values[:, 1], axis=1).view("<i8").reshape(len(y), 2)
            k = 1 << octave
            rows.append(np.column_stack([x * k, y * k, np.full(len(y), octave), turn, bits]))
            of.append(image)
        if octave == 0:
            h, w = h // 2 * 2, w // 2 * 2
            levels = (levels[:, 0:h:2, 0:w:2] + levels[:, 0:h:2, 1:w:2] + levels[:, 1:h:2, 0:w:2] + levels[:, 1:h:2, 1:w:2]) * np.float32(0.25)
    rows, of = np.concatenate(rows), np.concatenate(of)
    return np.split(rows[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(images)))[:-1])


def all_keypoints(images: list[np.ndarray | None], area: int = AREA_PER_POINT) -> list[np.ndarray]:
    """keypoints() of each image; images of one shape are taken in stacks of up to STACK pixels."""
    out = [np.zeros((0, 6), np.int64)] * len(images)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, image in enumerate(images):
        if image is not None and image.ndim == 2 and image.size:
            shapes.setdefault(image.shape, []).append(i)
    for (h, w), places in shapes.items():
        step = max(1, STACK // (h * w))
        for lo in range(0, len(places), step):
            some = places[lo : lo + step]
            for i, found in zip(some, _stacked(np.stack([images[i] for i in some]), area), strict=True):
                out[i] = found
    return out


def keypoints(image: np.ndarray | None, area: int = AREA_PER_POINT) -> np.ndarray:
    """Rows (x, y, octave, turn, d0, d1); x and y in pixels of the image."""
    return all_keypoints([image], area)[0]


POINT = "struct<x:int,y:int,octave:int,turn:int,d0:long,d1:long>"
NAMES = ["x", "y", "octave", "turn", "d0", "d1"]
#: Order, and types, in which an image's points are packed, column after column.
LAYOUT = (("d0", "<i8"), ("d1", "<i8"), ("x", "<i4"), ("y", "<i4"), ("octave", "u1"), ("turn", "u1"))
POINT_BYTES = 26


def pack_points(columns: dict[str, np.ndarray]) -> bytes:
    return b"".join(columns[name].astype(kind).tobytes() for name, kind in LAYOUT)


def unpack_points(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(data) // POINT_BYTES, 0, {}
    for name, kind in LAYOUT:
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


def packed(described: DataFrame) -> DataFrame:
    """id, digest, points: binary; of rows whose points are arrays of POINT, or packed already."""
    if described.schema["points"].dataType.typeName() == "binary":
        return described

    def run(batches):
        for b in pieces(batches):
            flat = b.column(2).flatten()
            columns = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in NAMES}
            bounds = np.concatenate(([0], np.cumsum(b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
            data = [pack_points({name: c[lo:hi] for name, c in columns.items()}) for lo, hi in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["id", "digest", "points"])

    return described.select("id", "digest", "points").mapInArrow(run, "id long, digest binary, points binary")


def describe(
    rows: DataFrame, id_col: str, column: str, to_images: Callable = lambda values: map(decode_graymap, values), area: int = AREA_PER_POINT, pack: bool = False
) -> DataFrame:
    """id, digest (of the pixels, null without), points: array of POINT, or packed. to_images: column values to arrays or None."""
    import xxhash

    def groups(values):
        held, size = [], 0
        for image in to_images(values):
            held.append(image)
            size += 0 if image is None else image.size
            if size >= TOGETHER:
                yield held
                held, size = [], 0
        yield held

    def run(batches):
        for b in pieces(batches):
            digests, points = [], []
            for images in groups(b.column(1).to_pylist()):
                points += all_keypoints(images, area)
                for image in images:
                    some = image is not None and image.size
                    digests.append(xxhash.xxh3_128_digest(np.ascontiguousarray(image).tobytes() + b"%d" % image.shape[1]) if some else None)
            if pack:
                data = [pack_points(dict(zip(NAMES, p.T))) for p in points]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["id", "digest", "points"])
                continue
            flat = np.concatenate(points) if points else np.zeros((0, 6), np.int64)
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i].astype(k.to_pandas_dtype())) for i, k in enumerate(kinds)], NAMES)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in points]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), structs)], ["id", "digest", "points"]
            )

    return rows.select(rows[id_col].cast("long").alias("id"), rows[column]).mapInArrow(run, f"id long, digest binary, points {'binary' if pack else f'array<{POINT}>'}")


def _keys(points: np.ndarray) -> np.ndarray:
    """The four table keys of descriptors given as two 64-bit columns: 32 bits and the table's two, mixed one to one."""
    halves = np.ascontiguousarray(points).view("<u4").reshape(len(points), 4).astype(np.uint64)
    x = halves + (np.arange(4, dtype=np.uint64) << np.uint64(32))
    for odd in (0x2545F4915, 0x1B8735939):
        x ^= x >> np.uint64(17)
        x = x * np.uint64(odd) & np.uint64((1 << KEY_BITS) - 1)
    return x ^ (x >> np.uint64(17))


def _descriptors(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the descriptors of several images' packed points, and the images' numbers of points."""
    found = [unpack_points(d) for d in data]
    words = [np.concatenate([f[name] for f in found]) if found else np.zeros(0, np.int64) for name in ("d0", "d1")]
    return np.column_stack(words), np.array([len(f["d0"]) for f in found], np.int64)


def _groups(batches):
    """(keys, node, i) of the points of many images at once, ordered by key and node. An image is in one group alone."""
    held, n = [], 0
    for b in pieces(batches):
        points, sizes = _descriptors(b.column(0).to_pylist())
        if len(points):
            number = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append((_keys(points).ravel().astype(np.int64), np.repeat(b.column(1).to_numpy(), 4 * sizes), np.repeat(number, 4)))
            n += 4 * len(points)
        if n >= GROUP_KEYS:
            yield _ordered(held)
            held, n = [], 0
    if held:
        yield _ordered(held)


def _ordered(held: list) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def _pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as differences, and columns, byte by byte of equal weight, compressed."""
    rows = np.stack([np.diff(keys, prepend=0), *columns]).astype("<i8")
    planes = rows.view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, k: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 8 * n * k, codec="zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(k, n)
    return [np.cumsum(rows[0]), *rows[1:]]


def _bucketed(keys: np.ndarray, buckets: int):
    """(bucket, start, end) of ascending keys."""
    of = keys * buckets >> KEY_BITS
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(keys)])).tolist()
    yield from zip(of[cuts[:-1]].tolist(), cuts, cuts[1:])


PACKED = "bucket long, kind int, at long, n int, data binary"


def _packed_batch(rows: list):
    return pa.RecordBatch.from_pydict(
        {name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate(zip(("bucket", "kind", "at", "n", "data"), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())))}
    )


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=-1))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, points, whether several images have them: of parts that hold different images."""
    keys, counts, several = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts, several = keys[order], counts[order], several[order]
    first = _runs(keys)
    if not len(first):
        return keys, counts, several
    return keys[first], np.add.reduceat(counts, first), np.maximum.reduceat(several, first) | (np.diff(np.append(first, len(keys))) > 1)


def _shared_keys(nodes: DataFrame, buckets: int) -> DataFrame:
    """The keys that several images have, with their numbers of points, packed by bucket.

    A task holds the distinct keys of one bucket, however many images have one of them.
    """

    def listed(batches):
        for keys, node, _ in _groups(batches):
            first = _runs(keys)
            counts = np.diff(np.append(first, len(keys)))
            several = np.maximum.reduceat(node, first) != np.minimum.reduceat(node, first)
            own = keys[first]
            yield _packed_batch([(bucket, 0, 0, hi - lo, _pack(own[lo:hi], counts[lo:hi], several[lo:hi])) for bucket, lo, hi in _bucketed(own, buckets)])

    def reduced(batches):
        bucket, parts, held = None, [], 0

        def done():
            keys, counts, several = _merged(parts)
            some = several.astype(bool)
            return [(bucket, 0, 0, int(some.sum()), _pack(keys[some], counts[some]))] if some.any() else []

        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    if parts and (out := done()):
                        yield _packed_batch(out)
                    bucket, parts, held = row["bucket"], [], 0
                parts.append(_unpack(row["data"], row["n"], 3))
                held += row["n"]
                if held > BUCKET_KEYS:
                    parts = [_merged(parts)]
                    held = 0
        if parts and (out := done()):
            yield _packed_batch(out)

    dealt = nodes.select("points", "node").mapInArrow(listed, PACKED)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduced, PACKED)


def _entries(nodes: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """entry, node, i, m, pivot, j: points under keys that several images have, the key's number of points, and its pivot.

    An entry's pivot is the point that came first, of an image early in the order of groups of images; only rows of shared
    keys leave the task, which holds the shared keys of one bucket and streams everything else.
    """

    def listed(batches):
        for own, node, i in _groups(batches):
            at = int(node.min())
            yield _packed_batch([(bucket, 1, at, hi - lo, _pack(own[lo:hi], node[lo:hi], i[lo:hi])) for bucket, lo, hi in _bucketed(own, buckets)])

    def found(batches):
        bucket, shared = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    bucket, (shared, counts) = row["bucket"], _unpack(row["data"], row["n"], 2)
                    pivot, j, fresh = np.zeros_like(shared), np.zeros_like(shared), np.ones(len(shared), bool)
                    continue
                if row["bucket"] != bucket:
                    continue  # no key of its bucket is shared
                own, node, i = _unpack(row["data"], row["n"], 3)
                at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                hit = shared[at] == own
                at, node, i = at[hit], node[hit], i[hit]
                first = _runs(at)
                first = first[fresh[at[first]]]
                pivot[at[first]], j[at[first]], fresh[at[first]] = node[first], i[first], False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared[at]), pa.array(node), pa.array(i.astype(np.int32)), pa.array(counts[at]), pa.array(pivot[at]), pa.array(j[at].astype(np.int32))],
                    ["entry", "node", "i", "m", "pivot", "j"],
                )

    dealt = nodes.select("points", "node").mapInArrow(listed, PACKED).union(keys)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "kind", "at")
    return dealt.mapInArrow(found, "entry long, node long, i int, m long, pivot long, j int")


def _candidates(matches: DataFrame, least: int) -> DataFrame:
    """(a, b) of two images of which at least so many points of a match; matches: a, b, i (the point of a)."""
    dealt = matches.repartition("a", "b").distinct()
    return dealt.groupBy("a", "b").count().filter(F.col("count") >= least).select("a", "b")


def _groups_of_pairs(ones: list[bytes], others: list[bytes]):
    """(start, end) of pairs of images whose matches are held together: all their points may match, as in pages of one word."""
    lo = held = 0
    for i, (p, q) in enumerate(zip(ones, others)):
        size = len(p) // POINT_BYTES * (len(q) // POINT_BYTES)
        if held + size > MATCHES_AT_ONCE and i > lo:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(ones):
        yield lo, len(ones)


def _matches(ones: list[bytes], others: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each two images: the points of the one and of the other that match, if enough of the one's do; else none."""
    if not ones:
        return []
    p, q = ([unpack_points(d) for d in side] for side in (ones, others))
    n, k = (np.array([len(f["x"]) for f in side], np.int64) for side in (p, q))
    bits = [np.column_stack([np.concatenate([f[name] for f in side]) for name in ("d0", "d1")]) for side in (p, q)]
    words = [b.view("<u4") for b in bits]
    first, other = np.cumsum(n) - n, np.cumsum(k) - k
    pair = np.repeat(np.arange(len(n)), n)
    total = np.concatenate(([0], np.cumsum(k[pair])))
    found, lo = [], 0
    while lo < len(pair):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, "right")) - 1)
        of = pair[lo:hi]
        x = np.repeat(np.arange(lo, hi), k[of])
        y = np.arange(len(x)) - np.repeat(total[lo:hi] - total[lo] - other[of], k[of])
        meet = np.zeros(len(x), bool)
        for t in range(4):
            meet |= words[0][x, t] == words[1][y, t]
        x, y = x[meet], y[meet]
        near = np.bitwise_count((bits[0][x] ^ bits[1][y]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= MAX_DISTANCE
        found.append((x[near], y[near]))
        lo = hi
    x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    distinct = np.bincount(pair[x[np.diff(x, prepend=-1) != 0]], minlength=len(n))
    enough = distinct >= np.maximum(LEAST_INLIERS, LEAST_SHARE * np.minimum(n, k))
    cuts = np.searchsorted(pair[x], np.arange(len(n) + 1)).tolist()
    none = np.zeros(0, np.int64)
    return [(x[lo:hi] - a, y[lo:hi] - b) if some else (none, none) for lo, hi, a, b, some in zip(cuts, cuts[1:], first.tolist(), other.tolist(), enough.tolist())]


def _agree(one: bytes, other: bytes, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether enough of the points of two images that match do so under one rotation, scale and shift."""
    if not len(x):
        return False
    p, q = ([d[name] for name in NAMES] for d in (unpack_points(one), unpack_points(other)))
    need = max(LEAST_INLIERS, LEAST_SHARE * min(len(p[0]), len(q[0])))
    px, py, po, pt = (c[x].astype(np.int64) for c in p[:4])
    qx, qy, qo, qt = (c[y].astype(np.int64) for c in q[:4])
    turn, scale = (qt - pt) % TURNS, 2.0 ** (qo - po)
    angle = turn * (2 * math.pi / TURNS)
    dx = qx - scale * (px * np.cos(angle) - py * np.sin(angle))
    dy = qy - scale * (px * np.sin(angle) + py * np.cos(angle))
    place = ((py << 20) + px << 1) + po
    # Two grids, half a cell apart, so that no shift is always on a border.
    for g in (0, SHIFT // 2):
        cells = [turn, qo - po, np.floor((dx + g) / SHIFT).astype(np.int64), np.floor((dy + g) / SHIFT).astype(np.int64)]
        votes = np.unique(np.column_stack([*cells, place]), axis=0)
        models = np.flatnonzero((np.diff(votes[:, :4], axis=0, prepend=votes[:1, :4] - 1) != 0).any(axis=1))
        if np.diff(np.append(models, len(votes))).max() >= need:
            return True
    return False


def _links(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose points agree; points are fetched once for each image of a pair."""
    own = nodes.select("node", "points")

    def run(batches):
        for b in pieces(batches):
            p, q = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for lo, hi in _groups_of_pairs(p, q):
                keep += [_agree(*images, *meet) for *images, meet in zip(p[lo:hi], q[lo:hi], _matches(p[lo:hi], q[lo:hi]))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    fetched = candidates.join(own.withColumnRenamed("node", "a").withColumnRenamed("points", "p"), "a")
    fetched = fetched.join(own.withColumnRenamed("node", "b").withColumnRenamed("points", "q"), "b")
    return fetched.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _open(classed: DataFrame) -> DataFrame:
    """The rows of entries in several classes, with a few of one class where an entry is longer than a task holds."""

    def run(batches):
        held, passed = None, None  # rows of an entry that may go on, and one whose rows all pass
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            yield several([c[:cut] for c in columns], passed)
            held = [c[cut:].copy() for c in columns]
            if len(held[0]) > HELD:
                passed = held[0][0]
                yield several(held, passed)
                held = None
        if held is not None:
            yield several(held, passed)

    def several(columns, passed):
        entry, of = columns[0], columns[4]
        if len(entry):
            starts = np.flatnonzero(np.diff(entry, prepend=entry[0] - 1))
            keep = np.repeat(np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts), np.diff(np.append(starts, len(entry))))
            if passed is not None:
                keep |= entry == passed
            columns = [c[keep] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["entry", "node", "i", "m", "class", "n"]
    dealt = classed.repartition("entry").sortWithinPartitions("entry")
    return dealt.select(*names).mapInArrow(run, "entry long, node long, i int, m long, class long, n int")


def _opened(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of open entries, with their point's descriptor and its rank r among its image's, the most crowded first."""
    rows = rows.repartition("node")
    rows = rows.withColumn("most", F.max("m").over(Window.partitionBy("node", "i")))
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("most"), "i")) - 1
    rows = rows.select("entry", "node", "i", "m", "class", "n", rank.alias("r")).join(nodes.select("node", "points"), "node")
    word = lambda at: F.substring("points", 8 * at + 1, F.lit(8))  # noqa: E731  see LAYOUT
    return rows.select("entry", "node", "i", "m", "class", "n", "r", F.concat(word(F.col("i")), word(F.col("n") + F.col("i"))).alias("bits"))


def _near(entry, first, second, own, node, i, of, n, r, bits):
    """(a, b, i of a) of the rows that may match, of whole pairs of blocks in order of their nodes; see _across()."""
    starts = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in (entry, first, second)], axis=0))
    sizes = np.diff(np.append(starts, len(entry)))
    need = lambda n: np.maximum(LEAST_INLIERS, np.ceil(n * LEAST_SHARE)) - SPARE
    later = np.repeat(starts + sizes, sizes) - np.arange(len(entry)) - 1
    later[r < need(np.minimum(n, np.repeat(np.minimum.reduceat(n, starts), sizes)))] = 0
    total = np.concatenate(([0], np.cumsum(later)))
    lo = 0
    while lo < len(entry):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, "right")) - 1)
        x = np.repeat(np.arange(lo, hi), later[lo:hi])
        y = x + 1 + np.arange(len(x)) - (total[x] - total[lo])
        wanted = (of[x] != of[y]) & (r[x] >= need(np.minimum(n[x], n[y]))) & ((first[x] == second[x]) | (own[x] != own[y]))
        x, y = x[wanted], y[wanted]
        near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= MAX_DISTANCE
        x, y = x[near], y[near]
        if len(x):
            yield node[x], node[y], i[x]
        lo = hi


def _across(opened: DataFrame, block: int) -> DataFrame:
    """Matches (a, b, i) of images of different classes, without the most crowded points of a.

    Images that are copies have t points of a or more that agree. At most t - SPARE of these rank before t - SPARE, so
    SPARE of them or more are found when only the others look for partners. Points match if few enough of their bits
    differ; a task compares two blocks of an entry at a time, in numpy, and only matches leave it.
    """
    names = ("entry", "_i", "_j", "_own", "node", "i", "class", "n", "r")

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            bits = b.column(len(names))
            bits = np.frombuffer(bits.buffers()[2], "<u8", 2 * len(bits), 16 * bits.offset).reshape(-1, 2)
            columns = [*(b.column(k).to_numpy() for k in range(len(names))), bits]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            open_rows = np.all([c == c[-1] for c in columns[:3]], axis=0)  # of two blocks whose rows may go on
            cut = int(np.argmax(open_rows))
            if cut:
                yield from found([c[:cut] for c in columns])
            held = [c[cut:].copy() for c in columns]
        if held is not None:
            yield from found(held)

    def found(columns):
        for a, b, i in _near(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(i)], ["a", "b", "i"])

    dealt = dealt_blocks(opened, "entry", "m", block).sortWithinPartitions("entry", "_i", "_j", "node")
    return dealt.select(*names, "bits").mapInArrow(run, "a long, b long, i int")


def copies(described: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, n_points, class_id: the least id of the images that copies lead to. described: of describe()."""
    described = written(packed(described), "points")
    n_points = (F.octet_length("points") / POINT_BYTES).cast("int")
    nodes = (
        described.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("node"), F.first("points").alias("points"))
        .withColumn("n", n_points)
    )
    nodes = written(nodes, "nodes")
    rows = written(described.select("id", "digest", n_points.alias("n_points")), "images")
    discard(described)
    n_keys = 4 * (nodes.agg(F.sum("n")).first()[0] or 0)
    buckets = max(LEAST_BUCKETS, -(-n_keys // BUCKET_KEYS))
    keys = written(_shared_keys(nodes, buckets), "keys")
    shared = written(_entries(nodes, keys, buckets), "shared")
    discard(keys)
    low = F.col("node") < F.col("pivot")
    stars = shared.filter("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.when(low, F.col("i")).otherwise(F.col("j")).alias("i")
    )
    pairs = written(_candidates(stars, LEAST_INLIERS), "pairs")
    links = written(_links(pairs, nodes), "links")
    found = components(links)

    classed = shared.select("entry", "node", "i", "m").join(nodes.select("node", "n"), "node").join(found, "node", "left")
    classed = written(_open(classed.select("entry", "node", "i", "m", "n", F.coalesce("component", "node").alias("class"))), "classed")
    discard(shared)
    opened = written(_opened(classed, nodes), "open")
    discard(classed)
    matches = written(_across(opened, block), "matches")
    discard(opened)
    pairs = written(_candidates(matches, SPARE), "pairs")
    discard(matches)
    rest = written(_links(pairs, nodes), "links")
    if not rest.isEmpty():
        found = components(links.union(rest))
    by_digest = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    out = rows.join(by_digest, "digest", "left")
    return out.select("id", F.col("n_points").cast("long").alias("n_points"), F.coalesce("class", "id").alias("class_id"))


TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
#: Words a line, cells a word's side, pixels a cell's side, and the area of such an image that gets a keypoint.
WORDS_A_LINE, CELLS, CELL, PAGE_AREA = 16, 4, 1, 768
#: Blank pixels around a page, so that words at its edges and pages of one line have keypoints.
FRAME = MARGIN + 1


def render_pages(pages: list[str | None]):
    """Pages as images of their visible words, in lines of sixteen; a word's hash draws its pattern of gray cells."""
    texts = [TAG.sub(" ", p) if p else None for p in pages]
    shifts = np.arange(CELLS * CELLS, dtype=np.uint64) * np.uint64(2)
    for words, bounds, n in hashing.words_of(texts):
        for i in range(n):
            own = words[bounds[i] : bounds[i + 1]]
            if not len(own):
                yield None
                continue
            lines = -(-len(own) // WORDS_A_LINE)
            cells = np.zeros((lines * WORDS_A_LINE, CELLS * CELLS), np.uint8)
            cells[: len(own)] = ((own[:, None] >> shifts) & np.uint64(3)) * np.uint64(85)
            grid = cells.reshape(lines, WORDS_A_LINE, CELLS, CELLS).transpose(0, 2, 1, 3).reshape(lines * CELLS, WORDS_A_LINE * CELLS)
            yield np.pad(grid.repeat(CELL, axis=0).repeat(CELL, axis=1), FRAME)


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page drawn as an image, and the classes of copies among the images."""
    described = describe(table(spark, sf_dir, "pages"), "page_id", "html", render_pages, PAGE_AREA, pack=True)
    return copies(described).withColumnRenamed("id", "page_id")
