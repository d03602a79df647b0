import numpy as np

from gristmill.llm import media


def scene(seed, h=160, w=176):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h // 4, w // 4)).repeat(4, 0).repeat(4, 1).astype(np.uint8)


def classes(spark, images, **kw):
    df = spark.createDataFrame([(i, None if x is None else bytearray(media.encode_graymap(x)), "k") for i, x in images], "n long, digest binary, points string")
    return {r["id"]: r["class_id"] for r in media.copies(media.describe(df, "n", "digest"), **kw).collect()}


def test_descriptors_turn_with_the_image():
    a = scene(1)
    p, q = media.keypoints(a), media.keypoints(np.rot90(a).copy())
    near = lambda d: min(bin((int(d[4]) ^ int(e[4])) & (2**64 - 1)).count("1") + bin((int(d[5]) ^ int(e[5])) & (2**64 - 1)).count("1") for e in q)
    assert np.mean([near(d) <= media.MAX_DISTANCE for d in p]) > 0.5


def test_crops_edits_and_copies(spark):
    a, b, c = scene(1), scene(2), scene(3)
    edited = a.copy()
    edited[40:70, 40:90] = 128
    brighter = (b // 2 + 60).astype(np.uint8)
    images = [(10, a), (11, a[8:, 24:].copy()), (12, edited), (13, a), (20, b), (21, brighter), (30, c), (40, None), (41, np.zeros((50, 50), np.uint8)), (42, scene(4, 12, 12))]
    got = classes(spark, images)
    assert got == {10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 21: 20, 30: 30, 40: 40, 41: 41, 42: 42}


def test_many_copies_of_one_image(spark):
    rng = np.random.default_rng(0)
    images = []
    for i in range(60):
        x = scene(7)
        y0, x0 = rng.integers(0, 120, 2)
        x[y0 : y0 + 16, x0 : x0 + 16] = rng.integers(0, 256)
        images.append((i, x))
    images += [(100 + i, scene(50 + i)) for i in range(20)]
    got = classes(spark, images)
    assert all(got[i] == 0 for i in range(60))
    assert all(got[100 + i] == 100 + i for i in range(20))


def described(spark, images):
    """images: {node: [(x, y, descriptor)]}; equal descriptors share all four keys, others none."""
    word = lambda d, half: int(np.random.default_rng([d, half]).integers(-(2**63), 2**63 - 1))
    rows = [(i, bytearray(b"%d" % i), [(x, y, 0, 0, word(d, 0), word(d, 1)) for x, y, d in points]) for i, points in images.items()]
    return spark.createDataFrame(rows, f"id long, digest binary, points array<{media.POINT}>")


def scattered(seed, keys):
    return [(*map(int, np.random.default_rng([seed, d]).integers(0, 50_000, 2)), d) for d in keys]


def test_copies_that_share_keys_of_everyone_alone(spark):
    images = {i: scattered(i, range(6)) for i in range(80)}
    images[41] = [(x + 3, y, d) for x, y, d in images[40]]
    for block in (7, 1024):
        got = {r["id"]: r["class_id"] for r in media.copies(described(spark, images), block).collect()}
        assert got == {i: 40 if i == 41 else i for i in range(80)}


def test_evidence_of_short_and_long_entries_adds_up(spark):
    images = {i: scattered(i, range(6)) for i in (0, 1, 2, 99)}
    images[0], images[99] = scattered(0, (3, 4, 5)), scattered(99, (3, 4, 5))
    images[2] = [(x + 3, y, d) for x, y, d in images[1]]
    got = {r["id"]: r["class_id"] for r in media.copies(described(spark, images)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 99: 99}


def test_a_pivot_has_all_its_points(spark):
    near = [(1000 * i, 2000 * i * i, 0) for i in range(6)]
    images = {0: near, 1: [(x + 3, y, d) for x, y, d in near], 2: [(7, 7, 0)]}
    got = {r["id"]: r["class_id"] for r in media.copies(described(spark, images)).collect()}
    assert got[0] == got[1] == 0


def test_broken_and_empty_input(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"P5 9 9 255\nxx")), (None, bytearray(media.encode_graymap(scene(1))))], "n long, image binary")
    got = media.copies(media.describe(df, "n", "image")).collect()
    assert sorted((r["id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert media.copies(media.describe(df.limit(0), "n", "image")).count() == 0


def test_short_pages_with_an_edited_word(spark):
    pages = []
    for k, n in enumerate((16, 48, 90, 150)):
        own = [f"w{i}" for i in np.random.default_rng(k).integers(0, 3000, n)]
        pages += [(10 * k, " ".join(own)), (10 * k + 1, " ".join([*own[: n // 2], "edited", *own[n // 2 + 1 :]]))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r["id"]: r["class_id"] for r in media.copies(media.describe(df, "page_id", "html", media.render_pages, media.PAGE_AREA)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in pages}


def test_pages(spark):
    words = lambda seed, n: " ".join(np.random.default_rng(seed).choice([f"w{i}" for i in range(3000)], n))
    body = words(1, 320)
    pages = [
        (1, f"<p>{body}</p>"), (2, f"<html><style>p{{}}</style><b>{body}</b>"), (3, f"<p>{words(5, 32)} {body}</p>"), (4, f"<p>{words(2, 320)}</p>"),
        (5, None), (6, ""), (7, "<p></p>"), (8, "word " * 50_000),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r["id"]: r["class_id"] for r in media.copies(media.describe(df, "page_id", "html", media.render_pages, media.PAGE_AREA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    out = media.op10_media_copies(spark, "/root/testdata/sf0.001")
    assert out.columns == ["page_id", "n_points", "class_id"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_packed_keys_come_back():
    rng = np.random.default_rng(3)
    points = rng.integers(-(2**63), 2**63 - 1, (500, 2))
    keys = media._keys(points)
    assert keys.shape == (500, 4) and int(keys.max()) < 1 << media.KEY_BITS
    assert len(np.unique(keys)) == len({(t, w) for t in range(4) for w in np.ascontiguousarray(points).view("<u4").reshape(-1, 4)[:, t].tolist()})
    own = np.sort(keys.ravel().astype(np.int64))
    node, i = rng.integers(-5, 5, len(own)), rng.integers(0, 9, len(own))
    for got, sent in zip(media._unpack(media._pack(own, node, i), len(own), 3), (own, node, i)):
        assert (got == sent).all()
    cuts = list(media._bucketed(own, 64))
    assert cuts[0][1] == 0 and cuts[-1][2] == len(own) and all(a[2] == b[1] and a[0] < b[0] for a, b in zip(cuts, cuts[1:]))


def brute(images):
    """Classes by comparing every two images by all their points, one match at a time."""
    root = {i: i for i in images}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    bits = lambda v: bin(v & (2**64 - 1)).count("1")
    words = lambda p: [(p[d] >> s) & (2**32 - 1) for d in (4, 5) for s in (0, 32)]
    for a in images:
        for b in images:
            if a >= b:
                continue
            votes = {}
            for p in images[a]:
                for q in images[b]:
                    if bits(p[4] ^ q[4]) + bits(p[5] ^ q[5]) > media.MAX_DISTANCE or not any(x == y for x, y in zip(words(p), words(q))):
                        continue
                    turn, scale = (q[3] - p[3]) % media.TURNS, 2.0 ** (q[2] - p[2])
                    c, s = np.cos(turn * 2 * np.pi / media.TURNS), np.sin(turn * 2 * np.pi / media.TURNS)
                    dx, dy = q[0] - scale * (p[0] * c - p[1] * s), q[1] - scale * (p[0] * s + p[1] * c)
                    for g in (0, media.SHIFT // 2):
                        votes.setdefault((turn, q[2] - p[2], g, (dx + g) // media.SHIFT, (dy + g) // media.SHIFT), set()).add(tuple(p[:3]))
            n = min(len(images[a]), len(images[b]))
            if any(len(v) >= max(media.LEAST_INLIERS, media.LEAST_SHARE * n) for v in votes.values()):
                ra, rb = top(a), top(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: top(i) for i in images}


def test_classes_equal_all_pairs(spark):
    """Crowded and rare descriptors, shifted copies of parts, noise in the descriptors."""
    rng = np.random.default_rng(5)
    common = rng.integers(-(2**63), 2**63 - 1, (12, 2)).tolist()
    images = {}
    for i in range(70):
        n = int(rng.integers(4, 30))
        own = [[int(x), int(y), int(o), int(t), *map(int, rng.integers(-(2**63), 2**63 - 1, 2))] for x, y, o, t in rng.integers([0, 0, 0, 0], [900, 900, 2, 32], (n, 4))]
        for p in own[: n // 2]:
            p[4:] = common[int(rng.integers(0, 12))]
        if i % 3 == 2:
            source = images[i - 1 - i % 2]
            part = source[: max(1, int(len(source) * rng.uniform(0.1, 0.9)))]
            own = [[p[0] + 5, p[1] + 9, *p[2:4], p[4] ^ (1 << int(rng.integers(0, 62))), p[5]] for p in part] + own[: n // 2]
        images[i] = own
    rows = [(i, bytearray(b"%d" % i), [tuple(p) for p in points]) for i, points in images.items()]
    df = spark.createDataFrame(rows, f"id long, digest binary, points array<{media.POINT}>")
    want = brute(images)
    assert 5 < len(set(want.values())) < 65
    for block in (9, 1024):
        assert {r["id"]: r["class_id"] for r in media.copies(df, block).collect()} == want


def test_only_points_that_match_leave_an_entry(spark):
    """A key in common is not a match: of 40 images under one key only 3 and 7 have descriptors that are near enough."""
    rng = np.random.default_rng(8)
    bits = {i: rng.bytes(16) for i in range(40)}
    bits[7] = bytes([bits[3][0] ^ 0xFF, bits[3][1] ^ 0xFF, bits[3][2] ^ 0x0F, *bits[3][3:]])  # 20 bits
    bits[9] = bytes([bits[3][0] ^ 0xFF, bits[3][1] ^ 0xFF, bits[3][2] ^ 0x1F, *bits[3][3:]])  # 21 bits
    rows = [(5, i, 2, 40, i, 16, 9, bytearray(b)) for i, b in bits.items()] + [(6, i, 2, 2, 0, 16, 9, bytearray(bits[3])) for i in (3, 4)]
    opened = spark.createDataFrame(rows, "entry long, node long, i int, m long, class long, n int, r int, bits binary")
    for block in (7, 1024):
        got = [(r["a"], r["b"], r["i"]) for r in media._across(opened, block).collect()]
        assert [x for x in got if 9 not in x[:2]] == [(3, 7, 2)]
        assert (3, 9, 2) not in got


def test_images_in_stacks_have_the_points_that_each_has():
    images = [scene(i, 40 + 4 * (i % 3), 48) for i in range(30)] + [None, np.zeros((0, 5), np.uint8), np.zeros((30, 30), np.uint8), scene(99, 200, 180)]
    for image, found in zip(images, media.all_keypoints(images), strict=True):
        alone = media.keypoints(image)
        assert found.shape == alone.shape and (found == alone).all()
    assert sum(map(len, media.all_keypoints(images))) > 500 and media.all_keypoints([]) == []


def test_rows_of_entries_of_one_class_go_before_images_are_asked_for_their_points(spark):
    """Entries of one class, short ones too, give no row; of an entry longer than a task holds every row may pass."""
    rows = [(e, 10 * e + j, 0, 3, 7 if e % 2 else j // 2, 16) for e in range(40) for j in range(3)]
    rows += [(99, j, 0, 500, 5, 16) for j in range(250)] + [(99, j, 0, 500, 6 if j == 499 else 5, 16) for j in range(250, 500)]
    df = spark.createDataFrame(rows, "entry long, node long, i int, m long, class long, n int")
    want = sorted(r[:3] for r in rows if r[0] % 2 == 0 or r[0] == 99)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert sorted((r["entry"], r["node"], r["i"]) for r in media._open(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_matches_of_many_pairs_at_once(monkeypatch):
    monkeypatch.setattr(media, "PAIRS_AT_ONCE", 500)
    rng = np.random.default_rng(4)
    bits = lambda v: bin(int(v) & (2**64 - 1)).count("1")
    pool = rng.integers(-(2**63), 2**63 - 1, (9, 2))
    images = []
    for n in (0, 1, 7, 20, 40, 13):
        points = rng.integers(0, 30, (n, 6))
        points[:, 4:] = pool[rng.integers(0, 9, n)] ^ (1 << rng.integers(0, 60, (n, 2)))
        images.append(points)
    pack = lambda p: media.pack_points(dict(zip(media.NAMES, p.T)))
    pairs = [(p, q) for p in images for q in images]
    got = media._matches([pack(p) for p, _ in pairs], [pack(q) for _, q in pairs])
    some = 0
    for (p, q), (x, y) in zip(pairs, got, strict=True):
        words = lambda r: np.ascontiguousarray(r[4:]).view("<u4")
        want = [
            (i, j) for i in range(len(p)) for j in range(len(q))
            if bits(p[i, 4] ^ q[j, 4]) + bits(p[i, 5] ^ q[j, 5]) <= media.MAX_DISTANCE and (words(p[i]) == words(q[j])).any()
        ]
        if len({i for i, _ in want}) < max(media.LEAST_INLIERS, media.LEAST_SHARE * min(len(p), len(q))):
            want = []
        assert list(zip(x.tolist(), y.tolist())) == want
        some += bool(want)
    assert some > 9 and media._matches([], []) == []


def test_matches_of_few_pairs_are_held_together(monkeypatch):
    """Pairs of images meet in groups bounded by the points that could match, a pair beyond the bound alone."""
    monkeypatch.setattr(media, "MATCHES_AT_ONCE", 100)
    image = lambda n: bytes(n * media.POINT_BYTES)
    sizes = [(3, 3), (9, 9), (2, 5), (1, 1), (30, 30), (0, 4), (5, 5)]
    assert list(media._groups_of_pairs(*([image(n) for n in side] for side in zip(*sizes)))) == [(0, 3), (3, 4), (4, 5), (5, 7)]
    assert list(media._groups_of_pairs([], [])) == []
