"""Prompt suites against numpy's generator, drawn one sample after the other."""

import hashlib

import numpy as np
import pytest

from gristmill.operators import suite as S


def plain(n, seed):
    """Tags and prompts in order, without repeats."""
    rng, out = np.random.default_rng(seed), []
    a = lambda x: ("an " if x[0] in "aeiou" else "a ") + x
    out += [("single_object", a(S.OBJECTS[i])) for i in rng.choice(S.N, size=S.N, replace=False)]
    two = lambda k: rng.choice(k, size=2, replace=False)
    for _ in range(n):
        i, j = two(S.N)
        out.append(("two_object", f"{a(S.OBJECTS[i])} and {a(S.OBJECTS[j])}"))
    for _ in range(n):
        name, k = S.OBJECTS[rng.choice(S.N)], int(rng.integers(2, 4, endpoint=True))
        out.append(("counting", f"{S.NUMBERS[k]} {name}{'es' if name.endswith('s') else 's'}"))
    for _ in range(n):
        name = S.OBJECTS[rng.choice(S.N - 1) + 1]
        out.append(("colors", f"{a(S.COLOURS[rng.choice(10)])} {name}"))
    for _ in range(n):
        i, j = two(S.N)
        out.append(("position", f"{a(S.OBJECTS[i])} {S.SIDES[rng.choice(4)]} {a(S.OBJECTS[j])}"))
    for _ in range(n):
        (i, j), (c, d) = two(S.N - 1) + 1, two(10)
        out.append(("color_attr", f"{a(S.COLOURS[c])} {S.OBJECTS[i]} and {a(S.COLOURS[d])} {S.OBJECTS[j]}"))
    return list(dict.fromkeys((t, f"a photo of {p}") for t, p in out))


def test_the_published_suite(spark):
    rows = S.prompt_suite(spark).orderBy("place").collect()
    text = "".join(f"{r.prompt}\n" for r in rows)
    # Fixed value: the digest of the published prompts, one a line.
    assert len(rows) == 553 and hashlib.sha256(text.encode()).hexdigest() == "55b6e3650e980c13daf30569eb666e000faf19bfc2b7b4cbe999fcdb7aa9d680"
    count = next(r for r in rows if r.tag == "counting")
    assert count.exclude[0]["count"] == count.include[0]["count"] + 1 and next(r for r in rows if r.tag == "position").include[1]["of"] == 0


def test_many_tasks_draw_one_stream(spark):
    got = [(r.tag, r.prompt) for r in S.prompt_suite(spark, 700, 5, 64).orderBy("place").collect()]
    assert got == plain(700, 5)


@pytest.mark.parametrize("bounds", [(3_000_000_000,), (2_500_000_000, 7, 3_999_999_999), (80, 79)])
def test_rejections_as_numpy_rejects(bounds):
    rng = np.random.default_rng(9)
    skipped = [int(rng.integers(0, 10)) for _ in range(3)]
    want = [[int(rng.integers(0, b)) for b in bounds] for _ in range(500)]
    got, extra = S.drawn(S.Words(9), 3, bounds, 500)
    assert got.tolist() == want and (extra > 50) == (max(bounds) > 1000) and len(skipped) == 3


def test_shifts_of_rejecting_tasks(spark, monkeypatch):
    wide = {"two_object": (2_900_000_000, 80, 2), "counting": (80, 3)}
    monkeypatch.setattr(S, "BOUNDS", wide)
    monkeypatch.setattr(S, "_samples", lambda tag, numbers: ((str(r), [], []) for r in numbers.tolist()))
    rng = np.random.default_rng(2)
    rng.choice(S.N, size=S.N, replace=False)
    want = [(t, S.PHOTO + str([int(rng.integers(0, x)) for x in b])) for t, b in wide.items() for _ in range(40)]
    rows = S.prompt_suite(spark, 40, 2, 9).filter("tag <> 'single_object'").orderBy("place").collect()
    assert [(r.tag, r.prompt) for r in rows] == list(dict.fromkeys(want))
