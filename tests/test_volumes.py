"""Skeletons of volumes: what must stay as it was, and the same result whatever the blocks."""

import itertools
import random

import numpy as np
import pytest

from spanloom.operators import volumes

STEPS = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
FACES = [o for o in STEPS if sum(map(abs, o)) == 1]


def parts(cells, steps):
    left, n = set(cells), 0
    while left:
        n, stack = n + 1, [left.pop()]
        while stack:
            c = stack.pop()
            for o in steps:
                d = (c[0] + o[0], c[1] + o[1], c[2] + o[2])
                if d in left:
                    left.remove(d)
                    stack.append(d)
    return n


def numbers(cells):
    """(parts of cells, parts of the space between, Euler number) of a set of cells as closed cubes."""
    lo, hi = (np.array([f(c[i] for c in cells) for i in range(3)]) for f in (min, max))
    space = set(itertools.product(*(range(a - 1, b + 2) for a, b in zip(lo, hi)))) - set(cells)
    pieces = set()
    for c in cells:
        pieces |= {tuple(2 * x + d for x, d in zip(c, o)) for o in itertools.product((-1, 0, 1), repeat=3)}
    euler = sum((-1) ** sum(x % 2 == 0 for x in p) for p in pieces)
    return parts(cells, STEPS), parts(space, FACES), euler


def is_simple(cells, c):
    """By definition: one part of cells around it, and one part of space among the 18 that touches it by a face."""
    near = [tuple(a + b for a, b in zip(c, o)) for o in STEPS]
    on = [n for n in near if n in cells]
    off = {n for n, o in zip(near, STEPS) if n not in cells and sum(map(abs, o)) <= 2}
    faces = [tuple(a + b for a, b in zip(c, o)) for o in FACES]
    own = 0
    left = set(off)
    while left:
        stack = [left.pop()]
        part = set(stack)
        while stack:
            p = stack.pop()
            for o in FACES:
                d = tuple(a + b for a, b in zip(p, o))
                if d in left:
                    left.remove(d)
                    stack.append(d)
                    part.add(d)
        own += any(f in part for f in faces)
    return parts(on, STEPS) == 1 and own == 1


def shape(name):
    rng = random.Random(5)
    box = lambda z, y, x: set(itertools.product(range(*z), range(*y), range(*x)))
    if name == "bar":
        return box((0, 5), (0, 6), (-20, 25))
    if name == "ring":
        return box((0, 4), (0, 20), (0, 20)) - box((0, 4), (6, 14), (6, 14))
    if name == "hollow":
        return box((0, 9), (0, 9), (0, 9)) - box((3, 6), (3, 6), (3, 6))
    if name == "plus":
        return box((0, 5), (10, 15), (0, 40)) | box((0, 5), (0, 40), (10, 15)) | box((-15, 20), (11, 14), (11, 14))
    if name == "lines":
        return {(0, 0, x) for x in range(9)} | {(5, y, y) for y in range(9)} | {(50, 50, 50)}
    return {c for c in box((-3, 9), (0, 12), (0, 12)) if rng.random() < 0.55}


@pytest.mark.parametrize("name", ["bar", "ring", "hollow", "plus", "lines", "noise"])
def test_a_skeleton_hangs_together_as_the_cells_do(spark, name):
    cells = shape(name)
    rows = [*cells, *list(cells)[:2], (None, 1, 1)]
    df = spark.createDataFrame(rows, "z bigint, y bigint, x bigint")
    have = {tuple(r) for r in volumes.skeleton(df).collect()}
    assert have <= cells and numbers(have) == numbers(cells)
    # One cell wide: no cell could go but the ends of lines.
    for c in have:
        around = sum(tuple(a + b for a, b in zip(c, o)) in have for o in STEPS)
        assert around == 1 or not is_simple(have, c)
    assert name == "lines" and have == cells or name in ("noise", "lines") or len(have) < len(cells) / 3
    small = {tuple(r) for r in volumes.skeleton(df.repartition(5), block=6).collect()}
    assert small == have


def test_cells_of_keys_do_not_meet(spark):
    cells, none = shape("bar"), shape("lines")
    df = spark.createDataFrame([("a", *c) for c in cells] + [(None, *c) for c in none], "k string, z bigint, y bigint, x bigint")
    out = volumes.skeleton(df, ["k"], block=10).collect()
    alone = {tuple(r) for r in volumes.skeleton(spark.createDataFrame(list(cells), "z bigint, y bigint, x bigint")).collect()}
    assert {tuple(r)[1:] for r in out if r.k == "a"} == alone and {tuple(r)[1:] for r in out if r.k is None} == none


def test_simple_cells_by_definition():
    rng = np.random.default_rng(3)
    around = rng.random((600, 26)) < rng.choice([0.2, 0.5, 0.8], 600)[:, None]
    got = volumes.simple(around)
    for row, ok in zip(around, got):
        assert ok == is_simple({o for o, on in zip(STEPS, row) if on} | {(0, 0, 0)}, (0, 0, 0))


def test_no_cells(spark):
    assert volumes.skeleton(spark.createDataFrame([], "z bigint, y bigint, x bigint")).count() == 0
