"""Tables of bins around a circle, against plain loops."""

import random

import pytest

from spanloom.operators import rings


def around(a, b, n):
    return min((a - b) % n, (b - a) % n)


def plain_filled(bins, extent, n):
    out = {}
    for i in range(*extent):
        for j in range(n):
            if bins:
                d, fi, fj = min(((i - a) ** 2 + around(j, b, n) ** 2, a, b) for a, b in bins)
                out[i, j] = (fi, fj, bins[fi, fj])
    return out


def plain_smoothed(table, extent, n, si, sj):
    for sigma, axis in ((si, 0), (sj, 1)):
        w = rings.gaussian(sigma)
        r = len(w) // 2
        at = lambda i, j, k: (max(extent[0], min(extent[1] - 1, i + k)), j) if axis == 0 else (i, (j + k) % n)  # noqa: B023, E731
        table = {(i, j): sum(w[k + r] * table[at(i, j, k)] for k in range(-r, r + 1)) for i, j in table}
    return table


@pytest.mark.parametrize(("seed", "n", "count"), [(1, 12, 9), (2, 130, 25), (3, 7, 1)])
def test_bins_are_filled_from_the_nearest(spark, seed, n, count):
    rng, extent = random.Random(seed), (-3, 15)
    bins = {(rng.randrange(*extent), rng.randrange(n)): rng.random() for _ in range(count)}
    rows = [(i, j, v) for (i, j), v in bins.items()] + [(99, 0, 1.0), (0, n, 1.0), (0, 0, None)]
    df = spark.createDataFrame(rows, "i bigint, j bigint, value double").repartition(3)
    have = {(r.i, r.j): (r.from_i, r.from_j, r.value) for r in rings.filled(df, extent, n).collect()}
    assert have == plain_filled(bins, extent, n)


@pytest.mark.parametrize(("si", "sj"), [(1.0, 2.0), (0.0, 1.5), (3.0, 0.0)])
def test_means_filled_smoothed_and_their_confidence(spark, si, sj):
    rng, extent, n = random.Random(4), (0, 9), 16
    points = [(rng.randrange(9), rng.choice((0, 1, 14, 15, 7)), rng.random()) for _ in range(40)]
    df = spark.createDataFrame([*points, (3, 3, None), (-1, 3, 1.0)], "i bigint, j bigint, value double")
    have = {(r.i, r.j): r for r in rings.ring_table(df, extent, n, si, sj).collect()}
    seen = {}
    for i, j, v in points:
        seen.setdefault((i, j), []).append(v)
    means = {k: sum(v) / len(v) for k, v in seen.items()}
    table = {k: v[2] for k, v in plain_filled(means, extent, n).items()}
    value = plain_smoothed(table, extent, n, si, sj)
    share = plain_smoothed({k: float(k in seen) for k in table}, extent, n, si, sj)
    top = max(share.values())
    assert have.keys() == value.keys()
    for k, r in have.items():
        assert r.n == len(seen.get(k, ())) and r.value == pytest.approx(value[k]) and r.confidence == pytest.approx(share[k] / top)


def test_no_points(spark):
    df = spark.createDataFrame([], "i bigint, j bigint, value double")
    assert rings.ring_table(df, (0, 4), 8, 1.0, 1.0).count() == 0


def test_windows_add_up_to_one():
    for s in (0, 0.4, 1, 2.7):
        assert sum(rings.gaussian(s)) == pytest.approx(1) and len(rings.gaussian(s)) == 2 * int(4 * s + 0.5) + 1
