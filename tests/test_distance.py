"""Distance transforms against all pairs of cells and features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import distance

ZYX = ["z", "y", "x"]


def plain(features, extent, spacing=(1, 1, 1)):
    cells = itertools.product(*(range(*e) for e in extent))
    return {c: min(math.sqrt(sum((s * (a - b)) ** 2 for s, a, b in zip(spacing, c, f))) for f in features) if features else None for c in cells}


def test_envelopes_equal_all_offers():
    rng = np.random.default_rng(1)
    for n, m, columns in ((1, 1, 1), (1, 9, 3), (7, 1, 2), (40, 65, 5), (13, 64, 4), (64, 63, 1)):
        p, q = np.sort(rng.choice(200, n, replace=False)).astype(float), np.sort(rng.choice(200, m, replace=False)).astype(float)
        g = rng.integers(0, 900, (n, columns)).astype(float)
        want = (g[None] + 2.25 * (q[:, None, None] - p[None, :, None]) ** 2).min(axis=1)
        assert (distance.envelope(p, g, q, 2.25) == want).all()


@pytest.mark.parametrize(("seed", "spacing"), [(1, (1, 1, 1)), (2, (4.0, 1.0, 0.5))])
def test_volumes_with_empty_slabs(spark, seed, spacing):
    """Features in two corners only: most lines and slabs have none; the last axis spans three blocks."""
    rng, extent = random.Random(seed), ((-2, 7), (3, 14), (-5, 130))
    features = {(rng.choice((-2, 5, 6)), rng.choice((3, 12)), rng.randrange(-5, 130)) for _ in range(14)}
    rows = [*features, *list(features)[:3], (99, 3, 0), (0, 3, 130), (None, 3, 0)]
    df = spark.createDataFrame(rows, "z bigint, y bigint, x bigint").repartition(3)
    out = distance.distances(df, ZYX, dict(zip(ZYX, extent)), spacing=dict(zip(ZYX, spacing)))
    have = {(r.z, r.y, r.x): r.distance for r in out.collect()}
    want = plain(features, extent, spacing)
    assert have.keys() == want.keys() and all(abs(have[c] - want[c]) < 1e-9 for c in want)


def test_planes_by_key(spark):
    rng, extent = random.Random(3), ((0, 12), (0, 70))
    cells = {(k, rng.randrange(12), rng.randrange(70)) for k in ("a", "b", None) for _ in range(5)}
    df = spark.createDataFrame(list(cells), "k string, y int, x int")
    out = distance.distances(df, ["y", "x"], {"y": (0, 12), "x": (0, 70)}, keys=["k"]).collect()
    for k in ("a", "b", None):
        want = plain([c[1:] for c in cells if c[0] == k], extent)
        assert {(r.y, r.x): round(r.distance, 9) for r in out if r.k == k} == {c: round(d, 9) for c, d in want.items()}


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
def test_signed_distances(spark, density):
    rng, extent = random.Random(4), ((0, 5), (0, 6), (0, 70))
    every = list(itertools.product(*(range(*e) for e in extent)))
    mask = [c for c in every if rng.random() < density]
    df = spark.createDataFrame(mask, "z bigint, y bigint, x bigint")
    out = distance.signed_distances(df, ZYX, dict(zip(ZYX, extent))).withColumn("byte", distance.encoded(F.col("distance"), 0.5, 100)).collect()
    have = {(r.z, r.y, r.x): (r.distance, r.byte) for r in out}
    to, fro = plain(mask, extent), plain([c for c in every if c not in set(mask)], extent)
    inf = math.inf
    for c in every:
        want = (inf if to[c] is None else to[c]) - (inf if fro[c] is None else fro[c])
        assert have[c][0] == pytest.approx(want)
        assert have[c][1] == 128 + max(-100, min(100, round(want / 0.5) if abs(want) < inf else int(math.copysign(100, want))))
    assert len(have) == len(every)


def test_no_features(spark):
    df = spark.createDataFrame([], "z bigint, y bigint, x bigint")
    assert distance.distances(df, ZYX, {c: (0, 3) for c in ZYX}).count() == 0
