"""Walks along sheets against one walker at a time, with plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from spanloom.operators import walking

SHAPE = (34, 56, 56)
RULES = walking.Rules(substep=3.0, band_search=6.0, edge_search=2.0)


def field(z, y, x):
    """Cones around an axis: sheets 9 apart and 3.4 thick, whose radius grows with z; a gap is cut into one side."""
    r = math.hypot(y - 28, x - 28)
    s = (r - 0.25 * z) / 9
    d = abs(s - round(s)) * 9 - 1.7
    n = np.array([-0.25, (y - 28) / max(r, 1e-9), (x - 28) / max(r, 1e-9)])
    return (d, *(n / np.linalg.norm(n)))


def volume(holes=True):
    rows = []
    for z, y, x in np.ndindex(*SHAPE):
        if holes and (y - 28 > 12 and abs(x - 28) < 5 and z > 17):
            continue
        rows.append((z, y, x, *field(z, y, x)))
    return rows


class Plain:
    def __init__(self, rows):
        self.v = {r[:3]: r[3:] for r in rows}

    def at(self, p):
        base, out = [math.floor(c) for c in p], np.zeros(4)
        for corner in np.ndindex(2, 2, 2):
            w = math.prod((c - b) if k else 1 - (c - b) for c, b, k in zip(p, base, corner))
            voxel = self.v.get(tuple(b + k for b, k in zip(base, corner)))
            out += w * (np.array(voxel) if voxel else np.nan)
        return out

    def axis(self, p):
        _, _, ny, nx = self.at(p)
        size = math.hypot(ny, nx)
        return np.array([0, ny, nx]) / size if size > 1e-6 else None

    def line(self, p, a, reach):
        n = math.ceil(reach / RULES.sample)
        s = [k * RULES.sample for k in range(-n, n + 1)]
        return s, [self.at(p + t * a)[0] for t in s]

    def crossings(self, s, f, entry):
        for k in range(len(s) - 1):
            a, b = f[k], f[k + 1]
            if (a >= 0 and b < 0) if entry else (a < 0 and b >= 0):
                yield k, s[k] + (s[k + 1] - s[k]) * a / (a - b)

    def band(self, p):
        a = self.axis(p)
        if a is None or np.isnan(a).any():
            return None
        s, f = self.line(p, a, RULES.band_search)
        best = None
        for k, begin in self.crossings(s, f, True):
            after = [(j, e) for j, e in self.crossings(s, f, False) if j > k]
            if after and not np.isnan(f[k : after[0][0] + 2]).any():
                middle = (begin + after[0][1]) / 2
                if best is None or abs(middle) < abs(best[0]):
                    best = middle, begin, after[0][1]
        return best and (p + best[1] * a, p + best[2] * a, a)

    def slid(self, p, dz):
        _, nz, ny, nx = self.at(p)
        k = -dz * nz / (ny * ny + nx * nx)
        return p + np.array([dz, k * ny, k * nx])

    def edge(self, p, a, entry):
        found = [t for _, t in self.crossings(*self.line(p, a, RULES.edge_search), entry) if abs(t) <= RULES.edge_search]
        return p + found[0] * a if len(found) == 1 else None

    def step(self, state, dz):
        low, high, a = state
        width = np.linalg.norm(high - low)
        low, high = self.slid(low, dz), self.slid(high, dz)
        turned = None if np.isnan(low + high).any() else self.axis((low + high) / 2)
        if turned is None or np.isnan(turned).any():
            return None
        low, high = self.edge(low, turned, True), self.edge(high, turned, False)
        if low is None or high is None:
            return None
        after = (high - low) @ turned
        ok = after > RULES.least_width and abs(after - width) <= RULES.width_change and turned @ a > RULES.alignment
        return (low, high, turned) if ok else None

    def walk(self, p, dz):
        """(end or None, holds)."""
        state = self.band(np.array(p, float))
        if state is None:
            return None, False
        n = math.ceil(abs(dz) / RULES.substep)
        begin, end = (state[0] + state[1]) / 2, None
        for way in (1, -1):
            for _ in range(n):
                state = self.step(state, way * dz / n)
                if state is None:
                    return end, False
            if way == 1:
                end = (state[0] + state[1]) / 2
        return end, bool(np.linalg.norm((state[0] + state[1]) / 2 - begin) <= RULES.tolerance)


@pytest.fixture(scope="module")
def rows():
    return volume()


def seeds():
    rng = np.random.default_rng(2)
    inside = [(k, *p) for k, p in enumerate(rng.uniform((4, 8, 8), (16, 48, 48), (60, 3)).tolist())]
    return [*inside, (60, 28.0, 28.0, 10.0), (61, 5.0, 28.0, 28.0), (62, 200.0, 3.0, 3.0), (63, None, 1.0, 1.0), (1, *inside[1][1:]), (64, 10.0, 44.0, 28.0)]


@pytest.mark.parametrize(("dz", "block", "halo"), [(9.0, 16, 16), (-3.0, 40, 16), (14.0, 8, 14)])
def test_walkers_go_as_one_alone_would(spark, rows, dz, block, halo):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["z", "y", "x", "d", "nz", "ny", "nx"])).repartition(3)
    starts = spark.createDataFrame(seeds(), "id bigint, z double, y double, x double").repartition(4)
    have = {(r.id, r.alive, None if r.z is None else tuple(round(c, 6) for c in (r.z, r.y, r.x))) for r in walking.sheet_walks(df, starts, dz, RULES, block, halo).collect()}
    alone, want = Plain(rows), set()
    for i, *p in seeds():
        end, holds = alone.walk(p, dz) if None not in p else (None, False)
        want.add((i, holds, None if end is None else tuple(round(float(c), 6) for c in end)))
    assert have == want
    alive = [w for w in want if w[1]]
    assert len(alive) >= 8 and len(alive) < len(want)
    for _, _, (z, y, x) in alive:
        s = (math.hypot(y - 28, x - 28) - 0.25 * z) / 9
        assert abs(s - round(s)) * 9 < 0.2


def test_walks_of_no_length_and_no_seeds(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["z", "y", "x", "d", "nz", "ny", "nx"]))
    start = spark.createDataFrame([(1, 10.0, 28.0, 49.0)], "id bigint, z double, y double, x double")
    r = walking.sheet_walks(df, start, 0.0, RULES).first()
    assert r.alive and r.z == 10.0 and abs((r.x - 28 - 2.5) / 9 - 2) < 0.03
    assert walking.sheet_walks(df, start.limit(0), 5.0, RULES).count() == 0


def test_a_halo_that_holds_no_step_is_refused(spark):
    empty = spark.createDataFrame([], "z bigint, y bigint, x bigint, d double, nz double, ny double, nx double")
    with pytest.raises(ValueError, match="halo"):
        walking.sheet_walks(empty, spark.createDataFrame([], "id bigint, z double, y double, x double"), 5.0, RULES, halo=5)
