"""Grid growth against a sequential form: one grid after the other, one candidate after the other, plain lists."""

import math
import random

import pytest

from spanloom.operators import growth

EDGES = "a bigint, b bigint, pos_a double, pos_b double, z double, y double, x double"
TRACKS = "track bigint, family string, length double"
LEAST, MOST, TORTUOSITY, DOT = 1.0, 4.0, 1.35, 0.0


def chord(p, q):
    return math.dist(p[2:], q[2:])


def normals(lower, upper):
    out = []
    for j in range(len(lower) - 1):
        p = [upper[j + 1][c] - lower[j][c] for c in (2, 3, 4)]
        q = [upper[j][c] - lower[j + 1][c] for c in (2, 3, 4)]
        n = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
        size = math.hypot(*n)
        out.append(tuple(c / size for c in n) if size > 1e-6 else None)
    return out


def fits(m, hits):
    """(widest, total, slot) of a candidate beside the lines of m, or None. A node is (own, on, z, y, x)."""
    n = len(m)
    up = [m[-1][j][1] > m[0][j][1] for j in range(len(hits))] if n > 1 else None
    if n == 1:
        # One line: the first crossing track says on which side the candidate lies.
        after = hits[0][1] > m[0][0][1]
        up = [True] + [(h[1] > m[0][j + 1][1]) == after for j, h in enumerate(hits[1:])]
    slots = {sum(line[j][1] < h[1] if up[j] else line[j][1] > h[1] for line in m) for j, h in enumerate(hits)}
    if len(slots) != 1:
        return None
    slot = slots.pop()
    legs = [(abs(a[0] - b[0]), chord(a, b)) for a, b in zip(hits, hits[1:])]
    if any(arc > MOST for arc, _ in legs):
        return None
    down = [(abs(h[1] - o[1]), chord(h, o)) for k in (slot - 1, slot) if 0 <= k < n for h, o in zip(hits, m[k])]
    if slot in (0, n) and any(arc > MOST for arc, _ in down):
        return None
    legs += down
    if any(arc < LEAST or arc > TORTUOSITY * c for arc, c in legs):
        return None
    own = [h[0] for h in hits]
    if own != sorted(own) and own != sorted(own, reverse=True) or len(set(own)) < len(own):
        return None
    rows = m[:slot] + [hits] + m[slot:]
    strips = [normals(a, b) for a, b in zip(rows, rows[1:])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if a and b else -2
    for k in (slot - 1, slot):
        if 0 <= k < len(strips):
            s = strips[k]
            if None in s or any(dot(a, b) < DOT for a, b in zip(s, s[1:])):
                return None
    for k in (slot - 2, slot - 1, slot):
        if 0 <= k and k + 1 < len(strips) and any(dot(a, b) < DOT for a, b in zip(strips[k], strips[k + 1])):
            return None
    arcs = [arc for arc, _ in legs]
    return max(arcs), sum(arcs), slot


def best_of(edges, tracks):
    family, length = {t: f for t, f, _ in tracks}, {t: n for t, _, n in tracks}
    best = {}
    for a, b, pa, pb, *p in edges:
        if a == b or a not in family or b not in family or family[a] == family[b]:
            continue
        if a > b:
            a, b, pa, pb = b, a, pb, pa
        clearance = min(pa, length[a] - pa, pb, length[b] - pb)
        best.setdefault((a, b), []).append((-clearance, pa, pb, *p))
    out = {}
    for (a, b), found in best.items():
        c, pa, pb, *p = min(found)
        out.setdefault(a, {})[b] = (pb, pa, *p), -c
        out.setdefault(b, {})[a] = (pa, pb, *p), -c
    return out, length


class Grid:
    def __init__(self, row, col, node):
        self.rows, self.cols, self.by_row = [row], [col], [[node]]

    def lines(self, kind):
        flip = lambda n: (n[1], n[0], *n[2:])
        return self.by_row if kind == 0 else [[flip(r[j]) for r in self.by_row] for j in range(len(self.cols))]

    def candidate(self, both, barred):
        found = []
        for kind, (own, others) in enumerate(((self.rows, self.cols), (self.cols, self.rows))):
            for t in set(both[others[0]]) - set(own):
                if all(t in both[o] for o in others) and not any(barred(t, o) for o in others):
                    hits = [both[o][t][0] for o in others]
                    fit = fits(self.lines(kind), hits)
                    if fit:
                        found.append((fit[0], fit[1], kind, t, fit[2], hits))
        return min(found, key=lambda f: f[:4]) if found else None

    def take(self, kind, t, slot, hits):
        if kind == 0:
            self.rows.insert(slot, t)
            self.by_row.insert(slot, hits)
        else:
            self.cols.insert(slot, t)
            for line, h in zip(self.by_row, hits):
                line.insert(slot, (h[1], h[0], *h[2:]))

    def pairs(self):
        return {(min(r, c), max(r, c)) for r in self.rows for c in self.cols}


def sequential(edges, tracks, seeds, exclusive=False):
    both, length = best_of(edges, tracks)
    grids, firsts = {}, set()
    for g, anchor in sorted(seeds):
        choices = [(-length[p], -c, p, node) for p, (node, c) in both.get(anchor, {}).items() if c >= LEAST]
        if choices:
            *_, p, node = min(choices, key=lambda c: c[:3])
            pair = (min(p, anchor), max(p, anchor))
            if not (exclusive and pair in firsts):
                firsts.add(pair)
                grids[g] = Grid(p, anchor, node)
    if not exclusive:
        for grid in grids.values():
            while c := grid.candidate(both, lambda t, o: False):
                grid.take(*c[2:])
        return grids
    owner = {p: g for g, grid in grids.items() for p in grid.pairs()}
    live = set(grids)
    while live:
        wants = {g: c for g in live if (c := grids[g].candidate(both, lambda t, o: owner.get((min(t, o), max(t, o)), g) != g))}
        claims = {}
        for g, c in wants.items():
            for o in grids[g].cols if c[2] == 0 else grids[g].rows:
                claims.setdefault((min(c[3], o), max(c[3], o)), []).append((c[0], c[1], g))
        lost = {x[2] for found in claims.values() for x in found if x != min(found)}
        for g, c in wants.items():
            if g not in lost:
                grids[g].take(*c[2:])
                owner.update(dict.fromkeys(grids[g].pairs(), g))
        live = set(wants)
    return grids


def sheet(seed, n=9, m=9, drop=0.12, noise=0.25):
    """Rows 1.. and columns 101.. over a wavy sheet, with crossings that are missing, moved, folded over or double."""
    rng = random.Random(seed)
    edges = []
    turn = {t: rng.random() < 0.3 for t in [*range(1, n + 1), *range(101, 101 + m)]}
    for i in range(n):
        for j in range(m):
            if rng.random() < drop:
                continue
            for _ in range(2 if rng.random() < 0.1 else 1):
                y, x = 2.0 * i + rng.uniform(-noise, noise), 2.0 * j + rng.uniform(-noise, noise)
                z = math.sin(y / 5) + (4.0 if rng.random() < 0.03 else 0)
                r, c = x + 1, y + 1
                if rng.random() < 0.05:
                    r += rng.choice((-3, 3, 0.9))
                edges.append((i + 1, 101 + j, (2 * m - r) if turn[i + 1] else r, (2 * n - c) if turn[101 + j] else c, z, y, x))
    tracks = [(t, "h" if t < 100 else "v", float(2 * m if t < 100 else 2 * n) + rng.random()) for t in turn]
    return [(e[0], e[1], *map(float, e[2:])) for e in edges], tracks


def grown(spark, edges, tracks, seeds, parts, **options):
    e, t = spark.createDataFrame(edges, EDGES).repartition(parts), spark.createDataFrame(tracks, TRACKS).repartition(parts)
    s = spark.createDataFrame(seeds, "grid bigint, anchor bigint").repartition(parts)
    return {r.grid: r for r in growth.grown_grids(e, t, s, LEAST, MOST, TORTUOSITY, DOT, **options).collect()}


def same(have, want):
    assert set(have) == set(want)
    for g, grid in want.items():
        r = have[g]
        assert (list(r.rows), list(r.cols)) == (grid.rows, grid.cols)
        assert [[tuple(n) for n in line] for line in r.nodes] == grid.by_row


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7)])
def test_grids_grow_as_one_after_the_other_would(spark, seed, parts):
    edges, tracks = sheet(seed)
    seeds = [(k, t) for k, t in enumerate((101, 104, 109, 3, 8, 999))]
    want = sequential(edges, tracks, seeds)
    assert max(len(g.rows) * len(g.cols) for g in want.values()) >= 6
    same(grown(spark, edges, tracks, seeds, parts), want)


@pytest.mark.parametrize("parts", [1, 5])
def test_crossings_of_one_grid_only(spark, parts):
    edges, tracks = sheet(3, drop=0.05)
    seeds = [(k, 101 + k) for k in range(6)] + [(9, 102)]
    want = sequential(edges, tracks, seeds, exclusive=True)
    have = grown(spark, edges, tracks, seeds, parts, exclusive=True)
    same(have, want)
    pairs = [p for g in want.values() for p in g.pairs()]
    assert len(pairs) == len(set(pairs)) > 12


def test_a_whole_sheet_is_found_from_each_seed(spark):
    edges, tracks = sheet(4, 5, 5, drop=0, noise=0)
    edges = [(i + 1, 101 + j, 2.0 * j + 1, 2.0 * i + 1, 0.0, 2.0 * i, 2.0 * j) for i in range(5) for j in range(5)]
    have = grown(spark, edges, tracks, [(1, 103), (2, 1)], 3)
    assert sorted(have[1].rows) == [1, 2, 3, 4, 5] and sorted(have[1].cols) == [101, 102, 103, 104, 105]
    assert len(have[2].rows) == len(have[2].cols) == 5


def test_rounds_nulls_and_nothing_to_grow_from(spark):
    edges, tracks = sheet(1)
    have = grown(spark, edges, tracks, [(0, 101)], 2, rounds=2)
    assert len(have[0].rows) + len(have[0].cols) <= 4
    assert grown(spark, [], tracks, [(0, 101)], 2) == {} and grown(spark, edges, tracks, [], 2) == {}
    lone = [(1, 101, 0.5, 0.5, 0.0, 0.0, 0.0)]
    assert grown(spark, lone, [(1, "h", 9.0), (101, "v", 9.0)], [(0, 101)], 1) == {}
