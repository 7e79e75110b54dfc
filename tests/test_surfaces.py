"""Surfaces, volumes and waves over grids against plain forms."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import blocks, graph, raster, sampling, surfaces


def closest(p, a, b, c):
    """Distance to a triangle by a fine search over its weights, then over its edges."""
    best = math.inf
    for u in range(0, 201):
        for v in range(0, 201 - u):
            q = a + (b - a) * (u / 200) + (c - a) * (v / 200)
            best = min(best, float(np.linalg.norm(p - q)))
    return best


def test_nearest_place_on_triangles(spark):
    rng = np.random.default_rng(1)
    grid = {(i, j): np.array([rng.uniform(0, 3), 4.0 * i, 4.0 * j]) for i in range(4) for j in range(4) if (i, j) != (3, 3)}
    v = spark.createDataFrame([("s", i, j, *map(float, x)) for (i, j), x in grid.items()], "s string, i int, j int, z double, y double, x double")
    points = rng.uniform(-2, 14, (25, 3)) * [0.4, 1, 1]
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "id int, z double, y double, x double")
    faces = surfaces.triangles(v, ["s"], "i", "j", list("zyx"))
    assert faces.count() == 16
    got = {r.id: r for r in surfaces.nearest_on_surfaces(p, ["id"], faces, 3.0, surface=["s"]).collect()}
    corners = [[np.array([r[f"{k}_{x}"] for x in "zyx"]) for k in "abc"] for r in faces.collect()]
    for k, x in enumerate(points):
        want = min(closest(x, *f) for f in corners)
        if abs(want - 3) > 0.05:
            assert (k in got) == (want < 3)
        if k in got:
            assert abs(got[k].distance - want) < 0.05
            # The place leads back to a point of the surface at that distance.
            i, j = int(min(got[k].at_i, 2.999)), int(min(got[k].at_j, 2.999))
            a, b = got[k].at_i - i, got[k].at_j - j
            c10, c01 = grid[i + 1, j], grid[i, j + 1]
            q = grid[i, j] * (1 - a - b) + c10 * a + c01 * b if a + b <= 1 else grid.get((i + 1, j + 1), c10) * (a + b - 1) + c10 * (1 - b) + c01 * (1 - a)
            assert abs(float(np.linalg.norm(q - x)) - got[k].distance) < 1e-5


def test_landings_of_parallel_sheets(spark):
    rows = [(s, i, j, z, 1.0 * i, 1.0 * j) for s, z, n in (("a", 0.0, 4), ("b", 0.5, 3)) for i in range(n) for j in range(n)]
    v = spark.createDataFrame(rows, "s string, i int, j int, z double, y double, x double")
    got = surfaces.landings(v, "s", "i", "j", list("zyx"), spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"), 0.6).collect()
    assert sorted((r.a, r.i, r.j, r.to_i, r.to_j) for r in got if r.a == "b") == [("b", i, j, i, j) for i in range(2) for j in range(2)]
    assert {(r.i, r.j) for r in got if r.a == "a"} == {(i, j) for i in range(2) for j in range(2)}


def test_trilinear_values(spark):
    v = spark.createDataFrame([(z, y, x, 1.0 + z + 2 * y + 4 * x) for z in (0, 1) for y in (0, 1) for x in (0, 1)], "z int, y int, x int, q double")
    p = spark.createDataFrame([(0, 0.25, 0.5, 0.75), (1, 1.0, 1.0, 1.0), (2, 1.25, 0.0, 0.0), (3, 1.75, 0.0, 0.0), (4, 9.0, 9.0, 9.0)], "id int, z double, y double, x double")
    got = {r.id: (r.q, r.valid) for r in surfaces.trilinear(p, v, "q").collect()}
    assert got == {0: (1 + 0.25 + 1 + 3, True), 1: (8.0, True), 2: (2.0, True), 3: (2.0, False), 4: (None, False)}


def flood_holes(cells):
    if not cells:
        return 0
    ys, xs = [c[0] for c in cells], [c[1] for c in cells]
    other = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)} - cells
    n = 0
    while other:
        n, stack = n + 1, [other.pop()]
        while stack:
            y, x = stack.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in other:
                    other.remove(q)
                    stack.append(q)
    return n - 1


def test_holes_match_flooding(spark):
    rng = random.Random(3)
    grids = {k: {(y, x) for y in range(9) for x in range(9) if rng.random() < p} for k, p in enumerate((0.2, 0.5, 0.7, 0.9))}
    df = spark.createDataFrame([(k, *c) for k, cells in grids.items() for c in cells], "k int, i int, j int")
    assert {r.k: r.holes for r in surfaces.holes(df, ["k"], "i", "j").collect()} == {k: flood_holes(c) for k, c in grids.items()}


def test_geodesics_cross_blocks(spark):
    rng = random.Random(5)
    cells = {(i, j) for i in range(20) for j in range(20) if rng.random() < 0.7} | {(0, 0)}
    df = spark.createDataFrame([(i, j, (i, j) == (0, 0)) for i, j in cells], "i int, j int, seed boolean")
    best, heap = {(0, 0): 0.0}, [(0.0, (0, 0))]
    while heap:
        c, (y, x) = heapq.heappop(heap)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                q, d = (y + dy, x + dx), c + math.hypot(dy, dx)
                if q in cells and d < best.get(q, math.inf) - 1e-12:
                    best[q] = d
                    heapq.heappush(heap, (d, q))
    got = {(r.i, r.j): r.cost for r in blocks.geodesics(df, "i", "j", "seed", block=6).collect()}
    assert got.keys() == best.keys() and all(abs(got[p] - best[p]) < 1e-9 for p in got)
    by_edges = graph.shortest_paths(graph.quad_edges(df.selectExpr("i * 100 + j as node", "i", "j"), "node", "i", "j"), spark.createDataFrame([(0,)], "node int"))
    assert {r.node: round(r.cost, 9) for r in by_edges.collect()} == {i * 100 + j: round(c, 9) for (i, j), c in best.items()}


def test_walks(spark):
    chain = [(0, 50, 1, 10), (1, 40, 2, 10), (2, 40, 3, 10), (3, 40, 4, 10)]
    rows = chain + [(d, q, s, p) for s, p, d, q in chain]
    r = spark.createDataFrame(rows, "src bigint, self_local int, dst bigint, partner_local int")
    seeds = spark.createDataFrame([(0,), (2,)], "node bigint")
    from pyspark.sql import functions as F

    got = {w.start: w.walk for w in graph.crossing_walks(r, seeds, 4, 20, 60, F.col("dst")).collect()}
    assert got == {0: [0, 1, 2, 3, 4]}
    assert graph.crossing_walks(r, seeds, 4, 40, 60, F.col("dst")).count() == 0
    # A square with one diagonal: from 0, track 1 is left for 2 only far enough along it.
    pos = {(0, 1): 0, (1, 0): 0, (1, 2): 30, (2, 1): 0, (2, 3): 30, (3, 2): 0, (3, 0): 30, (0, 3): 30, (0, 2): 50, (2, 0): 40}
    g = spark.createDataFrame([(a, b, p) for (a, b), p in pos.items()], "src bigint, dst bigint, position int")
    walks = {w.start: w.walk for w in graph.gated_walks(g, spark.createDataFrame([(0,)], "node bigint"), 2, 20.0, F.col("dst")).collect()}
    assert walks == {0: [0, 1, 2]}
    assert [w.walk for w in graph.gated_walks(g, spark.createDataFrame([(0,)], "node bigint"), 2, 45.0, F.col("dst")).collect()] == [[0]]


def test_walks_over_points_are_those_over_crossings(spark):
    from spanloom.operators import joins

    rng = random.Random(8)
    rows = [(t, rng.randrange(25), rng.randrange(12), f"f{t % 4}") for t in range(90) for _ in range(6)] + [(5, None, 1, "f1"), (200, 40, 1, "f0")]
    points = spark.createDataFrame(rows, "track bigint, cell bigint, idx int, fam string")
    e = joins.crossing_events(points, "track", "cell", "idx", "fam")
    r = e.selectExpr("a as src", "b as dst", "a_idx as self_local", "b_idx as partner_local").unionByName(e.selectExpr("b as src", "a as dst", "b_idx as self_local", "a_idx as partner_local"))
    seeds, order = points.selectExpr("track as node").distinct(), lambda src, dst: (src * 31 + dst * 17) % 101
    want = {(w.start, tuple(w.walk)) for w in graph.crossing_walks(r, seeds, 3, 1, 3, order(F.col("src"), F.col("dst"))).collect()}
    for chunk in (1024, 4):
        assert {(w.start, tuple(w.walk)) for w in graph.point_walks(points, "track", "cell", "idx", "fam", seeds, 3, 1, 3, order, chunk).collect()} == want
    assert len(want) > 60


def test_rounds_make_their_edges_once(spark):
    """Each row of edges is made once, however many rounds there are; and a loop's edges are not made again."""
    from spanloom.plans import graphs

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    e = spark.range(40).selectExpr("id as src", "id + 1 as dst", "1.0D as weight")
    got = graph.shortest_paths(e.mapInArrow(counted, e.schema), spark.createDataFrame([(0,)], "node bigint"), 6)
    assert sorted((r.node, r.cost) for r in got.collect()) == [(k, float(k)) for k in range(7)] and made.value == 40
    lines = [(o, n, (o * 7 + n * 3) % 20) for o in range(30) for n in range(1, 4)]
    read, made.value = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint"), 0
    graphs.cycle_holonomy(lambda name: read.mapInArrow(counted, read.schema)).collect()
    assert made.value == 2 * len(lines)


def test_pairs_are_dealt_to_tasks_by_their_number(spark):
    from spanloom.operators import joins

    rng = random.Random(2)
    held = {(o, c) for c in range(60) for o in rng.sample(range(200), 20)}
    one = spark.createDataFrame(sorted(held), "o bigint, c bigint")
    d = joins.dealt_pairs(one, "o", "c", "a", "b", each=500)
    assert d.rdd.getNumPartitions() == math.ceil(60 * 190 / 500)
    assert sorted((r.a, r.b) for r in d.collect()) == sorted((a, b) for a, c in held for b, e in held if c == e and a < b)
    # Counting them needs no other exchange: a task has its pairs only.
    assert "partial_count" not in d.groupBy("a", "b").count()._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM", 1)[1]
    assert joins.dealt_pairs(one.limit(0), "o", "c", "a", "b").count() == 0


def test_labels_go_around_and_avoid_neighbours(spark):
    far = spark.createDataFrame([(k, 20 * k // 4) for k in range(256)], "t bigint, z bigint")
    got = {r.t: (r.label, r.forced) for r in sampling.spatial_labels(far, "t", ["z"], 255, 1, "s").collect()}
    assert [got[k] for k in range(255)] == [(k + 1, False) for k in range(255)] and got[255] == (1, False)
    near = spark.createDataFrame([(k, z) for k in range(12) for z in (k // 2, k // 2 + 1)], "t bigint, z bigint")
    for reach, labels in ((0, 6), (1, 9), (1, 3)):
        got = {r.t: (r.label, r.forced) for r in sampling.spatial_labels(near, "t", ["z"], labels, reach, "s").collect()}
        clash = [(a, b) for a in range(12) for b in range(a) if abs(a // 2 - b // 2) <= 1 + reach and got[a][0] == got[b][0]]
        assert all(got[a][1] or got[b][1] for a, b in clash) and (labels == 3) == bool(clash)


@pytest.mark.parametrize("shape", ["crowd", "long tracks"])
def test_labels_are_those_of_the_order(spark, shape):
    """Many tracks in a few cells, each of which waits for the one before; tracks of several cells; and cells apart from the others."""
    from spanloom.functions.expr import stable_hash

    rng = random.Random(3)
    size = 1 if shape == "crowd" else 4
    cells = {t: {(rng.randrange(3) + 10 * (t % 2), rng.randrange(40 // 9 if size == 1 else 40)) for _ in range(rng.randint(1, size))} for t in range(1500 if size == 1 else 300)}
    df = spark.createDataFrame([(t, *c) for t, cs in cells.items() for c in cs] + [(9000, None, 1)], "t bigint, y bigint, x bigint")
    cells[9000] = set()
    order = [r.t for r in df.select("t").distinct().orderBy(stable_hash("t", seed="s"), "t").collect()]
    rank, want = {t: k for k, t in enumerate(sorted(cells))}, {}
    for t in order:
        used = [want[o][0] for o in want if any(abs(a - c) <= 1 and abs(b - d) <= 1 for a, b in cells[t] for c, d in cells[o])]
        free = [x for x in (1 + (rank[t] + k) % 5 for k in range(5)) if x not in used]
        want[t] = (free[0], False) if free else (min((used.count(x), x) for x in set(used))[1], True)
    got = {r.t: (r.label, r.forced) for r in sampling.spatial_labels(df, "t", ["y", "x"], 5, 1, "s").collect()}
    assert got == want


def test_lines_of_known_pitch(spark):
    rng = random.Random(6)
    cells = [(i, j, (1.0 if i % 20 < 6 else 0.05) + rng.random() * 0.05) for i in range(160) for j in range(40)]
    got = raster.line_gaps(spark.createDataFrame(cells, "i int, j int, v double"), "i", "j", "v", 160, 16, 8, (16.0, 24.0), 0.01).collect()
    assert sorted(r.start for r in got) == [0, 8, 16, 24, 32] and all(r.score > 0.95 and len(r.gaps) >= 5 for r in got)
    blank = raster.line_gaps(spark.createDataFrame([(0, 0, 1e-6)], "i int, j int, v double"), "i", "j", "v", 160, 16, 8, (16.0, 24.0), 0.01)
    assert blank.count() == 0


def test_cone_paths(spark):
    from spanloom.operators import paths

    cells = [("s", i, j) for i in range(7) for j in range(9)] + [("t", 0, 0), ("t", 5, 5)]
    got = paths.cone_paths(spark.createDataFrame(cells, "k string, i int, j int"), "k", "i", "j", spark.createDataFrame([("s", 3, 4), ("t", 0, 0), ("t", 9, 9)], "k string, i int, j int"), 2, "q").collect()
    assert sorted((r.k, r.cone, r.rank) for r in got) == sorted([("s", c, r) for c in range(4) for r in range(2)] + [("t", c, 0) for c in range(4)])
    for r in got:
        way = [(p.i, p.j) for p in r.path]
        assert way[0] == (r.anchor_i, r.anchor_j) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(way, way[1:]))
        assert abs(sum(math.dist(a, b) for a, b in zip(way, way[1:])) - r.length) < 1e-9
        if r.k == "s":
            dy, dx = way[-1][0] - 3, way[-1][1] - 4
            assert [dx >= abs(dy), -dx >= abs(dy), dy >= abs(dx), -dy >= abs(dx)][r.cone]
            short, long = sorted((abs(dy), abs(dx)))
            assert abs(r.length - (long - short + short * 2**0.5)) < 1e-9 and r.length >= (2 if r.cone < 2 else 1.5)


def test_stitched_path_of_two_sheets(spark):
    from spanloom.operators import paths

    rows = [("a", i, j, 0.0, float(i), float(j)) for i in range(9) for j in range(4)] + [("b", i, j, 0.4, float(i) + 5, float(j)) for i in range(9) for j in range(4)]
    v = spark.createDataFrame(rows + [("c", i, j, 90.0, float(i), float(j)) for i in range(3) for j in range(3)], "s string, i int, j int, z double, y double, x double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = paths.stitched_paths(v, "s", "i", "j", list("zyx"), pairs, 0.5, 2.0).orderBy("rank").collect()
    # Squares 5 to 7 of a lie on 0 to 2 of b: two squares from those, straight on, and over once.
    assert [(r.on, r.i) for r in got[:1] + got[-1:]] == [("a", 3), ("b", 4)] and {r.b for r in got} == {"b"}
    assert [r.rank for r in got] == list(range(len(got))) and sum(p.on != q.on for p, q in zip(got, got[1:])) == 1
    assert all(abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 for p, q in zip(got, got[1:]))


def test_gaps_are_those_of_all_pairs_without_all_pairs():
    import math
    import random
    import time

    import numpy as np

    from spanloom.operators import paths

    rng = random.Random(4)
    for high, wide in ((30, 4), (4, 30), (20, 20)):
        every = [(i, j) for i in range(high) for j in range(wide)]
        a, b = rng.sample(every, 40), rng.sample(every, 25)
        assert paths._gaps(np.array(a), np.array(b)).tolist() == [min(math.dist(x, y) for y in b) for x in a]
    long = np.array([(i, j) for i in range(60000) for j in range(6)])
    begin = time.time()
    assert paths._gaps(long[:150000], long[200000:]).min() > 0 and time.time() - begin < 20


def thin(cells):
    """Zhang and Suen's rules, cell by cell."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    cells = set(cells)
    while True:
        before = len(cells)
        for side in (0, 1):
            out = set()
            for c in cells:
                p = [int((c[0] + a, c[1] + b) in cells) for a, b in ring]
                turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
                sides = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if side == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
                if 2 <= sum(p) <= 6 and turns == 1 and sides == (0, 0):
                    out.add(c)
            cells -= out
        if len(cells) == before:
            return cells


def test_thinning_and_size_bands(spark):
    rng = random.Random(8)
    grids = {0: {(i, j) for i in range(3, 10) for j in range(12)}, 1: {(i, j) for i in range(12) for j in range(12) if rng.random() < 0.75}, 2: {(0, 0)}}
    df = spark.createDataFrame([(k, *c) for k, cells in grids.items() for c in cells], "k int, i int, j int")
    got = {}
    for r in raster.thinned(df, ["k"], "i", "j").collect():
        got.setdefault(r.k, set()).add((r.i, r.j))
    assert got == {k: thin(c) for k, c in grids.items()} and len(got[0]) < 15
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5), (6, 6), (9, 0)], "i int, j int")
    of = lambda *a, **k: sorted(tuple(r) for r in raster.dusted(cells, ["i", "j"], *a, **k).collect())
    assert of(2) == [(0, 0), (0, 1), (1, 1)] and of(2, faces_only=False) == [(0, 0), (0, 1), (1, 1), (5, 5), (6, 6)] and of(1, 2) == [(5, 5), (6, 6), (9, 0)]


def test_largest_part(spark):
    from spanloom.operators import paths

    rows = [("a", 0, j) for j in range(4)] + [("a", 2, j) for j in range(5)] + [("b", 7, 7), ("b", 9, 9)]
    got = sorted(tuple(r) for r in paths.largest_part(spark.createDataFrame(rows, "k string, i int, j int"), "k", "i", "j").collect())
    assert got == [("a", 2, j) for j in range(5)] + [("b", 7, 7)]


def test_spiral_is_found_among_strays(spark):
    from spanloom.operators import fits

    rng = random.Random(10)
    rows = []
    for k in range(400):
        w, theta = rng.randint(4, 9), rng.uniform(0, 2 * math.pi)
        r = (w + theta / (2 * math.pi)) * 21.5 + rng.gauss(0, 0.2) + (rng.uniform(10, 90) if k % 8 == 0 else 0)
        rows.append((w, 15 + r * math.sin(2.5 + theta), 33 + r * math.cos(2.5 + theta)))
    df = spark.createDataFrame(rows, "winding int, y double, x double")
    f = fits.fit_spiral(df, [18.0, 26.0], 2.0).first()
    assert abs(f.cy - 15) < 0.3 and abs(f.cx - 33) < 0.3 and abs(f.dr - 21.5) < 0.05 and abs(f.phase - 2.5) < 0.05 and f.sense == 1  # strays pull a little
    assert fits.fit_spiral(df.limit(0), [18.0], 2.0).count() == 0


@pytest.mark.parametrize(("most", "steps"), [(3, 2), (4, 3), (5, 3), (6, 2), (7, 4)])
def test_returns_of_any_length_are_found_from_both_ends(spark, most, steps):
    """Against a plain search of all simple paths."""
    rng = random.Random(most)
    place, near = {}, {}
    for a in range(14):
        for b in rng.sample(range(14), 3):
            if a != b and (a, b) not in place:
                place[a, b], place[b, a] = rng.randrange(60), rng.randrange(60)
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)

    def returns(node, goal, met, hops, far):
        return any(far(x) and (x == goal or hops > 1 and x not in met and returns(x, goal, met | {x}, hops - 1, lambda _: True)) for x in near[node])

    want = {}
    for s in near:
        walk = [s]
        while len(walk) <= steps and len(walk) + 1 <= most:
            fits = [c for c in near[walk[-1]] - set(walk) if returns(c, s, {*walk, c}, most - len(walk), lambda x, c=c: abs(place[c, x] - place[c, walk[-1]]) >= 12)]
            if not fits:
                break
            walk.append(min(fits, key=lambda c: ((walk[-1] * 31 + c * 17) % 7, c)))
        want[s] = walk
    g = spark.createDataFrame([(a, b, float(p)) for (a, b), p in place.items()], "src bigint, dst bigint, position double")
    got = graph.gated_walks(g, g.select(F.col("src").alias("node")).distinct(), steps, 12.0, (F.col("src") * 31 + F.col("dst") * 17) % 7, most)
    assert {r.start: r.walk for r in got.collect()} == want
    assert max(map(len, want.values())) > 2 or most == 3
