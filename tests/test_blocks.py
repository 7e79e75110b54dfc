"""Stretches and waves over long grids: few edges between blocks, few rounds, the results of a plain flood."""

import random

from spanloom.operators import blocks, graph, raster


def _flood(cells, moves):
    root, left = {}, set(cells)
    for c in sorted(cells):
        stack = [c] if c in left else []
        left.discard(c)
        while stack:
            p = stack.pop()
            root[p] = c
            for m in moves:
                q = (p[0] + m[0], p[1] + m[1])
                if q in left:
                    left.discard(q)
                    stack.append(q)
    return root


def test_stretches_over_blocks_are_those_of_a_flood(spark, monkeypatch):
    monkeypatch.setattr(blocks, "AREA", 4 * 36)  # blocks of 6 by 6
    random.seed(5)
    cells = {(random.randrange(-20, 20), random.randrange(-9, 9)) for _ in range(430)}
    df = spark.createDataFrame([*cells, (None, 1)], "i int, j int")
    for faces in (True, False):
        moves = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) == 1 or not faces and (a, b) != (0, 0)]
        got = {(r.i, r.j): (r.root.i, r.root.j) for r in blocks.grid_parts(df, ["i", "j"], faces).collect()}
        assert got == _flood(cells, moves)


def test_long_stretches_leave_few_edges_to_connect(spark, monkeypatch):
    seen, connect = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, *a: seen.append(e.count()) or connect(e, *a))
    cells = spark.createDataFrame([(i, j) for i in range(1000) for j in (0, 2)], "i int, j int")
    assert raster.dusted(cells, ["i", "j"], 3, 400, faces_only=False).count() == 0
    assert raster.dusted(cells, ["i", "j"], 3, 1001, faces_only=False).count() == 2000
    assert max(seen) < 50


def test_waves_along_a_strip_take_few_rounds(spark, monkeypatch):
    cuts, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda d: cuts.append(1) or cut(d))
    cells = spark.createDataFrame([(i, j, i == j == 0) for i in range(1500) for j in (0, 1)], "i bigint, j bigint, seed boolean")
    got = {(r.i, r.j): round(r.cost, 6) for r in blocks.geodesics(cells, "i", "j", "seed").collect()}
    assert got == {(i, j): round(i + (2**0.5 - 1 if i and j else j), 6) for i in range(1500) for j in (0, 1)}
    assert len(cuts) < 15
    small = blocks.geodesics(cells.where("i < 40"), "i", "j", "seed", block=8)
    assert {(r.i, r.j): round(r.cost, 6) for r in small.collect()} == {k: v for k, v in got.items() if k[0] < 40}
