"""Unwrapping reaches every cell of a component, however deep it is."""

import math

from spanloom.operators import greedy


def test_deep_components_are_unwrapped_whole(spark):
    # A strip of 70 steps and a lone cell; the angle falls slowly, over three turns in all.
    rows = [(0, j, 6.0 - 0.3 * j) for j in range(71)] + [(5, 5, 1.0)]
    cells = spark.createDataFrame([(i, j, a % (2 * math.pi)) for i, j, a in rows], "i int, j int, a double")
    got = {(r.i, r.j): (r.turns, r.main) for r in greedy.unwrapped_grid(cells, "i", "j", "a").collect()}
    assert len(got) == len(rows)
    assert all(got[i, j] == (-int(a // (2 * math.pi)), i == 0) for i, j, a in rows)


def test_query_unwraps_every_event(spark):
    from spanloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["unwrapped_block_grid"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
