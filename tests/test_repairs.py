"""The fewest repairs against trying all sets."""

import itertools
import random

from spanloom.operators import repairs


def closes(edges, kept):
    at = {}
    todo = [edges[n] for n in kept]
    while todo:
        if not any(a in at or b in at for a, b, _ in todo):
            at[todo[0][0]] = 0
        rest = []
        for a, b, d in todo:
            if a in at and b in at:
                if at[a] + d != at[b]:
                    return False
            elif a in at:
                at[b] = at[a] + d
            elif b in at:
                at[a] = at[b] - d
            else:
                rest.append((a, b, d))
        todo = rest
    return True


def test_fewest_match_all_sets():
    rng = random.Random(2)
    for _ in range(120):
        nodes = rng.randint(2, 6)
        x = [rng.randint(-3, 3) for _ in range(nodes)]
        pairs = rng.sample(list(itertools.combinations(range(nodes), 2)), rng.randint(1, nodes * (nodes - 1) // 2))
        edges = [(a, b, x[b] - x[a] + (rng.randint(-2, 2) if rng.random() < 0.3 else 0)) for a, b in pairs] + [(0, 1, 9)] * rng.randint(0, 1)
        least = next(n for n in range(len(edges) + 1) if any(closes(edges, set(range(len(edges))) - set(out)) for out in itertools.combinations(range(len(edges)), n)))
        got = repairs.fewest(edges)
        assert len(got) == least and closes(edges, set(range(len(edges))) - got)


def test_large_groups_end():
    """200 edges with 15 faults: in many parts, and all in one."""
    for seed, nodes in ((1, 60), (2, 90), (3, 120)):
        rng = random.Random(seed)
        x = [rng.randint(-9, 9) for _ in range(nodes)]
        near = [(a, b) for a in range(nodes) for b in range(a + 1, min(nodes, a + 6))]
        pairs = rng.sample(near, 200)
        edges = [(a, b, x[b] - x[a]) for a, b in pairs]
        for n in rng.sample(range(200), 15):
            a, b, d = edges[n]
            edges[n] = (a, b, d + rng.choice((-3, -2, -1, 1, 2, 3)))
        got = repairs.fewest(edges)
        assert 0 < len(got) <= 15 and closes(edges, set(range(200)) - got)


def test_edges_on_no_cycle_stay():
    tree = [(i, i + 1, i * i) for i in range(50)]
    assert repairs.fewest(tree) == set() and repairs._blocks(tree) == []
    rings = [e for k in range(6) for e in ((10 * k, 10 * k + 1, 1), (10 * k + 1, 10 * k + 2, 1), (10 * k, 10 * k + 2, 5), (10 * k + 2, 10 * k + 10, 7))]
    assert len(repairs._blocks(rings)) == 6 and len(repairs.fewest(rings)) == 6


def test_repaired_edges_close(spark):
    rows = [(1, 0, 1, 2), (1, 1, 2, 2), (1, 0, 2, 5), (1, 2, 3, 1), (1, 0, 3, 5), (2, 0, 1, 1), (2, 0, 1, 2), (3, 5, 5, 0), (3, 5, 5, 4)]
    df = spark.createDataFrame(rows, "k int, a bigint, b bigint, d bigint")
    got = {(r.k, r.a, r.b, r.d): (r.repaired, r.changed) for r in repairs.repaired(df, "k", "a", "b", "d").collect()}
    assert got[1, 0, 2, 5] == (4, True) and sum(bool(c) for (k, *_), (_, c) in got.items() if k == 1) == 1
    assert sorted(c for (k, *_), (_, c) in got.items() if k == 2) == [False, True]
    assert got[3, 5, 5, 4] == (0, True) and got[3, 5, 5, 0] == (0, False)
