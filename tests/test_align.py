"""Soft alignments against all paths of short pairs, and the best path against a plain dynamic program."""

import math
import random
from functools import lru_cache

import numpy as np
import pytest

from spanloom.operators import align

COSTS = align.Costs(1.7, 0.6, 1.1, 0.9, 4.0, 0.8)


def paths(a, b, costs):
    """(weight, matches, missing, extra) of every alignment."""
    out = []

    def go(i, j, state, cost, matches, missing, extra):
        if i == len(a) and j == len(b):
            out.append((math.exp(-cost / costs.temperature), matches, missing, extra))
        if i < len(a) and j < len(b) and abs(a[i] - b[j]) <= costs.reach:
            go(i + 1, j + 1, "m", cost + abs(a[i] - b[j]), [*matches, (i, j)], missing, extra)
        if i < len(a):
            go(i + 1, j, "x", cost + (costs.missing_extend if state == "x" else costs.missing_open), matches, [*missing, i], extra)
        if j < len(b):
            go(i, j + 1, "y", cost + (costs.extra_extend if state == "y" else costs.extra_open), matches, missing, [*extra, j])

    go(0, 0, "m", 0.0, [], [], [])
    return out


def best_cost(a, b, costs):
    @lru_cache(None)
    def rest(i, j, state):
        if i == len(a) and j == len(b):
            return 0.0
        found = []
        if i < len(a) and j < len(b) and abs(a[i] - b[j]) <= costs.reach:
            found.append(abs(a[i] - b[j]) + rest(i + 1, j + 1, 0))
        if i < len(a):
            found.append((costs.missing_extend if state == 1 else costs.missing_open) + rest(i + 1, j, 1))
        if j < len(b):
            found.append((costs.extra_extend if state == 2 else costs.extra_open) + rest(i, j + 1, 2))
        return min(found)

    return rest(0, 0, 0)


def pairs(seed, count, most):
    rng = random.Random(seed)
    made = lambda: sorted(rng.uniform(0, 12) for _ in range(rng.randint(0, most)))
    return [(k, made(), made()) for k in range(count)]


def run(spark, rows, costs, parts=3, cells=align.CELLS):
    df = spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>").repartition(parts)
    return {r.id: r for r in align.aligned(df, "a", "b", costs, cells).collect()}


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_sums_over_all_alignments(spark, cells):
    rows = [*pairs(1, 40, 4), (100, [], []), (101, [1.0, 2.0], []), (102, None, [3.0, None, 4.0])]
    have = run(spark, rows, COSTS, cells=cells)
    for k, a, b in rows:
        a, b = ([v for v in x or [] if v is not None] for x in (a, b))
        every, r = paths(a, b, COSTS), have[k]
        total = sum(w for w, *_ in every)
        share = lambda f: sum(w for w, *p in every if f(*p)) / total  # noqa: B023, E731
        assert r.log_sum == pytest.approx(math.log(total))
        assert r.expected_matches == pytest.approx(sum(w * len(m) for w, m, _, _ in every) / total)
        assert r.missing == pytest.approx([share(lambda m, x, y: i in x) for i in range(len(a))])  # noqa: B023
        assert r.extra == pytest.approx([share(lambda m, x, y: j in y) for j in range(len(b))])  # noqa: B023
        assert r.score == pytest.approx(math.log(max(w for w, *_ in every)))
        top = {tuple(m) for w, m, _, _ in every if w > math.exp(r.score) * (1 - 1e-9)}
        assert tuple((m.i, m.j) for m in r.matches) in top
        for m in r.matches:
            assert m.p == pytest.approx(share(lambda n, x, y: (m.i, m.j) in n))  # noqa: B023


def test_long_pairs_match_the_plain_recursion(spark):
    rows, costs = pairs(2, 30, 70), align.Costs(0.5, 0.2, 0.4, 0.3)
    have = run(spark, rows, costs, 5)
    for k, a, b in rows:
        r, want = have[k], best_cost(tuple(a), tuple(b), costs)
        assert -r.score == pytest.approx(want)
        matches = [(m.i, m.j) for m in r.matches]
        assert matches == sorted(matches) and len(set(m[0] for m in matches)) == len(set(m[1] for m in matches)) == len(matches)
        # Each item is matched or alone, and probabilities add up.
        assert sum(r.missing) + r.expected_matches == pytest.approx(len(a)) and sum(r.extra) + r.expected_matches == pytest.approx(len(b))


def test_other_columns_and_no_pairs(spark):
    df = spark.createDataFrame([(1, [1.0], [1.2], "z", {"k": 1})], "id int, a array<double>, b array<double>, other string, more map<string, int>")
    r = align.aligned(df, "a", "b").first()
    assert r.other == "z" and r.more == {"k": 1} and [(m.i, m.j) for m in r.matches] == [(0, 0)]
    assert align.aligned(df.limit(0), "a", "b").count() == 0


def test_batches_hold_pairs_of_like_size():
    sizes = np.array([(random.Random(k).randint(0, 50), random.Random(-k).randint(0, 50)) for k in range(200)])
    found = align.batches(sizes, 5000)
    assert sorted(np.concatenate(found).tolist()) == list(range(200))
    assert all(len(b) == 1 or (sizes[b, 0].max() + 1) * (sizes[b, 1].max() + 1) * len(b) <= 5000 for b in found)
