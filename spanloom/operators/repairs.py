"""The fewest edges to change so that the deltas around every cycle add up to nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _conflict(edges: list[tuple], dropped: set[int]) -> list[int] | None:
    """The numbers of the edges of a cycle that does not close, or None; edges in order, so the result has no other."""
    around: dict = {}
    at: dict = {}
    for n, (a, b, d) in enumerate(edges):
        if n in dropped:
            continue
        if a not in at and b not in at:
            at[a], around[a] = (a, 0), [a]
        for u, v, e in ((a, b, d), (b, a, -d)):
            if u in at and v not in at:
                root, x = at[u]
                at[v] = (root, x + e)
                around[root].append(v)
        (ra, xa), (rb, xb) = at[a], at[b]
        if ra != rb:
            shift = xa + d - xb
            for v in around.pop(rb):
                at[v] = (ra, at[v][1] + shift)
                around[ra].append(v)
        elif xa + d != xb:
            return _cycle(edges, dropped, n)
    return None


def _cycle(edges: list[tuple], dropped: set[int], last: int) -> list[int]:
    """Edge ``last`` and the fewest edges before it that lead from one of its ends to the other."""
    near: dict = {}
    for n, (a, b, _) in enumerate(edges[:last]):
        if n not in dropped:
            near.setdefault(a, []).append((b, n))
            near.setdefault(b, []).append((a, n))
    start, goal, _ = edges[last]
    before: dict = {start: None}
    queue = [start]
    for u in queue:
        for v, n in near.get(u, ()):
            if v not in before:
                before[v] = (u, n)
                queue.append(v)
    out, v = [last], goal
    while before[v] is not None:
        v, n = before[v]
        out.append(n)
    return out


def _blocks(edges: list[tuple]) -> list[list[int]]:
    """The numbers of the edges of each biconnected part; edges that lie on no cycle are left out."""
    near: dict = {}
    for n, (a, b, _) in enumerate(edges):
        near.setdefault(a, []).append((b, n))
        near.setdefault(b, []).append((a, n))
    order: dict = {}
    low: dict = {}
    out: list[list[int]] = []
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        held: list[int] = []
        path = [(root, -1, iter(near[root]))]
        while path:
            u, by, ways = path[-1]
            for v, n in ways:
                if n == by:
                    continue
                if v == u:
                    out.append([n])
                elif v not in order:
                    order[v] = low[v] = len(order)
                    held.append(n)
                    path.append((v, n, iter(near[v])))
                    break
                elif order[v] < order[u]:
                    held.append(n)
                    low[u] = min(low[u], order[v])
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[u])
                    if low[u] >= order[up]:
                        at = held.index(by)
                        if len(held) - at > 1:
                            out.append(sorted(set(held[at:])))
                        del held[at:]
    return [sorted(b) for b in out if len(b) > 1 or edges[b[0]][0] == edges[b[0]][1]]


def _disjoint(edges: list[tuple], dropped: set[int], most: int) -> list[list[int]]:
    """Cycles that do not close and share no edge, up to ``most`` + 1: each costs a change of its own."""
    out, gone = [], set(dropped)
    while len(out) <= most and (cycle := _conflict(edges, gone)) is not None:
        out.append(cycle)
        gone.update(cycle)
    return out


def _fewest_of_block(edges: list[tuple]) -> set[int]:
    def search(dropped: set[int], kept: set[int], left: int) -> set[int] | None:
        cycles = _disjoint(edges, dropped, left)
        if not cycles:
            return dropped
        if len(cycles) > left:
            return None
        # Of the shortest cycle one edge must go; one that was tried in vain stays in what is tried after it.
        tried = set(kept)
        for n in sorted(min(cycles, key=len)):
            if n not in tried:
                found = search(dropped | {n}, tried, left - 1)
                if found is not None:
                    return found
                tried.add(n)
        return None

    spend = len(_disjoint(edges, set(), len(edges)))
    while (found := search(set(), set(), spend)) is None:
        spend += 1
    return found


def fewest(edges: list[tuple]) -> set[int]:
    """Numbers of the fewest edges (a, b, delta) without which all cycles close.

    A cycle lies in one biconnected part, so each part is solved alone. Cycles that do not close and share no edge bound the
    changes from below: the search begins at that number, and leaves a branch where what is left to spend is less.
    """
    out: set[int] = set()
    for block in _blocks(edges):
        out.update(block[n] for n in _fewest_of_block([edges[n] for n in block]))
    return out


def _potentials(edges: list[tuple], dropped: set[int]) -> dict:
    near: dict = {}
    for n, (a, b, d) in enumerate(edges):
        near.setdefault(a, [])
        near.setdefault(b, [])
        if n not in dropped:
            near[a].append((b, d))
            near[b].append((a, -d))
    at: dict = {}
    for root in near:
        if root not in at:
            at[root], queue = (root, 0), [root]
            for u in queue:
                for v, d in near[u]:
                    if v not in at:
                        at[v] = (root, at[u][1] + d)
                        queue.append(v)
    return at


def repaired(edges: DataFrame, key: str, src: str, dst: str, delta: str) -> DataFrame:
    """``edges`` (key, src, dst, delta) with repaired (null: as it would be if the edge were not there, where nothing else joins its
    ends) and changed: the fewest of each key's edges change; which of several such sets depends on nothing but the edges.

    A key's edges are one group. A self-loop closes only with a delta of 0.
    """
    kinds = dict(edges.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([src, dst, delta], kind="stable").reset_index(drop=True)
        e = list(zip(rows[src].tolist(), rows[dst].tolist(), (int(d) for d in rows[delta]), strict=True))
        out = fewest(e)
        at = _potentials(e, out)
        new = [(at[b][1] - at[a][1] if at[a][0] == at[b][0] else None) if n in out else d for n, (a, b, d) in enumerate(e)]
        return rows.assign(repaired=pd.Series(new, dtype=object), changed=[n in out for n in range(len(e))])

    schema = f"{key} {kinds[key]}, {src} {kinds[src]}, {dst} {kinds[dst]}, {delta} {kinds[delta]}, repaired bigint, changed boolean"
    return edges.select(key, src, dst, delta).groupBy(key).applyInPandas(solve, schema)
