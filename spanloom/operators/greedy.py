"""Selections that depend on what was selected before. Across keys they run apart; across space, as rounds of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import stable_hash
from . import graph, joins
from .blocks import unwrapped_grid  # noqa: F401

#: Points that a walk over all points takes up at a time.
AT_ONCE = 4096


def _even_choice(x: np.ndarray, least: float) -> list[int]:
    """Places of the most values of ascending x that are ``least`` apart, nearest (in squares) to an even spread; ties to the earlier."""
    count, last = 0, -np.inf
    for v in x:
        if v - last >= least:
            count, last = count + 1, v
    if count <= 1:
        return [int(np.argmin(np.abs(x - (x[0] + x[-1]) / 2)))] if len(x) else []
    goal = np.linspace(x[0], x[-1], count)
    # cost[i]: of the cheapest choice that ends at i; before[g][i]: the place before it in that choice.
    n = len(x)
    cost, before = (x - goal[0]) ** 2, []
    rank = rank0 = np.arange(n)  # order of choices by their places, for ties
    for g in goal[1:]:
        reach = np.minimum(np.searchsorted(x, x - least, "right"), rank0)  # places whose choices may go before: those up to x - least
        while np.any(late := (reach > 0) & (x - x[np.maximum(reach - 1, 0)] < least)):
            reach[late] -= 1
        while np.any(early := (reach < np.arange(n)) & (x - x[np.minimum(reach, n - 1)] >= least)):
            reach[early] += 1
        by = np.lexsort((rank, cost))
        order = np.empty(n, np.int64)
        order[by] = np.arange(n)
        first = np.minimum.accumulate(order)
        has = (reach > 0) & (first[np.maximum(reach - 1, 0)] < n)
        from_ = np.where(has, by[first[np.maximum(reach - 1, 0)]], -1)
        grown = np.where(has & np.isfinite(cost[np.maximum(from_, 0)]), cost[np.maximum(from_, 0)] + (x - g) ** 2, np.inf)
        before.append(from_)
        rank = np.lexsort((np.arange(n), rank[np.maximum(from_, 0)])).argsort()
        cost = grown
    out = [int(np.lexsort((rank, cost))[0])]
    for b in reversed(before):
        out.append(int(b[out[-1]]))
    return out[::-1]


def evenly_spaced(df: DataFrame, key: str, position: str, ident: str, least: float) -> DataFrame:
    """key, rank, ident, position: as many of each key's rows as can be ``least`` apart, as evenly as can be.

    An exact search by dynamic programming, one key at a time: keys are assumed to be bounded.
    """
    kinds = dict(df.dtypes)

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([position, ident], kind="stable").reset_index(drop=True)
        out = g.loc[_even_choice(g[position].to_numpy(float), least), [key, ident, position]]
        return out.assign(rank=np.arange(len(out)))[[key, "rank", ident, position]]

    schema = f"{key} {kinds[key]}, rank bigint, {ident} {kinds[ident]}, {position} {kinds[position]}"
    return df.where(F.col(position).isNotNull()).select(key, ident, position).groupBy(key).applyInPandas(choose, schema)


def spaced_random(points: DataFrame, ident: str, coords: list[str], spacing: float, count: int, seed: str) -> DataFrame:
    """The first ``count`` points, in a seeded order, of those that are ``spacing`` or more from all taken before.

    The greedy walk itself, some of the first points that are still open at a time (``AT_ONCE``): the driver holds these and
    what is taken, ``count`` at most. Points near to those taken then go, by a join with these alone; a point without a
    coordinate is near to none.
    """
    p = points.select(ident, *coords).withColumn("h", stable_hash(ident, seed=seed))
    if spacing <= 0:
        return p.orderBy("h", ident).limit(count).select(ident, *coords)
    open_, taken = graph.cut_lineage(p), []
    schema = p.select(ident, *coords).schema
    while len(taken) < count:
        batch, fresh, places = open_.orderBy("h", ident).limit(AT_ONCE).collect(), [], np.empty((AT_ONCE, len(coords)))
        for row in batch:
            at = np.array([np.nan if row[c] is None else row[c] for c in coords], float)
            far = np.sqrt(((places[: len(fresh)] - at) ** 2).sum(axis=1))
            if len(taken) + len(fresh) < count and not np.any(far < spacing):
                places[len(fresh)] = at
                fresh.append(tuple(row[c] for c in [ident, *coords]))
        taken += fresh
        if len(batch) < AT_ONCE or len(taken) >= count:
            break
        last = batch[-1]
        left = open_.where((F.col("h") > last["h"]) | ((F.col("h") == last["h"]) & (F.col(ident) > F.lit(last[ident]))))
        new = p.sparkSession.createDataFrame(fresh, schema).select(*[F.col(c).alias(f"o_{c}") for c in coords])
        close = joins.near_pairs(left, new, [(c, f"o_{c}") for c in coords], spacing).where(F.col("distance") < spacing).select(ident).distinct()
        open_ = graph.cut_lineage(left.join(close, ident, "left_anti"))
    return p.sparkSession.createDataFrame(taken, schema)
