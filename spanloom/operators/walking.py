"""Walks along sheets of a volume: many seeds at once, each keeping to its own band of a signed distance field.

The volume is packed once into blocks with a halo, one row each. In a round, walkers meet the block that they stand in and go
on inside of it as far as its halo lets them see; then they are dealt anew. A block with very many walkers is met in parts. A step looks at
voxels only, so the result does not depend on blocks, parts or order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Tables

_ZYX = ("z", "y", "x")
_FIELDS = ("d", "nz", "ny", "nx")
#: Walkers that meet a block in one task.
PART = 20_000


@dataclass(frozen=True)
class Rules:
    """How walkers step: dz of a substep, how far to search for a band and for its edges, the distance of samples; when they stop."""

    substep: float = 4.0
    band_search: float = 8.0
    edge_search: float = 3.0
    sample: float = 1.0
    least_width: float = 0.5
    width_change: float = 2.0
    alignment: float = 0.75
    tolerance: float = 1.0


class Window:
    """A box of voxels around a block; what is not there is NaN."""

    def __init__(self, low: np.ndarray, fields: np.ndarray):
        self.low, self.fields = low, fields  # (z, y, x, field)

    def holds(self, points: np.ndarray) -> np.ndarray:
        """Points all of whose eight voxels lie in the window."""
        at = np.floor(points) - self.low
        return ((at >= 0) & (at + 1 < np.array(self.fields.shape[:3]))).all(axis=-1)

    def at(self, points: np.ndarray) -> np.ndarray:
        """(..., field) between the eight voxels around each point; NaN where one of them is missing."""
        base = np.floor(points).astype(np.int64)
        part = points - base
        base = np.clip(base - self.low.astype(np.int64), 0, np.array(self.fields.shape[:3]) - 2)
        out = 0.0
        for corner in np.ndindex(2, 2, 2):
            weight = np.prod(np.where(np.array(corner) == 1, part, 1 - part), axis=-1)
            out = out + weight[..., None] * self.fields[tuple(np.moveaxis(base + np.array(corner), -1, 0))]
        return out


def _axis(normal: np.ndarray) -> np.ndarray:
    """The normal's direction within its slice; NaN where it has none."""
    flat = normal.copy()
    flat[:, 0] = 0
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 1e-6, flat / size, np.nan)


def _samples(window: Window, points: np.ndarray, axis: np.ndarray, reach: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Places s along the axis, and the field there."""
    n = int(np.ceil(reach / step))
    s = np.arange(-n, n + 1) * step
    return s, window.at(points[:, None] + s[None, :, None] * axis[:, None])[..., 0]


def _crossings(s: np.ndarray, field: np.ndarray, entry: bool) -> np.ndarray:
    """(points, samples - 1): where the field crosses 0 between two samples, in (entry) or out of the band; NaN where it does not."""
    a, b = field[:, :-1], field[:, 1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        crosses = (a >= 0) & (b < 0) if entry else (a < 0) & (b >= 0)
        return np.where(crosses, s[:-1] + (s[1:] - s[:-1]) * a / (a - b), np.nan)


def first_bands(window: Window, points: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, exit, axis, alive): the complete band along the axis whose centre is nearest to each point, the earlier of two as near."""
    axis = _axis(window.at(points)[:, 1:])
    s, field = _samples(window, points, axis, rules.band_search, rules.sample)
    inward, outward = _crossings(s, field, True), _crossings(s, field, False)
    # A band goes from an entry to the first exit after it, over samples that are all there.
    best = np.full((len(points), 3), np.nan)
    for k in range(inward.shape[1]):
        later = np.where(np.arange(outward.shape[1]) > k, outward, np.nan)
        there = ~np.isnan(later)
        first = np.where(there.any(axis=1), there.argmax(axis=1), 0)
        end = later[np.arange(len(points)), first]
        whole = np.array([not np.isnan(field[i, k : f + 2]).any() for i, f in enumerate(first)], bool)
        middle = (inward[:, k] + end) / 2
        better = whole & ~np.isnan(middle) & (np.isnan(best[:, 0]) | (np.abs(middle) < np.abs(best[:, 0])))
        best[better] = np.stack([middle, inward[:, k], end], axis=1)[better]
    alive = ~np.isnan(best[:, 0])
    return points + best[:, 1:2] * axis, points + best[:, 2:3] * axis, axis, alive


def _slid(window: Window, points: np.ndarray, dz: np.ndarray) -> np.ndarray:
    """Points a step of dz further in the tangent plane, by the shortest way within the slice; NaN where the sheet is flat."""
    n = window.at(points)[:, 1:]
    flat = n[:, 1] ** 2 + n[:, 2] ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        k = np.where(flat > 1e-12, -dz * n[:, 0] / flat, np.nan)
    return points + np.stack([dz, k * n[:, 1], k * n[:, 2]], axis=1)


def _edge(window: Window, points: np.ndarray, axis: np.ndarray, entry: bool, rules: Rules) -> np.ndarray:
    """The one crossing within reach of each predicted edge; NaN where there is none, or more than one."""
    s, field = _samples(window, points, axis, rules.edge_search, rules.sample)
    found = _crossings(s, field, entry)
    found[np.abs(found) > rules.edge_search] = np.nan
    one = (~np.isnan(found)).sum(axis=1) == 1
    return points + np.where(one, np.nansum(found, axis=1), np.nan)[:, None] * axis


def stepped(window: Window, entry: np.ndarray, exit_: np.ndarray, axis: np.ndarray, dz: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, exit, axis, alive) after a step of dz each: both edges slide along the sheet and are found again."""
    width = np.linalg.norm(exit_ - entry, axis=1)
    low, high = _slid(window, entry, dz), _slid(window, exit_, dz)
    turned = _axis(window.at((low + high) / 2)[:, 1:])
    low, high = _edge(window, low, turned, True, rules), _edge(window, high, turned, False, rules)
    with np.errstate(invalid="ignore"):
        after = ((high - low) * turned).sum(axis=1)
        alive = (after > rules.least_width) & (np.abs(after - width) <= rules.width_change) & ((turned * axis).sum(axis=1) > rules.alignment)
    return low, high, turned, alive


def _in_sight(window: Window, low: np.ndarray, high: np.ndarray, dz: np.ndarray, rules: Rules) -> np.ndarray:
    """Whether all that a step may look at lies in the window: the voxels of both edges decide where it looks."""
    ok = window.holds(low) & window.holds(high)
    for p in (low, high):
        slid = _slid(window, np.where(ok[:, None], p, window.low), dz)
        reach = rules.edge_search + rules.sample
        ends = np.where(np.isnan(slid), p, slid)
        ok &= window.holds(ends - reach) & window.holds(ends + reach)
    return ok


_STATE = "id {id}, z0 double, y0 double, x0 double, steps int, left int, back boolean, dz double, lz double, ly double, lx double, hz double, hy double, hx double, az double, ay double, ax double, oz double, oy double, ox double, cz double, cy double, cx double, status string"


def _walk(rows: dict[str, np.ndarray], window: Window, rules: Rules) -> dict[str, np.ndarray]:
    """Walkers as far as the window lets them see. status: new, walking, done or dead."""
    get = lambda p: np.stack([rows[f"{p}{c}"] for c in _ZYX], axis=1)
    low, high, axis, origin = get("l"), get("h"), get("a"), get("o")
    seed = np.stack([rows[f"{c}0"] for c in _ZYX], axis=1)
    status, left, back = rows["status"].copy(), rows["left"].copy(), rows["back"].copy()
    dz = rows["dz"]
    new = np.flatnonzero(status == "new")
    if len(new):
        low[new], high[new], axis[new], alive = first_bands(window, seed[new], rules)
        origin[new] = (low[new] + high[new]) / 2
        status[new] = np.where(alive, "walking", "dead")
    moved = status == "new"
    moved[new] = True
    while True:
        turn = np.flatnonzero((status == "walking") & (left == 0))
        ends = turn[back[turn]]
        status[ends] = np.where(np.linalg.norm((low[ends] + high[ends]) / 2 - origin[ends], axis=1) <= rules.tolerance, "done", "dead")
        out = turn[~back[turn]]
        # There: its place is kept, and the walk goes back.
        for i, c in enumerate(_ZYX):
            rows[f"c{c}"][out] = ((low[out] + high[out]) / 2)[:, i]
        back[out], left[out] = True, rows["steps"][out]
        status[out[left[out] == 0]] = "done"
        go = np.flatnonzero((status == "walking") & (left > 0))
        if len(go):
            step = np.where(back[go], -1.0, 1.0) * dz[go]
            seen = _in_sight(window, low[go], high[go], step, rules)
            go, step = go[seen], step[seen]
        if not len(go):
            break
        low[go], high[go], axis[go], alive = stepped(window, low[go], high[go], axis[go], step, rules)
        left[go] -= 1
        status[go[~alive]] = "dead"
        moved[go] = True
    # What could not move where it stands in the middle of its window never can.
    status[(status == "walking") & ~moved] = "dead"
    for p, v in (("l", low), ("h", high), ("a", axis), ("o", origin)):
        for i, c in enumerate(_ZYX):
            rows[f"{p}{c}"] = v[:, i]
    return {**rows, "status": status, "left": left, "back": back}


def packed_blocks(voxels: DataFrame, block: int, halo: int) -> DataFrame:
    """bz, by, bx, cells: one row for each block that has voxels in its window, with the places and fields of these."""
    seen = voxels.select(*[F.col(c).cast("bigint").alias(c) for c in _ZYX], *[F.col(c).cast("double").alias(c) for c in _FIELDS]).dropna()
    for c in _ZYX:
        seen = seen.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block))))
    return seen.groupBy("bz", "by", "bx").agg(F.collect_list(F.struct(*_ZYX, *_FIELDS)).alias("cells"))


def sheet_walks(voxels: DataFrame, seeds: DataFrame, dz: float, rules: Rules = Rules(), block: int = 32, halo: int = 24) -> DataFrame:
    """id, z, y, x, alive: where the band nearest to each seed is after dz along z, and whether the walk holds.

    ``voxels`` (z, y, x, d, nz, ny, nx): a field that is negative inside of sheets, and their normals. ``seeds`` (id, z, y, x).
    A walk takes the complete band (in and out again) nearest to its seed along the in-slice direction of the normal. In
    substeps both edges slide in the tangent plane and are found again within reach; it stops (alive is false) where an edge is missing or not
    the only one, voxels are missing, the width or the direction changes too much, or the walk back by -dz does not end where it
    began. A walk that stopped on its way back keeps its place; before that z, y, x are null, as they are for seeds with nulls.
    Repeated ids are walks of their own. ``halo`` must hold a step and what it looks at.
    """
    if halo < max(rules.band_search, rules.substep + rules.edge_search) + rules.sample + 2:
        raise ValueError("the halo must hold a step and what it looks at")
    steps = max(0, int(np.ceil(abs(dz) / rules.substep)))
    kind = dict(seeds.dtypes)["id"]
    schema = _STATE.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    empty = [F.lit(None).cast("double").alias(f"{p}{c}") for p in "lhaoc" for c in _ZYX]
    now = seeds.select(
        "id", *[F.col(c).cast("double").alias(f"{c}0") for c in _ZYX], F.lit(steps).alias("steps"), F.lit(steps).alias("left"), F.lit(False).alias("back"), F.lit(dz / steps if steps else 0.0).alias("dz"), *empty,
        F.when(F.col("z").isNull() | F.col("y").isNull() | F.col("x").isNull(), "dead").otherwise("new").alias("status"),
    )
    now = now.select(*names)
    tables = Tables(seeds.sparkSession, "walks")
    blocks = tables.put(packed_blocks(voxels, block, halo), "blocks")
    size = block + 2 * halo

    def run(walkers: pa.Table, found: pa.Table) -> pa.Table:
        if len(found) == 0:
            gone = walkers.select(names)
            return gone.set_column(names.index("status"), "status", pa.array(["dead"] * len(gone), pa.string()))
        low = np.array([found.column(f"b{c}")[0].as_py() for c in _ZYX]) * block - halo
        cells = found.column("cells").combine_chunks().flatten()
        place = np.stack([cells.field(c).to_numpy() for c in _ZYX], axis=1) - low
        fields = np.full((size, size, size, len(_FIELDS)), np.nan)
        fields[tuple(place.T)] = np.stack([cells.field(c).to_numpy() for c in _FIELDS], axis=1)
        rows = {c: np.array(walkers.column(c).to_numpy(zero_copy_only=False)) for c in names if c not in ("id", "status")}
        rows = {c: v.astype(float) if v.dtype == object else v for c, v in rows.items()}
        rows["status"] = np.array(walkers.column("status").to_pylist(), object)
        rows["back"] = rows["back"].astype(bool)
        out = _walk(rows, Window(low.astype(float), fields), rules)
        made = {c: pa.array(out[c], from_pandas=True).cast(walkers.schema.field(c).type) for c in names if c != "id"}
        return pa.table([walkers.column("id") if c == "id" else made[c] for c in names], names=names)

    over = []
    while True:
        open_ = F.col("status").isin("new", "walking")
        over.append(now.where(~open_))
        now = now.where(open_)
        if now.isEmpty():
            break
        middle = lambda c: F.when(F.col("status") == "new", F.col(f"{c}0")).otherwise((F.col(f"l{c}") + F.col(f"h{c}")) / 2)  # noqa: B023, E731
        dealt = now
        for c in _ZYX:
            dealt = dealt.withColumn(f"b{c}", F.floor(middle(c) / block))
        parts = dealt.groupBy("bz", "by", "bx").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        keys = ["bz", "by", "bx", "part"]
        dealt = dealt.join(parts, ["bz", "by", "bx"]).withColumn("part", F.pmod(F.xxhash64("id", "z0", "y0", "x0"), "parts").cast("int")).drop("parts")
        met = blocks.join(parts, ["bz", "by", "bx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        now = tables.put(dealt.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, schema), f"walkers-{len(over)}")
    done = over[0]
    for more in over[1:]:
        done = done.unionByName(more)
    return done.select("id", *[F.col(f"c{c}").alias(c) for c in _ZYX], (F.col("status") == "done").alias("alive"))
