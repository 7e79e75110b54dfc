"""Ordered sequences in rows: (sequence id, position, values). A window over one sequence is a bounded sort.

Windows are partitioned by the sequence, so a sequence is one task's work: sequences are assumed to be bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TWO_PI, half_even


def over(key, order) -> Window:
    keys, orders = ([k] if isinstance(k, (str, Column)) else list(k) for k in (key, order))
    return Window.partitionBy(*keys).orderBy(*orders)


def running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Numbers all rows from 0 in ``order``: rows are ranged over tasks by it, each task numbers its own, and what lies before a
    task is added. No task gets all rows; equal rows are numbered in any order among themselves."""
    cols = [c if isinstance(c, Column) else F.col(c) for c in order]
    d = df.repartitionByRange(*cols).sortWithinPartitions(*cols).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    from .graph import cut_lineage

    # Written once: ranges are drawn from a sample, and must not be drawn anew between the counts and the rows.
    d = cut_lineage(d.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = d.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row a task: a small table, numbered in one.
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return d.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def numbered_within(df: DataFrame, keys: list[str], order: list, name: str = "id") -> DataFrame:
    """Numbers the rows of each key from 0 in ``order``, without a task that gets all rows of a key: rows of all keys are numbered together, and what lies before a key is taken off."""
    d = numbered(df, [*keys, *order], name)
    if not keys:
        return d
    first = d.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return d.join(first, same).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *[f"__k{i}" for i in range(len(keys))])


def step_lengths(df: DataFrame, key, order, coords: list[str], name: str = "step") -> DataFrame:
    """Distance from the point before, 0 for the first."""
    w = over(key, order)
    square = sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in coords[1:]), F.pow(F.col(coords[0]) - F.lag(coords[0]).over(w), 2))
    return df.withColumn(name, F.coalesce(F.sqrt(square), F.lit(0.0)))


def arclength_tortuosity(df: DataFrame, key: str, order, coords: list[str]) -> DataFrame:
    """points, arclength, chord and their ratio (infinite where the chord is 0) of each sequence."""
    orders = [order] if isinstance(order, str) else list(order)
    place, point = F.struct(*orders), F.struct(*coords)
    s = step_lengths(df, key, orders, coords).groupBy(key).agg(F.count("*").alias("points"), F.sum("step").alias("arclength"), F.min_by(point, place).alias("a"), F.max_by(point, place).alias("b"))
    chord = F.sqrt(sum((F.pow(F.col(f"b.{c}") - F.col(f"a.{c}"), 2) for c in coords), F.lit(0.0)))
    s = s.withColumn("chord", chord)
    return s.select(key, "points", "arclength", "chord", F.when(F.col("chord") > 0, F.col("arclength") / F.col("chord")).otherwise(F.lit(float("inf"))).alias("tortuosity"))


def unwrapped(df: DataFrame, key, order, angle: str, value: str, per_turn: float, name: str = "unwrapped") -> DataFrame:
    """value plus per_turn for each crossing of angle 0: up if the angle jumps by more than pi, down if it falls so."""
    w = over(key, order)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(jump > TWO_PI / 2, per_turn).when(jump < -TWO_PI / 2, -per_turn).otherwise(0.0)
    return df.withColumn("__turn", turn).withColumn(name, F.col(value) + F.sum("__turn").over(running(w))).drop("__turn")


def islands(df: DataFrame, key, order, keep: Column) -> DataFrame:
    """Contiguous runs of rows where ``keep`` holds: key, run, start and end position (from 0), length."""
    keys = [key] if isinstance(key, str) else list(key)
    w = over(keys, order)
    d = df.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__on", F.coalesce(keep, F.lit(False)))
    d = d.withColumn("__run", F.col("__pos") - F.sum(F.col("__on").cast("int")).over(running(w))).where("__on")
    return d.groupBy(*keys, "__run").agg(F.min("__pos").alias("start"), F.max("__pos").alias("end"), F.count("*").alias("length")).drop("__run")


def longest_run(df: DataFrame, key: str, order, keep: Column, least: int = 2) -> DataFrame:
    """The longest run of each sequence, the earliest of equals; runs under ``least`` are none."""
    best = F.max_by(F.struct("start", "end", "length"), F.struct("length", -F.col("start"))).alias("r")
    return islands(df, key, order, keep).where(F.col("length") >= least).groupBy(key).agg(best).select(key, "r.*")


def gap_clusters(df: DataFrame, key, order, coords: list[str], gap: float, name: str = "cluster") -> DataFrame:
    """Numbers, from 1, of the clusters of neighbouring rows; a new one begins where any coordinate moves by over ``gap``."""
    w = over(key, order)
    apart = F.lit(False)
    for c in coords:
        apart = apart | (F.abs(F.col(c) - F.lag(c).over(w)) > gap)
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", (first | apart).cast("int")).withColumn(name, F.sum("__new").over(running(w))).drop("__new")


def linear_resample(df: DataFrame, key: str, position: str, value: str, grid: Column) -> DataFrame:
    """Values at the positions of ``grid`` (an array column of the sequence's lo and hi) by linear interpolation.

    Each bracket [x, next x) makes its own grid points: no join, and no row but those asked for.
    """
    w = over(key, position)
    b = df.groupBy(key, position).agg(F.avg(value).alias(value))
    bounds = Window.partitionBy(key)
    b = b.withColumn("lo", F.min(position).over(bounds)).withColumn("hi", F.max(position).over(bounds)).withColumn("__x1", F.lead(position).over(w)).withColumn("__v1", F.lead(value).over(w))
    inside = F.filter(grid, lambda g: (g >= F.col(position)) & (g < F.coalesce(F.col("__x1"), F.lit(float("inf")))))
    at = b.withColumn("at", F.explode(inside))
    t = (F.col("at") - F.col(position)) / (F.col("__x1") - F.col(position))
    return at.select(key, "at", F.coalesce(F.col(value) + t * (F.col("__v1") - F.col(value)), F.when(F.col("at") == F.col(position), F.col(value))).alias(value)).where(f"{value} is not null")


def rasterized(df: DataFrame, key, order, coords: list[str]) -> DataFrame:
    """Cells of the polyline, without gaps: max-norm many steps between points, rounded half to even; joints once."""
    keys = [key] if isinstance(key, str) else list(key)
    w = over(keys, order)
    d = df
    for c in coords:
        d = d.withColumn(f"__p_{c}", F.lag(c).over(w))
    span = F.greatest(*[F.abs(F.col(c) - F.col(f"__p_{c}")) for c in coords]) if len(coords) > 1 else F.abs(F.col(coords[0]) - F.col(f"__p_{coords[0]}"))
    d = d.withColumn("__n", F.coalesce(F.ceil(span), F.lit(0)).cast("int")).withColumn("__pos", F.row_number().over(w))
    first = F.col(f"__p_{coords[0]}").isNull()
    k = F.explode(F.when(first, F.array(F.lit(0))).when(F.col("__n") > 0, F.sequence(F.lit(1), F.col("__n"))).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("step", k)
    cells = [half_even(F.when(F.col("step") == 0, F.col(c).cast("double")).otherwise(F.col(f"__p_{c}") + (F.col(c) - F.col(f"__p_{c}")) * F.col("step") / F.col("__n"))).cast("long").alias(c) for c in coords]
    return d.select(*keys, F.col("__pos").cast("long").alias("segment"), F.col("step").cast("long").alias("step"), *cells)


def spaced(points: Column, distance, least: float, keep_last: bool = False) -> Column:
    """Greedy thinning of an ordered array: the first stays, then each at least ``least`` from the last that stayed."""
    none = F.filter(points, lambda p: F.lit(False))
    kept = F.aggregate(points, none, lambda acc, p: F.when((F.size(acc) == 0) | (distance(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)) * 0 - 1), p) >= least), F.concat(acc, F.array(p))).otherwise(acc))
    if not keep_last:
        return kept
    last = F.element_at(points, -1)
    return F.when(F.size(points) < 2, points).when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last)))


def anchored_counts(df: DataFrame, key, position: str, most: float) -> DataFrame:
    """Between mandatory anchors: as many equal intervals as keep each at most ``most``; key, position, gap, intervals."""
    w = over(key, position)
    gap = F.lead(position).over(w) - F.col(position)
    return df.withColumn("gap", gap).where("gap > 0").withColumn("intervals", F.greatest(F.ceil(F.col("gap") / most), F.lit(1)))


def tangents(df: DataFrame, key: str, order: str, coords: list[str], reach: float) -> DataFrame:
    """Unit vector at each point between the nearest points at least ``reach`` away along the sequence, ends included; null if 0."""
    pts = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *coords))).alias("__pts"))
    p = pts.select(key, "__pts", F.posexplode("__pts").alias("__i", "__p"))

    def far(side: str) -> Column:
        dist = lambda q: F.sqrt(sum((F.pow(q[c] - F.col(f"__p.{c}"), 2) for c in coords), F.lit(0.0)))
        i, n = F.col("__i"), F.size("__pts")
        if side == "left":
            found = F.filter(F.reverse(F.slice("__pts", F.lit(1), i)), lambda q: dist(q) >= reach)
            return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.get("__pts", F.lit(0)))
        found = F.filter(F.slice("__pts", i + 2, n), lambda q: dist(q) >= reach)
        return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.get("__pts", n - 1))

    p = p.withColumn("__a", far("left")).withColumn("__b", far("right"))
    norm = F.sqrt(sum((F.pow(F.col(f"__b.{c}") - F.col(f"__a.{c}"), 2) for c in coords), F.lit(0.0)))
    p = p.withColumn("__n", norm)
    unit = [F.when(F.col("__n") > 0, (F.col(f"__b.{c}") - F.col(f"__a.{c}")) / F.col("__n")).alias(f"t_{c}") for c in coords]
    return p.select(key, F.col(f"__p.{order}").alias(order), *unit)


def catmull_rom(df: DataFrame, key: str, order: str, value: str, parts: int) -> DataFrame:
    """``parts`` values on each segment by the Catmull-Rom spline; the ends are continued by reflection."""
    w = over(key, order)
    v = F.col(value)
    d = df.withColumn("v0", F.lag(value).over(w)).withColumn("v2", F.lead(value).over(w)).withColumn("v3", F.lead(value, 2).over(w)).where("v2 is not null")
    v0, v2 = F.coalesce("v0", 2 * v - F.col("v2")), F.col("v2")
    v3 = F.coalesce("v3", 2 * v2 - v)
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("t", F.col("k") / parts)
    t = F.col("t")
    curve = 0.5 * (2 * v + (v2 - v0) * t + (2 * v0 - 5 * v + 4 * v2 - v3) * t * t + (3 * v - v0 - 3 * v2 + v3) * t * t * t)
    return d.select(key, order, "k", curve.alias(value))




def complete_bands(samples: DataFrame, ray: str, order, arc: str, field: str, valid: str, dot: str, least_gap: float, graze_dot: float, graze_depth: float) -> DataFrame:
    """Stretches of each ray where ``field`` falls below 0 and comes back: ray, ordinal, center, width, depth, clearance_before,
    ambiguous, graze, merged, interior_invalid, unsupported_before.

    A band begins and ends where the field crosses 0 between two valid samples, in between them by proportion; stretches
    that a ray's end cuts are none. Depth is the least field inside, clearance the largest valid one since the band before
    (null for a ray's first). Two neighbours whose centres are nearer than ``least_gap``, measured along the normal by the
    smaller ``dot`` (of the last sample up to the centre, null: no normal), become one, unless an invalid sample lies inside
    either or between their centres or one has no normal: then both are ambiguous, as are both of a pair that overlaps a
    merged one. A band grazes if its dot is under ``graze_dot`` and it is not deeper than ``graze_depth``.
    """
    orders = [order] if isinstance(order, str) else list(order)
    w = over(ray, orders)
    s = samples.select(ray, *orders, F.col(arc).alias("x"), F.col(field).alias("f"), F.col(valid).alias("ok"), F.col(dot).alias("dot"), F.row_number().over(w).alias("pos"))
    w = over(ray, "pos")
    x1, f1, ok1 = (F.lead(c).over(w) for c in ("x", "f", "ok"))
    s = s.withColumn("x1", x1).withColumn("f1", f1).withColumn("crosses", F.col("ok") & F.coalesce(ok1, F.lit(False)) & ((F.col("f") < 0) != (f1 < 0)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f") / (F.col("f") - F.col("f1"))))
    s = s.withColumn("c", F.when(F.col("crosses"), F.struct("pos", (F.col("x") + share * (F.col("x1") - F.col("x"))).alias("at"), (F.col("f") >= 0).alias("entry"))))
    s = s.withColumn("n", F.first("c", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    begins = F.col("c.entry") & ~F.col("n.entry")
    band = F.struct(F.col("c.at").alias("a"), F.col("n.at").alias("b"), F.col("n.pos").alias("last"), ((F.col("c.at") + F.col("n.at")) / 2).alias("center"), F.col("dot").alias("dot"))
    s = s.withColumn("band", F.when(begins, band))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("k", F.count("band").over(before)).withColumn("o", F.last("band", True).over(before))
    inside = F.col("pos") <= F.col("o.last")
    early = F.col("x") <= F.col("o.center")
    g = s.groupBy(ray, "k").agg(
        F.first("o").alias("o"),
        F.min(F.when(inside, F.col("f"))).alias("depth"),
        F.max(F.when(~F.coalesce(inside, F.lit(False)) & F.col("ok"), F.col("f"))).alias("gap"),
        F.coalesce(F.bool_or(inside & ~F.col("ok")), F.lit(False)).alias("holed"),
        F.coalesce(F.bool_or(early & ~F.col("ok")), F.lit(False)).alias("bad_here"),
        F.coalesce(F.bool_or(~F.coalesce(early, F.lit(False)) & ~F.col("ok")), F.lit(False)).alias("bad_after"),
        F.max_by(F.struct("dot"), F.when(early & inside, F.col("pos"))).alias("last_dot"),
    )
    # Where no sample lies between a band's begin and its centre, the one before its begin tells.
    g = g.withColumn("dot", F.when(F.col("last_dot").isNull(), F.col("o.dot")).otherwise(F.col("last_dot.dot")))
    w = over(ray, "k")
    back = lambda c, none: F.coalesce(F.lag(c).over(w), F.lit(none))
    g = g.withColumn("unsupported", F.col("bad_here") | back("bad_after", False)).withColumn("clearance", F.when(F.col("k") > 1, F.lag("gap").over(w))).where("k > 0")
    near = (F.lead("o.center").over(w) - F.col("o.center")) * F.least(F.coalesce("dot", F.lit(0.0)), F.coalesce(F.lead("dot").over(w), F.lit(0.0))) < least_gap
    doubt = F.lead("unsupported").over(w) | F.col("holed") | F.lead("holed").over(w) | F.col("dot").isNull() | F.lead("dot").over(w).isNull()
    g = g.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("split", F.col("near") & F.coalesce(doubt, F.lit(False))).withColumn("m", F.col("near") & ~F.col("split"))
    g = g.withColumn("overlap", F.col("m") & back("m", False)).withColumn("merge", F.col("m") & ~back("m", False))
    g = g.withColumn("ambiguous", F.col("holed") | F.col("split") | F.col("overlap") | back("split", False) | back("overlap", False))
    next_ = lambda c: F.lead(c).over(w)
    g = g.withColumn("end", F.when(F.col("merge"), next_("o.b")).otherwise(F.col("o.b"))).withColumn("depth2", F.when(F.col("merge"), F.least("depth", next_("depth"))).otherwise(F.col("depth")))
    g = g.withColumn("dot2", F.when(F.col("merge"), F.least("dot", next_("dot"))).otherwise(F.col("dot"))).withColumn("gone", back("merge", False)).where("not gone")
    graze = F.coalesce((F.col("dot2") < graze_dot) & (F.col("depth2") > -graze_depth), F.lit(False))
    return g.select(
        ray, (F.row_number().over(w) - 1).cast("long").alias("ordinal"), ((F.col("o.a") + F.col("end")) / 2).alias("center"), (F.col("end") - F.col("o.a")).alias("width"), F.col("depth2").alias("depth"),
        F.col("clearance").alias("clearance_before"), "ambiguous", graze.alias("graze"), F.col("merge").alias("merged"), F.col("holed").alias("interior_invalid"), F.col("unsupported").alias("unsupported_before"),
    )


def padded(df: DataFrame, key: str, order, values: list[str], width: int | None = None, fill: float = 0.0) -> DataFrame:
    """key, n, valid and one array of each value, in order, all ``width`` long (default: as long as the longest sequence).

    What a sequence lacks is ``fill``, and false in ``valid``; what it has beyond ``width`` is left out, and counted in n.
    """
    orders = [order] if isinstance(order, str) else list(order)
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*orders, *[F.col(v).alias(f"__{v}") for v in values]))).alias("__a"))
    if width is None:
        width = g.agg(F.coalesce(F.max(F.size("__a")), F.lit(0))).first()[0]
    n = F.size("__a")
    pad = lambda a, x: F.slice(F.concat(a, F.array_repeat(x, F.greatest(F.lit(width) - n, F.lit(0)))), 1, width) if width else a
    of = lambda v: F.transform("__a", lambda r: r[f"__{v}"].cast("double"))
    cols = [pad(of(v), F.lit(fill)).alias(v) for v in values]
    return g.select(key, n.cast("long").alias("n"), pad(F.transform("__a", lambda r: F.lit(True)), F.lit(False)).alias("valid"), *cols)
