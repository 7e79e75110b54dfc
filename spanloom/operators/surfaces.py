"""Surfaces as grids of vertices in space: triangles, nearest points, landings, samples of volumes, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import neighbours

_AXES = "zyx"
#: Keeps the ratios of flat triangles finite.
_TINY = "1e-8D"


def _corners(vertices: DataFrame, keys: list[str], i: str, j: str, coords: list[str]) -> DataFrame:
    """keys, i, j and c<di><dj>_<axis>: the squares whose four corners have coordinates. One partial aggregate."""
    some = vertices.where(" and ".join(f"{c} is not null" for c in coords))
    role = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)]))
    d = some.select(*keys, i, j, *[F.col(c).cast("double").alias(a) for a, c in zip(_AXES, coords, strict=True)], role.alias("__m"))
    d = d.withColumn(i, F.col(i) - F.col("__m.di")).withColumn(j, F.col(j) - F.col("__m.dj"))
    here = lambda a, b: (F.col("__m.di") == a) & (F.col("__m.dj") == b)
    parts = [F.max(F.when(here(a, b), F.col(x))).alias(f"c{a}{b}_{x}") for a in (0, 1) for b in (0, 1) for x in _AXES]
    q = d.groupBy(*keys, i, j).agg(*parts)
    return q.where(" and ".join(f"c{a}{b}_z is not null" for a in (0, 1) for b in (0, 1)))


def triangles(vertices: DataFrame, keys: list[str], i: str, j: str, coords: list[str]) -> DataFrame:
    """keys, i, j, kind, and corners a, b, c (``a_z`` ...): the two triangles of each square of vertices.

    Kind 0 has the corners (1, 0), (0, 0), (0, 1) of its square, kind 1 the corners (1, 0), (0, 1), (1, 1). Coordinates are
    given in the order z, y, x; a vertex that repeats counts with its largest coordinates.
    """
    q = _corners(vertices, keys, i, j, coords)
    pick = lambda s, c: [F.col(f"c{c}_{x}").alias(f"{s}_{x}") for x in _AXES]
    face = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), *pick("a", a), *pick("b", b), *pick("c", c))
    return q.select(*keys, i, j, F.explode(F.array(face(0, "10", "00", "01"), face(1, "10", "01", "11"))).alias("f")).select(*keys, i, j, "f.*")


def square_centres(vertices: DataFrame, keys: list[str], i: str, j: str, coords: list[str]) -> DataFrame:
    """keys, i, j, z, y, x: the means of each square's corners."""
    q = _corners(vertices, keys, i, j, coords)
    return q.select(*keys, i, j, *[((F.col(f"c00_{x}") + F.col(f"c01_{x}") + F.col(f"c10_{x}") + F.col(f"c11_{x}")) / 4).alias(x) for x in _AXES])


def closest_sql() -> list[tuple[str, dict[str, str]]]:
    """Steps of SQL expressions, each over the columns before it, from p_*, a_*, b_*, c_* to the closest point of the triangle.

    The point is a + v (b - a) + w (c - a); the cases are those of the region of the plane that the point lies over: a
    corner, an edge or the face. The same text is valid in other engines.
    """
    e = lambda f: " + ".join(f.format(x) for x in _AXES)
    dots = {
        "d1": e("(p_{0} - a_{0}) * (b_{0} - a_{0})"), "d2": e("(p_{0} - a_{0}) * (c_{0} - a_{0})"),
        "d3": e("(p_{0} - b_{0}) * (b_{0} - a_{0})"), "d4": e("(p_{0} - b_{0}) * (c_{0} - a_{0})"),
        "d5": e("(p_{0} - c_{0}) * (b_{0} - a_{0})"), "d6": e("(p_{0} - c_{0}) * (c_{0} - a_{0})"),
    }
    dots = {k: v.replace("{0}", "") for k, v in dots.items()}
    areas = {"va": "d3 * d6 - d5 * d4", "vb": "d5 * d2 - d1 * d6", "vc": "d1 * d4 - d3 * d2"}
    tiny = _TINY.rstrip("D")
    cases = (
        ("d1 <= 0 AND d2 <= 0", "0.0", "0.0"),
        ("d3 >= 0 AND d4 <= d3", "1.0", "0.0"),
        ("vc <= 0 AND d1 >= 0 AND d3 <= 0", f"d1 / (d1 - d3 + {tiny})", "0.0"),
        ("d6 >= 0 AND d5 <= d6", "0.0", "1.0"),
        ("vb <= 0 AND d2 >= 0 AND d6 <= 0", "0.0", f"d2 / (d2 - d6 + {tiny})"),
        ("va <= 0 AND d4 >= d3 AND d5 >= d6", f"1.0 - (d4 - d3) / ((d4 - d3) + (d5 - d6) + {tiny})", f"(d4 - d3) / ((d4 - d3) + (d5 - d6) + {tiny})"),
    )
    last = (f"vb / (va + vb + vc + {tiny})", f"vc / (va + vb + vc + {tiny})")
    case = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN CAST({c[k + 1]} AS DOUBLE)" for c in cases) + f" ELSE {last[k]} END"
    far = " + ".join(f"(a_{x} + v * (b_{x} - a_{x}) + w * (c_{x} - a_{x}) - p_{x}) * (a_{x} + v * (b_{x} - a_{x}) + w * (c_{x} - a_{x}) - p_{x})" for x in _AXES)
    place = {"at_i": "CASE WHEN kind = 0 THEN i + (1.0 - v - w) ELSE i + (1.0 - v - w) + w END", "at_j": "CASE WHEN kind = 0 THEN j + w ELSE j + v + w END"}
    return [("dots", dots), ("areas", areas), ("weights", {"v": case(0), "w": case(1)}), ("distance", {"d": f"sqrt({far})", **place})]


def nearest_on_surfaces(points: DataFrame, ident: list[str], faces: DataFrame, radius: float, keys: list[str] | None = None, surface: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """ident, surface, at_i, at_j, distance: for each point (z, y, x) the nearest place within ``radius`` of the surfaces.

    ``keys``: columns that point and face must share; ``surface``: the faces' own columns to keep. Faces are dealt to the
    cells of side ``cell`` that their boxes, widened by the radius, touch, points to their own: only equal cells meet, and
    a face is missed by no point within the radius. Ties go to the first face by kind, then place. Points with none are
    left out. Faces much larger than a cell are dealt to many: choose ``cell`` by the larger of radius and faces.
    """
    keys, surface, side = keys or [], surface or [], cell or 2 * radius
    f, p = faces, points.select(*ident, *keys, *[F.col(x).cast("double").alias(f"p_{x}") for x in _AXES])
    for x in _AXES:
        lo, hi = F.least(f"a_{x}", f"b_{x}", f"c_{x}") - radius, F.greatest(f"a_{x}", f"b_{x}", f"c_{x}") + radius
        f = f.withColumn(f"__{x}", F.explode(F.sequence(F.floor(lo / side), F.floor(hi / side))))
        p = p.withColumn(f"__{x}", F.floor(F.col(f"p_{x}") / side))
    m = p.join(f, [*keys, *[f"__{x}" for x in _AXES]])
    for _, step in closest_sql():
        m = m.select("*", *[F.expr(text).alias(name) for name, text in step.items()])
    near = F.round("d", 9)
    best = F.min_by(F.struct(*surface, "at_i", "at_j", near.alias("distance")), F.struct(near, *surface, "kind", "i", "j")).alias("r")
    # Held against the radius only here: a filter on d itself would be moved below the steps, each then held again and again.
    return m.groupBy(*ident, *keys).agg(best).select(*ident, *keys, "r.*").where(F.col("distance") <= radius)


def landings(vertices: DataFrame, surface: str, i: str, j: str, coords: list[str], pairs: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """a, i, j, b, to_i, to_j, distance: for each pair (a, b) of surfaces, the squares of a whose centres land on one of b's."""
    centres = square_centres(vertices, [surface], i, j, coords).withColumnRenamed(surface, "a").join(pairs, "a")
    faces = triangles(vertices, [surface], i, j, coords).select(F.col(surface).alias("b"), F.col(i).alias("i"), F.col(j).alias("j"), "kind", *[f"{s}_{x}" for s in "abc" for x in _AXES])
    n = nearest_on_surfaces(centres.select("a", "b", F.col(i).alias("from_i"), F.col(j).alias("from_j"), *_AXES), ["a", "from_i", "from_j"], faces, radius, keys=["b"], cell=cell)
    n = n.withColumn("to_i", F.floor("at_i")).withColumn("to_j", F.floor("at_j"))
    there = faces.select("b", F.col("i").alias("to_i"), F.col("j").alias("to_j")).distinct()
    return n.join(there, ["b", "to_i", "to_j"], "left_semi").select("a", F.col("from_i").alias("i"), F.col("from_j").alias("j"), "b", "to_i", "to_j", "distance")


def trilinear(points: DataFrame, voxels: DataFrame, value: str, least_mass: float = 0.5) -> DataFrame:
    """``points`` (z, y, x in voxels) with ``value`` between the eight voxels around and ``valid``.

    Voxels that are absent or 0 hold no data: weights are those of the others, scaled to one; a point is valid if they were
    ``least_mass`` before. A point without any has no value.
    """
    own = points.columns
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    p = points.withColumn("__c", corner)
    part = lambda x: F.when(F.col(f"__c.{x}") == 1, F.col(x) - F.floor(x)).otherwise(1.0 - (F.col(x) - F.floor(x)))
    p = p.withColumn("__w", part("z") * part("y") * part("x")).where("__w > 0")
    p = p.select("*", *[(F.floor(x) + F.col(f"__c.{x}")).cast("long").alias(f"__{x}") for x in _AXES])
    v = voxels.where(F.col(value) != 0).select(*[F.col(x).cast("long").alias(f"__{x}") for x in _AXES], F.col(value).cast("double").alias("__v"))
    m = p.join(v, [f"__{x}" for x in _AXES], "left").withColumn("__w", F.when(F.col("__v").isNotNull(), F.col("__w")).otherwise(0.0))
    mass = F.sum("__w")
    out = m.groupBy(*own).agg(mass.alias("__mass"), F.sum(F.col("__w") * F.col("__v")).alias("__sum"))
    return out.select(*own, F.when(F.col("__mass") > 0, F.col("__sum") / F.col("__mass")).alias(value), (F.round("__mass", 9) >= least_mass).alias("valid"))


def nearest_voxel(points: DataFrame, voxels: DataFrame, values: list[str]) -> DataFrame:
    """``points`` with the values of the nearest voxel, places rounded half to even; null where there is none."""
    at = [F.rint(x).cast("long").alias(f"__{x}") for x in _AXES]
    v = voxels.select(*[F.col(x).cast("long").alias(f"__{x}") for x in _AXES], *values)
    return points.select("*", *at).join(v, [f"__{x}" for x in _AXES], "left").drop(*[f"__{x}" for x in _AXES])


def holes(cells: DataFrame, key: list[str], i: str, j: str) -> DataFrame:
    """key, components, holes: of each key's cells (joined by sides and corners), stretches of other cells that no walk by
    sides from outside reaches.

    Holes are components less the Euler number, which is a sum over the 2 x 2 windows of the grid: a quarter of the windows
    with one cell, less those with three, less twice those with two at opposite corners. Nothing is flooded.
    """
    from . import graph

    c = cells.select(*key, F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).distinct()
    bit = lambda a, b: F.lit(1 << (2 * a + b))
    votes = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), bit(a, b).alias("bit")) for a in (0, 1) for b in (0, 1)]))
    w = c.withColumn("m", votes).groupBy(*key, (F.col("i") - F.col("m.a")).alias("i"), (F.col("j") - F.col("m.b")).alias("j")).agg(F.sum("m.bit").alias("bits"))
    four = F.when(F.bit_count("bits") == 1, 1).when(F.bit_count("bits") == 3, -1).when(F.col("bits").isin(6, 9), -2).otherwise(0)
    euler = w.groupBy(*key).agg((F.sum(four) / 4).cast("long").alias("euler"))
    node = F.struct(*key, "i", "j")
    here = c.select(node.alias("a"))
    near = neighbours(c.withColumn("from", node), ["i", "j"], 1).select("from", node.alias("a")).where("from < a")
    comp = graph.components(near.join(here, "a").select("a", F.col("from").alias("b")))
    roots = here.join(comp, here["a"] == comp["node"], "left").select(F.coalesce("root", "a").alias("r")).distinct()
    count = roots.groupBy(*[F.col(f"r.{k}").alias(k) for k in key]).agg(F.count("*").alias("components"))
    return count.join(euler, key).select(*key, "components", (F.col("components") - F.col("euler")).alias("holes"))
