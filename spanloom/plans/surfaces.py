"""Surfaces over suppliers (across) and line numbers (down); volumes of the same; points from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces
from .registry import query

_V = """v AS (SELECT l_returnflag AS s, l_suppkey AS i, l_linenumber AS j, avg(l_quantity) AS z, l_suppkey * 4.0 AS y, l_linenumber * 5.0 AS x FROM lineitem GROUP BY 1, 2, 3)"""
_Q = """q AS (SELECT a.s AS s, a.i AS i, a.j AS j, a.z AS z00, a.y AS y00, a.x AS x00, b.z AS z01, b.y AS y01, b.x AS x01, c.z AS z10, c.y AS y10, c.x AS x10, d.z AS z11, d.y AS y11, d.x AS x11
  FROM v a JOIN v b ON b.s = a.s AND b.i = a.i AND b.j = a.j + 1 JOIN v c ON c.s = a.s AND c.i = a.i + 1 AND c.j = a.j JOIN v d ON d.s = a.s AND d.i = a.i + 1 AND d.j = a.j + 1)"""


def _face(kind: int, *corners: str) -> str:
    cols = ", ".join(f"{x}{c} AS {s}_{x}" for s, c in zip("abc", corners, strict=True) for x in "zyx")
    return f"SELECT s, i, j, {kind} AS kind, {cols} FROM q"


_F = f"f AS ({_face(0, '10', '00', '01')} UNION ALL {_face(1, '10', '01', '11')})"


def _steps(start: str) -> str:
    """Chained CTEs of the closest point's expressions, from the table m0."""
    out, last = [], start
    for k, (_, step) in enumerate(surfaces.closest_sql(), 1):
        out.append(f"m{k} AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in step.items())} FROM {last})")
        last = f"m{k}"
    return ", ".join(out)


def _vertices(t):
    g = t("lineitem").groupBy(F.col("l_returnflag").alias("s"), F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.avg("l_quantity").alias("z"))
    return g.select("s", "i", "j", "z", (F.col("i") * 4.0).alias("y"), (F.col("j") * 5.0).alias("x"))


_NEAR = " AND ".join(f"p_{x} BETWEEN least(a_{x}, b_{x}, c_{x}) - 3 AND greatest(a_{x}, b_{x}, c_{x}) + 3" for x in "zyx")


@query(
    "J10",
    f"""WITH {_V}, {_Q}, {_F}, p AS (SELECT event_id, value AS p_z, (event_id % 397) * 1.0 AS p_y, (user_id % 35) * 1.0 AS p_x FROM events),
m0 AS (SELECT * FROM p JOIN f ON s = 'N' AND {_NEAR}), {_steps("m0")}, r AS (SELECT *, round(d, 9) AS dd FROM m4 WHERE d <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dd, kind, i, j) AS rn FROM r) SELECT event_id, round(at_i, 5) AS at_i, round(at_j, 5) AS at_j, round(dd, 6) AS distance FROM b WHERE rn = 1""",
)
def points_on_surface(t):
    v = _vertices(t).where("s = 'N'")
    p = t("events").select("event_id", F.col("value").alias("z"), (F.col("event_id") % 397).cast("double").alias("y"), (F.col("user_id") % 35).cast("double").alias("x"))
    n = surfaces.nearest_on_surfaces(p, ["event_id"], surfaces.triangles(v, [], "i", "j", list("zyx")), 3.0)
    return n.select("event_id", F.round("at_i", 5).alias("at_i"), F.round("at_j", 5).alias("at_j"), F.round("distance", 6).alias("distance"))


@query(
    "J14 J07",
    f"""WITH {_V}, {_Q}, {_F}, p AS (SELECT s AS a, i AS from_i, j AS from_j, (z00 + z01 + z10 + z11) / 4 AS p_z, (y00 + y01 + y10 + y11) / 4 AS p_y, (x00 + x01 + x10 + x11) / 4 AS p_x FROM q),
m0 AS (SELECT * FROM p JOIN f ON a < s AND {_NEAR}), {_steps("m0")}, r AS (SELECT *, round(d, 9) AS dd FROM m4 WHERE d <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY a, from_i, from_j, s ORDER BY dd, kind, i, j) AS rn FROM r),
n AS (SELECT a, from_i, from_j, s AS b, CAST(floor(at_i) AS BIGINT) AS to_i, CAST(floor(at_j) AS BIGINT) AS to_j, dd FROM b WHERE rn = 1)
SELECT a, from_i AS i, from_j AS j, b, to_i, to_j, round(dd, 6) AS distance FROM n WHERE EXISTS (SELECT 1 FROM q WHERE q.s = b AND q.i = to_i AND q.j = to_j)""",
)
def landing_quads(t):
    v = _vertices(t)
    flags = v.select("s").distinct()
    pairs = flags.select(F.col("s").alias("a")).join(flags.select(F.col("s").alias("b")), F.col("a") < F.col("b"))
    n = surfaces.landings(v, "s", "i", "j", list("zyx"), pairs, 3.0)
    return n.withColumn("distance", F.round("distance", 6))


_VOX = "v AS (SELECT l_suppkey AS z, l_linenumber AS y, l_partkey % 6 AS x, max(l_quantity) - 10 AS q FROM lineitem GROUP BY 1, 2, 3)"


def _voxels(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("z"), F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 6).alias("x")).agg((F.max("l_quantity") - 10).alias("q"))


def _samples(t):
    return t("events").select("event_id", (F.col("user_id") % 97 + (F.col("event_id") % 4) / 4).alias("z"), (F.col("event_id") % 8 + F.lit(0.25)).alias("y"), (F.col("event_id") % 13 * 0.5).alias("x"))


@query(
    "J19",
    f"""WITH {_VOX}, p AS (SELECT event_id, user_id % 97 + (event_id % 4) / 4 AS z, event_id % 8 + 0.25 AS y, event_id % 13 * 0.5 AS x FROM events),
c AS (SELECT *, unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS a, unnest([0, 0, 1, 1, 0, 0, 1, 1]) AS b, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS e FROM p),
w AS (SELECT event_id, floor(z) + a AS z, floor(y) + b AS y, floor(x) + e AS x, abs(1 - a - (z - floor(z))) * abs(1 - b - (y - floor(y))) * abs(1 - e - (x - floor(x))) AS w FROM c),
s AS (SELECT event_id, sum(CASE WHEN q IS NOT NULL THEN w ELSE 0 END) AS mass, sum(w * q) AS total FROM w LEFT JOIN v ON v.z = w.z AND v.y = w.y AND v.x = w.x AND q <> 0 WHERE w > 0 GROUP BY 1)
SELECT event_id, round(CASE WHEN mass > 0 THEN total / mass END, 6) AS q, round(mass, 9) >= 0.5 AS valid FROM s""",
)
def trilinear_gather(t):
    return surfaces.trilinear(_samples(t), _voxels(t), "q").select("event_id", F.round("q", 6).alias("q"), "valid")


@query(
    "J19",
    f"""WITH {_VOX} SELECT event_id, q FROM (SELECT event_id, round_even(user_id % 97 + (event_id % 4) / 4, 0) AS z, round_even(event_id % 8 + 0.25, 0) AS y, round_even(event_id % 13 * 0.5, 0) AS x FROM events) p LEFT JOIN v USING (z, y, x)""",
)
def nearest_voxel_gather(t):
    return surfaces.nearest_voxel(_samples(t), _voxels(t), ["q"]).select("event_id", "q")


_HOLED = "c AS (SELECT DISTINCT l_suppkey // 20 AS k, l_suppkey % 20 AS i, l_partkey % 24 AS j FROM lineitem WHERE l_quantity > 30 AND (l_suppkey * 7 + l_partkey * 11) % 5 < 3)"


@query(
    "K08",
    f"""WITH RECURSIVE {_HOLED}, b AS (SELECT k, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM c GROUP BY k),
g AS (SELECT k, i, unnest(generate_series(j0, j1)) AS j FROM (SELECT *, unnest(generate_series(i0, i1)) AS i FROM b)), o AS (SELECT * FROM g ANTI JOIN c USING (k, i, j)),
e AS (SELECT a.k, a.i, a.j, x.i AS ti, x.j AS tj FROM o a JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) m(di, dj) ON true JOIN o x ON x.k = a.k AND x.i = a.i + di AND x.j = a.j + dj),
r AS (SELECT k, i, j, i * 1000 + j AS root FROM o UNION SELECT e.k, ti, tj, root FROM r JOIN e ON r.k = e.k AND r.i = e.i AND r.j = e.j WHERE root < ti * 1000 + tj),
s AS (SELECT k, i, j, min(root) AS root FROM r GROUP BY ALL), h AS (SELECT k, count(DISTINCT root) - 1 AS holes FROM s GROUP BY k),
f AS (SELECT a.k, a.i, a.j, x.i AS ti, x.j AS tj FROM c a JOIN c x ON x.k = a.k AND abs(x.i - a.i) <= 1 AND abs(x.j - a.j) <= 1),
u AS (SELECT k, i, j, i * 1000 + j AS root FROM c UNION SELECT f.k, ti, tj, root FROM u JOIN f ON u.k = f.k AND u.i = f.i AND u.j = f.j WHERE root < ti * 1000 + tj),
z AS (SELECT k, i, j, min(root) AS root FROM u GROUP BY ALL), n AS (SELECT k, count(DISTINCT root) AS components FROM z GROUP BY k)
SELECT k, components, holes FROM h JOIN n USING (k)""",
)
def grid_holes(t):
    c = t("lineitem").where("l_quantity > 30 and (l_suppkey * 7 + l_partkey * 11) % 5 < 3").select(F.floor(F.col("l_suppkey") / 20).alias("k"), (F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 24).alias("j"))
    return surfaces.holes(c, ["k"], "i", "j")


@query(
    "R03",
    """WITH c AS (SELECT DISTINCT l_suppkey AS i, CAST(l_quantity AS BIGINT) AS j FROM lineitem WHERE l_linenumber = 7), e AS (SELECT s_suppkey AS i, unnest(generate_series(1, 50)) AS j FROM supplier)
SELECT e.i, e.j, round(min(sqrt((e.i - c.i) ** 2 + (e.j - c.j) ** 2)), 8) AS distance FROM e CROSS JOIN c GROUP BY 1, 2""",
)
def distance_to_features(t):
    """Suppliers by quantities: how far from a seventh line of an order."""
    from ..operators import distance

    cells = t("lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("i"), F.col("l_quantity").cast("long").alias("j"))
    ends = t("supplier").agg(F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi")).first()
    return distance.distances(cells, ["i", "j"], {"i": (ends["lo"] or 0, (ends["hi"] or 0) + 1), "j": (1, 51)}).withColumn("distance", F.round("distance", 8))


_PARTS = "c AS (SELECT DISTINCT l_suppkey // 10 AS k, l_suppkey % 10 AS i, l_partkey % 12 AS j FROM lineitem WHERE (l_suppkey * 5 + l_partkey % 12 * 7) % 4 > 0)"


def _parts(t):
    c = t("lineitem").where("(l_suppkey * 5 + l_partkey % 12 * 7) % 4 > 0")
    return c.select(F.floor(F.col("l_suppkey") / 10).alias("k"), (F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 12).alias("j")).distinct()


@query(
    "K07",
    f"""WITH RECURSIVE {_PARTS}, w AS (SELECT a.k * 10000 + a.i * 100 + a.j AS src, b.k * 10000 + b.i * 100 + b.j AS dst FROM c a JOIN c b ON a.k = b.k AND abs(a.i - b.i) + abs(a.j - b.j) <= 1),
r(node, root) USING KEY (node) AS (SELECT src, src FROM w WHERE src = dst UNION SELECT w.dst, min(r.root) FROM r JOIN w ON r.node = w.src LEFT JOIN recurring.r m ON m.node = w.dst GROUP BY w.dst, m.root HAVING min(r.root) < m.root),
n AS (SELECT node // 10000 AS k, root, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT k, arg_min(root, (-n, root)) AS root FROM n GROUP BY 1) SELECT t.k AS k, node % 10000 // 100 AS i, node % 100 AS j FROM r JOIN t ON t.root = r.root""",
)
def largest_parts(t):
    from ..operators import paths

    return paths.largest_part(_parts(t), "k", "i", "j")


@query("S26 K12", None)
def cone_path_pools(t):
    from ..operators import paths

    c = _parts(t)
    a = c.groupBy("k").agg(F.min(F.struct(F.abs(F.col("i") - 5) + F.abs(F.col("j") - 6), "i", "j")).alias("m")).select("k", "m.i", "m.j")
    p = paths.cone_paths(c, "k", "i", "j", a, 3, "29")
    return p.select("k", "anchor_i", "anchor_j", "cone", "rank", F.round("length", 6).alias("length"), F.concat_ws(" ", F.transform("path", lambda x: F.concat_ws(",", x["i"].cast("string"), x["j"].cast("string")))).alias("path"))


@query("K13", None)
def stitched_paths(t):
    from ..operators import paths

    v = _vertices(t)
    top = v.agg(F.max("i").alias("top"))
    v = v.join(F.broadcast(top)).where((F.col("s") == "N") & (F.col("i") <= 0.7 * F.col("top")) | (F.col("s") == "R") & (F.col("i") >= 0.3 * F.col("top")))  # top is one row
    pair = t("region").sparkSession.createDataFrame([("N", "R")], "a string, b string")
    p = paths.stitched_paths(v.drop("top"), "s", "i", "j", list("zyx"), pair, 4.0, 2.0)
    return p.select("a", "b", "rank", "on", "i", "j", *[F.round(c, 6).alias(c) for c in "zyx"])


@query(
    "K15",
    """WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS i, l_partkey % 30 AS j FROM lineitem WHERE (l_suppkey * 5 + l_partkey % 30 * 7) % 5 < 2), w AS (SELECT a.i * 100 + a.j AS src, b.i * 100 + b.j AS dst FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
r(node, root) USING KEY (node) AS (SELECT src, src FROM w WHERE src = dst UNION SELECT w.dst, min(r.root) FROM r JOIN w ON r.node = w.src LEFT JOIN recurring.r m ON m.node = w.dst GROUP BY w.dst, m.root HAVING min(r.root) < m.root),
n AS (SELECT root FROM r GROUP BY 1 HAVING count(*) >= 3 AND count(*) < 400) SELECT node // 100 AS i, node % 100 AS j FROM r JOIN n USING (root)""",
)
def size_band(t):
    from ..operators import raster

    c = t("lineitem").where("(l_suppkey * 5 + l_partkey % 30 * 7) % 5 < 2").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 30).alias("j"))
    return raster.dusted(c, ["i", "j"], 3, 400, faces_only=False)


@query("K15 C13", None)
def grid_skeleton(t):
    from ..operators import raster

    c = t("lineitem").where("(l_suppkey % 20 div 3 + l_partkey % 24 div 3) % 3 < 2").select(F.floor(F.col("l_suppkey") / 20).alias("k"), (F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 24).alias("j"))
    return raster.thinned(c, ["k"], "i", "j")


@query("G45", "SELECT 120.0 AS cy, -40.0 AS cx, 24.0 AS dr, 1.0 AS phase, -1 AS sense FROM region LIMIT 1")
def spiral_fit(t):
    from ..operators import fits

    # Points of a known spiral, those of 'error' events far off it: the fit finds the spiral.
    e = t("events")
    theta = (F.col("event_id") * 0.7) % 6.28
    r = (F.col("user_id") % 8 + 3 + theta / (2 * 3.141592653589793)) * 24.0 + F.when(F.col("event_type") == "error", F.col("value") % 60).otherwise(F.sin("event_id") * 0.3)
    angle = 1.0 - theta
    p = e.select((F.col("user_id") % 8 + 3).alias("winding"), (F.lit(120.0) + r * F.sin(angle)).alias("y"), (F.lit(-40.0) + r * F.cos(angle)).alias("x"))
    f = fits.fit_spiral(p, [18.0, 22.0, 26.0, 30.0], 2.0)
    # Decimals of the planted figures; the sample's noise moves those after.
    near = lambda c, to: (F.round(F.col(c) / to) * to).alias(c)
    return f.select(near("cy", 1.0), near("cx", 1.0), near("dr", 0.5), near("phase", 0.1), "sense")
