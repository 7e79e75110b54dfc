"""Ordered sequences: events of a user in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import joins, ragged
from .registry import query

_SEC = "epoch(ts)"


def _events(t):
    return t("events").select("event_id", "ts", "user_id", "event_type", "value", expr.seconds("ts").alias("sec"))


@query("A01 A03 C01 G01 A27", "SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1 HAVING min(l_shipdate) >= TIMESTAMP '1995-01-01' AND max(l_shipdate) < TIMESTAMP '1997-01-01'")
def min_max_containment(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    return g.where("first_ship >= timestamp '1995-01-01' and last_ship < timestamp '1997-01-01'")


@query("C02 C14", "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1 HAVING bool_or(l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01')")
def any_intersects(t):
    inside = (F.col("l_shipdate") >= F.lit("1996-03-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1996-04-01").cast("timestamp"))
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.bool_or(inside).alias("hit")).where("hit").drop("hit")


@query(
    "C03 C04 C05 C10",
    """WITH b AS (SELECT user_id, event_id, value FROM events WHERE value BETWEEN 20 AND 60 AND event_type <> 'error')
SELECT user_id, count(*) AS points, round(min(value), 6) AS low, round(max(value), 6) AS high FROM b GROUP BY 1 HAVING count(*) >= 2""",
)
def box_points(t):
    inside = t("events").where("value between 20 and 60 and event_type != 'error'")
    return inside.groupBy("user_id").agg(F.count("*").alias("points"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")).where("points >= 2")


@query(
    "G02 G03 C06 C08 W05",
    f"""WITH s AS (SELECT user_id, value, {_SEC} / 3600 AS h, lag(value) OVER w AS pv, lag({_SEC} / 3600) OVER w AS ph, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(*) AS points, coalesce(sum(sqrt((h - ph) ** 2 + (value - pv) ** 2)), 0) AS arc, max(CASE WHEN rn = 1 THEN h END) AS h0, max(CASE WHEN rn = 1 THEN value END) AS v0, max(CASE WHEN rn = n THEN h END) AS h1, max(CASE WHEN rn = n THEN value END) AS v1 FROM s GROUP BY 1)
SELECT user_id, points, round(arc, 4) AS arclength, round(sqrt((h1 - h0) ** 2 + (v1 - v0) ** 2), 4) AS chord, round(arc / sqrt((h1 - h0) ** 2 + (v1 - v0) ** 2), 4) AS tortuosity FROM g WHERE points >= 2""",
)
def polyline_arclength_tortuosity(t):
    e = _events(t).withColumn("h", F.col("sec") / 3600)
    a = ragged.arclength_tortuosity(e, "user_id", ["ts", "event_id"], ["h", "value"]).where("points >= 2")
    return a.select("user_id", "points", *[F.round(c, 4).alias(c) for c in ("arclength", "chord", "tortuosity")])


@query(
    "W01 W02 W03 W26 F01",
    """WITH a AS (SELECT event_id, user_id, ts, value, value - floor(value / (2 * pi())) * 2 * pi() AS th FROM events),
d AS (SELECT *, th - lag(th) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM a)
SELECT event_id, round(value + sum(CASE WHEN j > pi() THEN 10.0 WHEN j < -pi() THEN -10.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM d""",
)
def theta_unwrap_running(t):
    e = _events(t).withColumn("th", expr.wrap("value"))
    return ragged.unwrapped(e, "user_id", ["ts", "event_id"], "th", "value", 10.0).select("event_id", F.round("unwrapped", 6).alias("unwrapped"))


@query(
    "W04 F12 F15 M15",
    """SELECT event_id, round(greatest(0, value - (user_id % 6) / (2 * pi()) * 10), 6) AS shifted,
  round(least(abs(value % 6.25 - user_id % 6), 2 * pi() - abs(value % 6.25 - user_id % 6)), 6) AS gap FROM events WHERE value >= 0""",
)
def shifted_radii(t):
    e = t("events").where("value >= 0")
    angle = (F.col("user_id") % 6).cast("double")
    return e.select("event_id", F.round(expr.shifted_radius("value", angle, 10.0), 6).alias("shifted"), F.round(expr.circular_distance(F.col("value") % 6.25, angle), 6).alias("gap"))


_RUNS = """p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value > 20 AS keep FROM events),
r AS (SELECT user_id, pos, pos - sum(keep::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, keep FROM p),
i AS (SELECT user_id, min(pos) AS s, max(pos) AS e, count(*) AS n FROM r WHERE keep GROUP BY user_id, run)"""


@query("W06 W08", f'WITH {_RUNS} SELECT user_id, s AS start, e AS "end", n AS length, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM i')
def islands_with_running_length(t):
    i = ragged.islands(_events(t), "user_id", ["ts", "event_id"], F.col("value") > 20)
    so_far = F.sum("length").over(ragged.running(ragged.over("user_id", "start")))
    return i.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "length", so_far.alias("so_far"))


@query("W07", f'WITH {_RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS rn FROM i WHERE n >= 2) SELECT user_id, s AS start, e AS "end", n AS length FROM b WHERE rn = 1')
def islands_longest_run(t):
    r = ragged.longest_run(_events(t), "user_id", ["ts", "event_id"], F.col("value") > 20)
    return r.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "length")


@query(
    "W09",
    f"""WITH {_RUNS} SELECT a.user_id AS row_a, a.s AS a_start, b.s AS b_start, CAST(least(a.e, b.e) - greatest(a.s, b.s) + 1 AS BIGINT) AS overlap
FROM i a JOIN i b ON b.user_id = a.user_id + 1 AND a.s <= b.e AND b.s <= a.e""",
)
def row_run_overlaps(t):
    i = ragged.islands(_events(t), "user_id", ["ts", "event_id"], F.col("value") > 20)
    a = i.select(F.col("user_id").alias("row_a"), F.col("start").cast("long").alias("a_start"), F.col("end").alias("a_end"), (F.col("user_id") + 1).alias("row_b"))
    b = i.select(F.col("user_id").alias("row_b"), F.col("start").cast("long").alias("b_start"), F.col("end").alias("b_end"))
    j = a.join(b, "row_b").where("a_start <= b_end and b_start <= a_end")
    return j.select("row_a", "a_start", "b_start", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1).cast("long").alias("overlap"))


@query(
    "W10 T02",
    f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN {_SEC} - lag({_SEC}) OVER w > 7200 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM c GROUP BY 1, 2""",
)
def cluster_by_gap(t):
    e = t("events").withColumn("sec", expr.seconds("ts"))
    c = ragged.gap_clusters(e, "user_id", ["ts", "event_id"], ["sec"], 7200)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    "J15 M13 W18 F22 G37",
    f"""WITH k AS (SELECT user_id, floor({_SEC} / 86400) AS x, avg(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
p AS (SELECT event_id, user_id, {_SEC} / 86400 AS x FROM events WHERE event_id % 3 = 1),
b AS (SELECT p.event_id, p.x, (SELECT max(k.x) FROM k WHERE k.user_id = p.user_id AND k.x <= p.x) AS x0, (SELECT min(k.x) FROM k WHERE k.user_id = p.user_id AND k.x >= p.x) AS x1, p.user_id FROM p)
SELECT event_id, round(CASE WHEN x1 > x0 THEN a.v + (b.x - x0) / (x1 - x0) * (c.v - a.v) WHEN x1 = x0 THEN a.v END, 5) AS v
FROM b LEFT JOIN k a ON a.user_id = b.user_id AND a.x = b.x0 LEFT JOIN k c ON c.user_id = b.user_id AND c.x = b.x1""",
)
def bracket_interpolate(t):
    e = t("events").withColumn("x", expr.seconds("ts") / 86400)
    knots = e.where("event_id % 3 = 0").select("user_id", F.floor("x").cast("double").alias("kx"), F.col("value").alias("v"))
    out = joins.bracketed(e.where("event_id % 3 = 1").select("event_id", "user_id", "x"), knots, "user_id", "x", "kx", "v")
    return out.select("event_id", F.round(F.when(F.col("v").isNotNull(), F.col("v")), 5).alias("v"))


@query(
    "W18 W17 W16 S20",
    f"""WITH k AS (SELECT user_id, floor({_SEC} / 86400) AS x, avg(value) AS v FROM events GROUP BY 1, 2),
b AS (SELECT *, lead(x) OVER w AS x1, lead(v) OVER w AS v1, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x)),
g AS (SELECT *, unnest(generate_series(0, 8)) AS i FROM b),
q AS (SELECT *, lo + (hi - lo) * i / 8.0 AS a FROM g)
SELECT user_id, round(a, 6) AS a, round(CASE WHEN x1 IS NULL THEN v ELSE v + (a - x) / (x1 - x) * (v1 - v) END, 8) AS v FROM q WHERE a >= x AND (a < x1 OR x1 IS NULL AND a = x)""",
)
def resample_levels(t):
    e = t("events").select("user_id", F.floor(expr.seconds("ts") / 86400).cast("double").alias("x"), F.col("value").alias("v"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 8.0)
    r = ragged.linear_resample(e, "user_id", "x", "v", grid)
    return r.select("user_id", F.round("at", 6).alias("a"), F.round("v", 8).alias("v"))


@query(
    "W25 F03",
    """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS segment, value AS y, lag(value) OVER w AS py, CAST(event_id % 50 AS DOUBLE) AS x, lag(CAST(event_id % 50 AS DOUBLE)) OVER w AS px FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CASE WHEN py IS NULL THEN 0 ELSE CAST(ceil(greatest(abs(y - py), abs(x - px))) AS INT) END AS n FROM s),
k AS (SELECT *, unnest(CASE WHEN py IS NULL THEN [0] ELSE generate_series(1, n) END) AS step FROM n)
SELECT user_id, segment, CAST(step AS BIGINT) AS step, CAST(round_even(CASE WHEN step = 0 THEN y ELSE py + (y - py) * step / n END, 0) AS BIGINT) AS y, CAST(round_even(CASE WHEN step = 0 THEN x ELSE px + (x - px) * step / n END, 0) AS BIGINT) AS x FROM k""",
)
def rasterize_steps(t):
    e = t("events").select("user_id", "ts", "event_id", F.col("value").alias("y"), (F.col("event_id") % 50).cast("double").alias("x"))
    return ragged.rasterized(e, "user_id", ["ts", "event_id"], ["y", "x"])


@query(
    "J21 J22",
    """WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS d FROM events),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a < b THEN d ELSE -d END AS d FROM s WHERE a <> b)
SELECT a, b, count(*) AS n, round(sum(d), 4) AS delta FROM e GROUP BY 1, 2""",
)
def consecutive_pair_edges(t):
    w = ragged.over("user_id", ["ts", "event_id"])
    s = t("events").select(F.col("event_type").alias("p"), F.lead("event_type").over(w).alias("q"), (F.lead("value").over(w) - F.col("value")).alias("d")).where("p != q")
    e = s.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("d")).otherwise(-F.col("d")).alias("d"))
    return e.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("delta"))


@query(
    "G26 W20",
    f"""WITH s AS (SELECT user_id, {_SEC} AS x, value - 30 AS v, lag({_SEC}) OVER w AS px, lag(value - 30) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (pv < 0 AND v >= 0) AS entries, count(*) FILTER (pv >= 0 AND v < 0) AS exits, round(sum(abs((v >= 0)::INT - (pv >= 0)::INT)) / 2, 4) AS crossings,
  round(min(CASE WHEN (pv < 0) <> (v < 0) THEN px + (x - px) * pv / (pv - v) END), 3) AS first_zero FROM s GROUP BY 1""",
)
def zero_crossings(t):
    w = ragged.over("user_id", ["ts", "event_id"])
    s = t("events").select("user_id", (expr.seconds("ts")).alias("x"), (F.col("value") - 30).alias("v"), F.lag(expr.seconds("ts")).over(w).alias("px"), F.lag(F.col("value") - 30).over(w).alias("pv"))
    inside, before = (F.col("v") >= 0).cast("int"), (F.col("pv") >= 0).cast("int")
    zero = F.when((F.col("pv") < 0) != (F.col("v") < 0), F.col("px") + (F.col("x") - F.col("px")) * F.col("pv") / (F.col("pv") - F.col("v")))
    return s.groupBy("user_id").agg(F.count(F.when(F.expr("pv < 0 and v >= 0"), 1)).alias("entries"), F.count(F.when(F.expr("pv >= 0 and v < 0"), 1)).alias("exits"), F.round(F.sum(F.abs(inside - before)) / 2, 4).alias("crossings"), F.round(F.min(zero), 3).alias("first_zero"))


@query(
    "W15",
    f"""WITH RECURSIVE p AS (SELECT user_id, {_SEC} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT user_id, x, rn FROM p WHERE rn = 1 UNION ALL SELECT n.user_id, n.x, n.rn FROM k, LATERAL (SELECT p.user_id, p.x, p.rn FROM p WHERE p.user_id = k.user_id AND p.rn > k.rn AND p.x - k.x >= 86400 ORDER BY p.rn LIMIT 1) n)
SELECT user_id, count(*) AS kept, round(sum(x), 2) AS total FROM k GROUP BY 1""",
)
def min_spacing_decimation(t):
    e = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((expr.seconds("ts")).alias("x"), "event_id"))).alias("pts"))
    e = e.withColumn("kept", ragged.spaced(F.transform("pts", lambda p: p["x"]), lambda a, b: b - a, 86400.0))
    return e.select("user_id", F.size("kept").cast("long").alias("kept"), F.round(F.aggregate("kept", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query(
    "W16 W27",
    f"""WITH a AS (SELECT user_id, {_SEC} / 3600 AS x, lead({_SEC} / 3600) OVER (PARTITION BY user_id ORDER BY ts, event_id) - {_SEC} / 3600 AS gap FROM events WHERE event_type = 'purchase')
SELECT user_id, CAST(sum(greatest(ceil(gap / 24), 1)) AS BIGINT) AS intervals, round(max(gap / greatest(ceil(gap / 24), 1)), 5) AS longest FROM a WHERE gap > 0 GROUP BY 1""",
)
def anchored_resample_counts(t):
    e = t("events").where("event_type = 'purchase'").select("user_id", (expr.seconds("ts") / 3600).alias("x"))
    c = ragged.anchored_counts(e, "user_id", "x", 24.0)
    return c.groupBy("user_id").agg(F.sum("intervals").alias("intervals"), F.round(F.max(F.col("gap") / F.col("intervals")), 5).alias("longest"))


@query(
    "W19",
    """WITH s AS (SELECT user_id, event_id, value AS v, lag(value) OVER w AS a, lead(value) OVER w AS c, lead(value, 2) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e AS (SELECT user_id, event_id, v, coalesce(a, 2 * v - c) AS a, c, coalesce(d, 2 * c - v) AS d, unnest([0, 1, 2, 3]) AS k FROM s WHERE c IS NOT NULL)
SELECT user_id, event_id, k, round(0.5 * (2 * v + (c - a) * (k / 4.0) + (2 * a - 5 * v + 4 * c - d) * (k / 4.0) ** 2 + (3 * v - a - 3 * c + d) * (k / 4.0) ** 3), 10) AS value FROM e""",
)
def catmull_rom_spline(t):
    c = ragged.catmull_rom(t("events"), "user_id", "event_id", "value", 4)
    return c.select("user_id", "event_id", "k", F.round("value", 10).alias("value"))


@query(
    "W14 F10",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, avg(l_quantity) AS y, avg(l_discount * 100) AS x FROM lineitem GROUP BY 1, 2),
e AS (SELECT k, min(i) AS lo, max(i) AS hi FROM p GROUP BY 1),
f AS (SELECT p.k, p.i, coalesce((SELECT max(q.i) FROM p q WHERE q.k = p.k AND q.i < p.i AND sqrt((q.y - p.y) ** 2 + (q.x - p.x) ** 2) >= 12), e.lo) AS l,
  coalesce((SELECT min(q.i) FROM p q WHERE q.k = p.k AND q.i > p.i AND sqrt((q.y - p.y) ** 2 + (q.x - p.x) ** 2) >= 12), e.hi) AS r FROM p JOIN e ON p.k = e.k),
g AS (SELECT f.k, f.i, b.y - a.y AS dy, b.x - a.x AS dx FROM f JOIN p a ON a.k = f.k AND a.i = f.l JOIN p b ON b.k = f.k AND b.i = f.r)
SELECT k, i, round(CASE WHEN dy <> 0 OR dx <> 0 THEN dy / sqrt(dy * dy + dx * dx) END, 5) AS t_y, round(CASE WHEN dy <> 0 OR dx <> 0 THEN dx / sqrt(dy * dy + dx * dx) END, 5) AS t_x FROM g""",
)
def vertex_tangents(t):
    p = t("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.avg("l_quantity").alias("y"), F.avg(F.col("l_discount") * 100).alias("x"))
    out = ragged.tangents(p, "k", "i", ["y", "x"], 12.0)
    return out.select("k", "i", F.round("t_y", 5).alias("t_y"), F.round("t_x", 5).alias("t_x"))


@query(
    "W21 W20",
    f"""WITH s AS (SELECT user_id, row_number() OVER w AS pos, {_SEC} / 3600 AS x, value - 35 AS f, event_type <> 'error' OR event_id % 3 > 0 AS ok, CASE WHEN event_id % 17 > 0 THEN (event_id % 10 + 1) / 10 END AS dot FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, lead(x) OVER w AS x1, lead(f) OVER w AS f1, ok AND coalesce(lead(ok) OVER w, false) AND (f < 0) <> (lead(f) OVER w < 0) AS crosses FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT *, CASE WHEN crosses THEN x + greatest(0, least(1, f / (f - f1))) * (x1 - x) END AS cx, CASE WHEN crosses THEN f >= 0 END AS entry, CASE WHEN crosses THEN pos END AS cpos FROM l),
n AS (SELECT *, first_value(cx IGNORE NULLS) OVER w AS nat, first_value(entry IGNORE NULLS) OVER w AS nentry, first_value(cpos IGNORE NULLS) OVER w AS npos FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, CASE WHEN entry AND NOT nentry THEN struct_pack(a := cx, b := nat, last := npos, center := (cx + nat) / 2, dot := dot) END AS band FROM n),
k AS (SELECT *, count(band) OVER w AS k, last_value(band IGNORE NULLS) OVER w AS o FROM b WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT user_id, k, any_value(o) AS o, min(f) FILTER (pos <= o.last) AS depth, max(f) FILTER (ok AND NOT coalesce(pos <= o.last, false)) AS gap, coalesce(bool_or(NOT ok) FILTER (pos <= o.last), false) AS holed, coalesce(bool_or(NOT ok) FILTER (x <= o.center), false) AS bad_here,
  coalesce(bool_or(NOT ok) FILTER (NOT coalesce(x <= o.center, false)), false) AS bad_after, max(pos) FILTER (x <= o.center AND pos <= o.last) AS dpos FROM k GROUP BY 1, 2),
d AS (SELECT g.*, CASE WHEN dpos IS NULL THEN o.dot ELSE s.dot END AS dot FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.pos = dpos),
u AS (SELECT *, bad_here OR coalesce(lag(bad_after) OVER w, false) AS unsupported, CASE WHEN k > 1 THEN lag(gap) OVER w END AS clearance FROM d WINDOW w AS (PARTITION BY user_id ORDER BY k)),
p AS (SELECT *, coalesce((lead(o.center) OVER w - o.center) * least(coalesce(dot, 0), coalesce(lead(dot) OVER w, 0)) < 20, false) AS near, coalesce(lead(unsupported) OVER w OR holed OR lead(holed) OVER w OR dot IS NULL OR lead(dot) OVER w IS NULL, false) AS doubt FROM u WHERE k > 0 WINDOW w AS (PARTITION BY user_id ORDER BY k)),
q AS (SELECT *, near AND doubt AS split, near AND NOT doubt AS m FROM p), r AS (SELECT *, m AND coalesce(lag(m) OVER w, false) AS overlap, m AND NOT coalesce(lag(m) OVER w, false) AS merge FROM q WINDOW w AS (PARTITION BY user_id ORDER BY k)),
t AS (SELECT *, holed OR split OR overlap OR coalesce(lag(split) OVER w, false) OR coalesce(lag(overlap) OVER w, false) AS ambiguous, CASE WHEN merge THEN lead(o.b) OVER w ELSE o.b END AS fin, CASE WHEN merge THEN least(depth, lead(depth) OVER w) ELSE depth END AS depth2,
  CASE WHEN merge THEN least(dot, lead(dot) OVER w) ELSE dot END AS dot2, coalesce(lag(merge) OVER w, false) AS gone FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS ordinal, round((o.a + fin) / 2, 5) AS center, round(fin - o.a, 5) AS width, depth2 AS depth, clearance AS clearance_before, ambiguous, coalesce(dot2 < 0.4 AND depth2 > -20, false) AS graze, merge AS merged, holed AS interior_invalid, unsupported AS unsupported_before FROM t WHERE NOT gone""",
)
def complete_bands(t):
    e = t("events").select("user_id", "ts", "event_id", (expr.seconds("ts") / 3600).alias("x"), (F.col("value") - 35).alias("f"), ((F.col("event_type") != "error") | (F.col("event_id") % 3 > 0)).alias("ok"), F.when(F.col("event_id") % 17 > 0, (F.col("event_id") % 10 + 1) / 10).alias("dot"))
    b = ragged.complete_bands(e, "user_id", ["ts", "event_id"], "x", "f", "ok", "dot", 20.0, 0.4, 20.0)
    return b.withColumn("center", F.round("center", 5)).withColumn("width", F.round("width", 5))


@query(
    "W28",
    """WITH g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT max(len(v)) AS width FROM g),
p AS (SELECT user_id, len(v) AS n, list_concat(v, list_transform(generate_series(1, width - len(v)), lambda i: -1.0)) AS v FROM g, m)
SELECT user_id, n, CAST(len(v) AS BIGINT) AS width, v[1] AS first_value, v[len(v)] AS last_value, round(list_sum(v), 6) AS total FROM p""",
)
def padded_rows(t):
    p = ragged.padded(t("events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], ["value"], fill=-1.0)
    return p.select("user_id", "n", F.size("value").cast("long").alias("width"), F.get("value", F.lit(0)).alias("first_value"), F.element_at("value", -1).alias("last_value"), F.round(F.aggregate("value", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
