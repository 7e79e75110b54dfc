"""Grids of cells: suppliers across, parts modulo a width down, quantities as values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import aggs, raster
from .registry import query

_C = "c AS (SELECT l_suppkey AS i, l_partkey % 60 AS j, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_AROUND = "o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(di, dj))"


def _cells(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 60).alias("j")).agg(F.max("l_quantity").alias("v"))


@query("C11", f"WITH {_C} SELECT a.i, a.j FROM c a JOIN c b ON b.i = a.i + 1 AND b.j = a.j JOIN c d ON d.i = a.i AND d.j = a.j + 1 JOIN c e ON e.i = a.i + 1 AND e.j = a.j + 1")
def valid_quads(t):
    return raster.valid_quads(_cells(t), "i", "j", [])


@query("C12", f"WITH {_C}, {_AROUND}, n AS (SELECT c.i, c.j, count(x.i) AS n FROM c CROSS JOIN o LEFT JOIN c x ON x.i = c.i + di AND x.j = c.j + dj GROUP BY 1, 2) SELECT i, j FROM n WHERE n < 5")
def boundary_cells(t):
    return raster.boundary(_cells(t), ["i", "j"])


@query(
    "C13",
    f"""WITH {_C}, {_AROUND}, n AS (SELECT c.i, c.j, count(x.i) AS n FROM c CROSS JOIN o LEFT JOIN c x ON x.i = c.i + di AND x.j = c.j + dj GROUP BY 1, 2), e AS (SELECT i, j FROM n WHERE n = 5),
m AS (SELECT e.i, e.j, count(x.i) AS n FROM e CROSS JOIN o LEFT JOIN e x ON x.i = e.i + di AND x.j = e.j + dj GROUP BY 1, 2) SELECT i, j FROM m WHERE n = 5""",
)
def eroded_cells(t):
    return raster.eroded(_cells(t), ["i", "j"], 2)


@query("G06 R02", f"WITH {_C} SELECT a.i, a.j, max(b.v) AS v FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def splat_max(t):
    c = _cells(t)
    return raster.splat_max(c, ["i", "j"], "v", 1, c)


@query("G29 R08", f"WITH {_C} SELECT i // 2 AS i2, j // 2 AS j2, CAST(coalesce(round_even(avg(CASE WHEN v > 25 THEN v END), 0), 0) AS BIGINT) AS v FROM c GROUP BY 1, 2")
def pool_mean_nodata(t):
    c = _cells(t).withColumn("v", F.when(F.col("v") > 25, F.col("v")).otherwise(0.0))
    return aggs.pooled_mean(c, {"i2": F.floor(F.col("i") / 2), "j2": F.floor(F.col("j") / 2)}, "v")


@query("G30 G32", f"WITH {_C} SELECT i // 7 AS i, j // 7 AS j, max(v) AS v FROM c, (SELECT (max(l_suppkey) + 1) // 7 * 7 AS top FROM lineitem) WHERE i < top AND j < 56 GROUP BY 1, 2")
def pool_max_cropped(t):
    top = t("lineitem").agg(F.max("l_suppkey")).first()[0]
    return raster.pooled(_cells(t), ["i", "j"], 7, F.max("v").alias("v"), {"i": (top or 0) + 1, "j": 60})


@query("G31 R04", f"WITH {_C}, u AS (SELECT v, j, unnest(generate_series((i * 3) // 8, (i * 3 + 2) // 8)) AS k FROM c) SELECT k, max(v) AS v, count(DISTINCT j) AS n FROM u GROUP BY 1")
def interval_max(t):
    lo, hi = F.floor(F.col("i") * 3 / 8), F.floor((F.col("i") * 3 + 2) / 8)
    return _cells(t).withColumn("k", F.explode(F.sequence(lo, hi))).groupBy("k").agg(F.max("v").alias("v"), F.countDistinct("j").alias("n"))


@query("R01 R04", f'WITH {_C} SELECT i // 16 AS c_i, j // 16 AS c_j, count(*) AS n, CAST(min((i % 16) * 16 + j % 16) AS BIGINT) AS first_offset FROM c GROUP BY 1, 2')
def chunk_buckets(t):
    c = raster.chunk_of(_cells(t), ["i", "j"], 16)
    return c.groupBy("c_i", "c_j").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


@query(
    "R10 W25",
    f"""WITH {_C}, s AS (SELECT i, j, lead(j) OVER (PARTITION BY i ORDER BY j) AS j1 FROM c), u AS (SELECT i // 4 AS a, unnest(generate_series(j // 4, coalesce(j1, j) // 4)) AS b FROM s) SELECT DISTINCT a, b FROM u""",
)
def coarse_cells_crossed(t):
    from ..operators.ragged import over

    s = _cells(t).withColumn("j1", F.coalesce(F.lead("j").over(over("i", "j")), "j"))
    return s.select(F.floor(F.col("i") / 4).alias("a"), F.explode(F.sequence(F.floor(F.col("j") / 4), F.floor(F.col("j1") / 4))).alias("b")).distinct()


@query("F09", "SELECT s_suppkey, CAST(1 + (row_number() OVER (ORDER BY s_suppkey) - 1) % 31 AS BIGINT) AS label FROM supplier")
def round_robin_labels(t):
    return raster.round_robin_labels(t("supplier").select("s_suppkey"), "s_suppkey", 31)


@query("F09", "SELECT l_partkey, CAST(bit_or(CAST(1 AS BIGINT) << (l_suppkey % 60)) AS BIGINT) AS labels, CAST(bit_count(bit_or(CAST(1 AS BIGINT) << (l_suppkey % 60))) AS INTEGER) AS n FROM lineitem GROUP BY 1")
def label_bitmasks(t):
    bit = F.expr("shiftleft(1L, cast(l_suppkey % 60 as int))")
    return t("lineitem").groupBy("l_partkey").agg(F.bit_or(bit).alias("labels")).select("l_partkey", "labels", F.bit_count("labels").alias("n"))


@query("U07", "WITH r AS (SELECT l_suppkey AS i, l_partkey % 60 AS j, l_orderkey AS label, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) SELECT i, j, label FROM r WHERE rn = 1")
def first_writer_wins(t):
    from ..operators.joins import first_per_key

    c = t("lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 60).alias("j"), F.col("l_orderkey").alias("label"), "l_linenumber", "l_partkey")
    return first_per_key(c, ["i", "j"], ["label", "l_linenumber", "l_partkey"]).select("i", "j", "label")


@query("J17", f"WITH {_C}, p AS (SELECT event_id, user_id % 95 + 0.25 AS i, event_id % 55 + 0.5 AS j FROM events), w AS (SELECT *, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM p) SELECT event_id, round(CASE WHEN count(v) = 4 THEN sum((CASE WHEN a = 1 THEN 0.25 ELSE 0.75 END) * 0.5 * v) END, 6) AS v FROM w LEFT JOIN c ON c.i = floor(w.i) + a AND c.j = floor(w.j) + b GROUP BY 1")
def corner_gather(t):
    p = t("events").select("event_id", (F.col("user_id") % 95 + F.lit(0.25)).alias("i"), (F.col("event_id") % 55 + F.lit(0.5)).alias("j"))
    return raster.bilinear(p, _cells(t), [], "i", "j", "v").select("event_id", F.round("v", 6).alias("v"))


@query(
    "S14",
    """WITH RECURSIVE p AS (SELECT s_suppkey, s_acctbal AS y, CAST(s_nationkey * 400 AS DOUBLE) AS x, row_number() OVER (ORDER BY ('0x' || md5('5:' || s_suppkey)[1:15])::BIGINT, s_suppkey) AS rn FROM supplier),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, y DOUBLE, x DOUBLE)[]) AS taken UNION ALL SELECT p.rn, CASE WHEN len(list_filter(taken, lambda t: sqrt((t.y - p.y) ** 2 + (t.x - p.x) ** 2) < 900)) = 0 THEN list_append(taken, struct_pack(id := CAST(s_suppkey AS BIGINT), y := p.y, x := p.x)) ELSE taken END FROM w JOIN p ON p.rn = w.rn + 1),
u AS (SELECT unnest(taken[1:40]) AS t FROM w WHERE rn = (SELECT max(rn) FROM p)) SELECT t.id AS s_suppkey, t.y AS y, t.x AS x FROM u""",
)
def spaced_random_points(t):
    from ..operators import greedy

    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), (F.col("s_nationkey") * 400).cast("double").alias("x"))
    return greedy.spaced_random(s, "s_suppkey", ["y", "x"], 900.0, 40, "5")


@query("S06", None)
def evenly_spaced_lines(t):
    from ..operators import greedy

    p = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("p"))
    return greedy.evenly_spaced(p, "k", "p", "id", 1500.0)


_UNWRAP = f"""WITH RECURSIVE s AS (SELECT CAST(floor(sqrt(max(event_id))) AS BIGINT) + 1 AS side FROM events), c AS (SELECT event_id // side AS i, event_id % side AS j, (event_id * 0.37) % (2 * pi()) AS a FROM events, s),
w AS (SELECT x.i * 1000000 + x.j AS src, y.i * 1000000 + y.j AS dst, CASE WHEN y.a - x.a > pi() THEN 1 WHEN y.a - x.a < -pi() THEN -1 ELSE 0 END AS delta FROM c x JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) m(di, dj) ON true JOIN c y ON y.i = x.i + di AND y.j = x.j + dj),
l(node, root) USING KEY (node) AS (SELECT i * 1000000 + j, i * 1000000 + j FROM c UNION SELECT w.dst, min(l.root) FROM l JOIN w ON l.node = w.src LEFT JOIN recurring.l k ON k.node = w.dst GROUP BY w.dst, k.root HAVING min(l.root) < k.root),
b(node, turns) USING KEY (node) AS (SELECT DISTINCT root, CAST(0 AS BIGINT) FROM l UNION SELECT w.dst, CAST(min(b.turns + delta) AS BIGINT) FROM b JOIN w ON b.node = w.src LEFT JOIN recurring.b k ON k.node = w.dst WHERE k.node IS NULL GROUP BY w.dst),
z AS (SELECT root, count(*) AS n FROM l GROUP BY 1), t AS (SELECT arg_min(root, (-n, root)) AS top FROM z)
SELECT node // 1000000 AS i, node % 1000000 AS j, turns, root = top AS main FROM b JOIN l USING (node), t"""


@query("K09 K10 W26", _UNWRAP)
def unwrapped_block_grid(t):
    from ..operators import greedy

    # All events as a square, row by row.
    e = t("events").select("event_id")
    side = math.isqrt(max(e.agg(F.max("event_id")).first()[0] or 0, 0)) + 1
    c = e.select(F.floor(F.col("event_id") / side).alias("i"), (F.col("event_id") % side).alias("j"), (F.col("event_id") * 0.37).alias("a"))
    return greedy.unwrapped_grid(c, "i", "j", "a")
