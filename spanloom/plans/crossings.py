"""Tracks that cross in cells: orders are tracks, parts are cells, line numbers are places, priorities are families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, joins
from .registry import query

_POINTS = """points AS (SELECT l_partkey AS cell, l_orderkey AS track, min(l_linenumber) AS idx, any_value(o_orderpriority) AS fam
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
events AS (SELECT a.cell AS cell, a.track AS a, b.track AS b, a.idx AS a_idx, b.idx AS b_idx
  FROM points a JOIN points b ON a.cell = b.cell AND a.track < b.track AND a.fam <> b.fam)"""


def _points(t):
    o = t("orders").select(F.col("o_orderkey").alias("track"), F.col("o_orderpriority").alias("fam"))
    return t("lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("idx")).join(o, "track")


def _events(t):
    return joins.crossing_events(_points(t), "track", "cell", "idx", "fam")


def _partners(t, ahead: bool = False):
    return joins.partners(_points(t), "track", "cell", "idx", "fam", ahead)


def _edges(t):
    return _events(t).select("a", "b").distinct()


@query("J01 W12 U03 F20", f"WITH {_POINTS} SELECT a, b, cell, a_idx, b_idx FROM events")
def crossing_pairs(t):
    return _events(t).select("a", "b", "cell", "a_idx", "b_idx")


@query(
    "J02 J03 W10",
    f"""WITH {_POINTS}, g AS (SELECT *, CASE WHEN abs(a_idx - lag(a_idx) OVER w) > 4 OR abs(b_idx - lag(b_idx) OVER w) > 4 OR lag(a_idx) OVER w IS NULL THEN 1 ELSE 0 END AS n
  FROM events WINDOW w AS (PARTITION BY a, b ORDER BY a_idx, b_idx)),
c AS (SELECT *, sum(n) OVER (PARTITION BY a, b ORDER BY a_idx, b_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
m AS (SELECT *, count(*) OVER (PARTITION BY a, b, cluster) AS cnt, row_number() OVER (PARTITION BY a, b, cluster ORDER BY a_idx, b_idx) - 1 AS k FROM c),
r AS (SELECT *, abs(a_idx - b_idx) AS clearance FROM m WHERE k = cnt // 2),
best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY clearance DESC, a_idx, b_idx) AS rn, max(cluster) OVER (PARTITION BY a, b) AS clusters FROM r)
SELECT a, b, CAST(clusters AS BIGINT) AS clusters, a_idx, b_idx, clearance FROM best WHERE rn = 1""",
)
def crossing_best_event(t):
    return joins.best_crossings(joins.later(_partners(t, ahead=True)), F.abs(F.col("a_idx") - F.col("b_idx"))).select("a", "b", "clusters", "a_idx", "b_idx", "clearance")


@query(
    "J03 G04 K22 S05",
    f"""WITH {_POINTS}, e AS (SELECT DISTINCT a, b FROM events), d AS (SELECT a AS o_orderkey, count(*) AS n FROM (SELECT a FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS degree FROM orders LEFT JOIN d USING (o_orderkey)""",
)
def csr_degree_zero_filled(t):
    degree = joins.neighbour_counts(_partners(t).select(F.col("track").alias("o_orderkey"), F.col("them.track").alias("ids")), "o_orderkey", "degree")
    return aggs.zero_filled(t("orders"), degree, "o_orderkey", "degree")


@query(
    "J05 C09 U05 K22 J04",
    f"""WITH {_POINTS}, e AS (SELECT DISTINCT a, b FROM events), n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders WHERE o_totalprice > 100000)
SELECT x.id AS a_id, y.id AS b_id FROM e JOIN n x ON e.a = x.o_orderkey JOIN n y ON e.b = y.o_orderkey""",
)
def restrict_remap(t):
    # Points of other orders go before the join of all points with each other, and the rest take their numbers there.
    kept = joins.numbered_nodes(t("orders").where("o_totalprice > 100000"), "o_orderkey", t("orders").select("o_orderkey"))
    points = _points(t).join(kept.withColumnRenamed("o_orderkey", "track"), "track").drop("track")
    met = joins.partners(points, "id", "cell", "idx", "fam", ahead=True)
    return joins.neighbours(met.select(F.col("track").alias("a_id"), F.col("them.track").alias("ids")), "a_id", "b_id")


@query(
    "J20 C29 K21",
    f"""WITH {_POINTS}, r AS (SELECT a AS src, b AS dst, a_idx AS s, b_idx AS d FROM events UNION ALL SELECT b, a, b_idx, a_idx FROM events),
c AS (SELECT src, dst, s, d, count(*) AS n FROM r GROUP BY ALL),
j AS (SELECT c.*, x.n AS back FROM c LEFT JOIN c x ON c.src = x.dst AND c.dst = x.src AND c.s = x.d AND c.d = x.s)
SELECT count(*) AS records, count(*) FILTER (back IS NULL OR back <> n) AS unmatched, count(DISTINCT src) AS nodes FROM j""",
)
def reciprocal_records(t):
    e = joins.later(_partners(t, ahead=True))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("a_idx").alias("s"), F.col("b_idx").alias("d")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("b_idx").alias("s"), F.col("a_idx").alias("d")))
    # Both results are one row.
    return joins.reciprocity(e.select(F.col("a").alias("low"), F.inline(ways)), "low").crossJoin(_partners(t).where(F.size("them") > 0).agg(F.countDistinct("track").alias("nodes")))


@query(
    "G43",
    f"""WITH {_POINTS}, r AS (SELECT a AS src, b AS dst FROM events UNION ALL SELECT b, a FROM events)
SELECT src, count(*) AS crossings, count(DISTINCT dst) AS neighbours, count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS urgent
FROM r JOIN orders ON dst = o_orderkey GROUP BY src""",
)
def connectivity_summary(t):
    urgent = F.size(F.filter("them", lambda x: x["fam"].rlike("^[12]")))
    met = _partners(t).select(F.col("track").alias("src"), urgent.cast("long").alias("urgent"), F.col("them.track").alias("ids"))
    return joins.neighbour_counts(met, "src", "neighbours", F.sum(F.size("ids")).alias("crossings"), F.sum("urgent").alias("urgent")).select("src", "crossings", "neighbours", "urgent")


@query(
    "J13 U06 B08 S09",
    """WITH v AS (SELECT l_suppkey AS s, l_partkey AS p, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
j AS (SELECT x.s AS a, y.s AS b, count(*) AS shared, count(*) FILTER (x.q > y.q) AS above, count(*) FILTER (x.q < y.q) AS below FROM v x JOIN v y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2)
SELECT a, b, shared, above, below, least(above, below) AS both_ways FROM j WHERE above >= 5 AND below >= 5""",
)
def overlap_pairs_symmetric(t):
    p = joins.overlap_pairs(t("lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    return p.where("above >= 5 and below >= 5").withColumn("both_ways", F.least("above", "below"))


@query(
    "J23 K19",
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
w AS (SELECT x.s AS a, y.s AS c, count(*) AS n FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2)
SELECT a, c, CAST(n * (n - 1) // 2 AS BIGINT) AS quads FROM w WHERE n > 1""",
)
def quad_closures(t):
    e = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    w = joins.dealt_pairs(e, "s", "p", "a", "c").groupBy("a", "c").agg(F.count("*").alias("n"))
    return w.where("n > 1").select("a", "c", F.expr("n * (n - 1) div 2").alias("quads"))


@query(
    "S04 S05",
    """WITH c AS (SELECT l_suppkey AS k, l_partkey AS id, min(l_linenumber) * 1000.0 + l_partkey % 1000 AS p FROM lineitem GROUP BY 1, 2),
one AS (SELECT k, min(p) AS p1, max(p) AS far FROM c GROUP BY k),
a AS (SELECT k, min(id) AS id1, any_value(p1) AS p1 FROM c JOIN one USING (k) WHERE p = p1 GROUP BY k),
b AS (SELECT c.k, min(id) AS id2, max(p) AS p2 FROM c JOIN one ON c.k = one.k AND p = far GROUP BY c.k),
d AS (SELECT c.k, c.id, c.p, row_number() OVER (PARTITION BY c.k ORDER BY least(abs(p - p1), abs(p - p2)) DESC, id) AS rn FROM c JOIN a ON c.k = a.k JOIN b ON c.k = b.k WHERE id <> id1 AND id <> id2)
SELECT k, 0 AS rank, id1 AS id, p1 AS p FROM a UNION ALL SELECT k, 1, id2, p2 FROM b UNION ALL SELECT k, 2, id, p FROM d WHERE rn = 1""",
)
def maximin_spaced_partners(t):
    from ..operators import sampling

    c = t("lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id"))
    c = c.agg((F.min("l_linenumber") * 1000.0 + F.col("id") % 1000).alias("p")).withColumn("c", F.lit(0.0))
    return sampling.spaced_top_k(c, "k", "p", "c", "id", 3)


@query(
    "K16 S16",
    f"""WITH {_POINTS}, r AS (SELECT a AS src, b AS dst, a_idx AS s, b_idx AS p FROM events UNION ALL SELECT b, a, b_idx, a_idx FROM events),
w1 AS (SELECT src AS n0, min(struct_pack(o := (src * 31 + dst * 17) % 1009, dst := dst, s := s, p := p)) AS n FROM r GROUP BY 1),
w2 AS (SELECT n0, any_value(n.dst) AS n1, min(struct_pack(o := (src * 31 + r.dst * 17) % 1009, dst := r.dst, s := r.s, p := r.p)) AS m FROM w1 JOIN r ON src = n.dst AND r.dst <> n0 AND abs(r.s - n.p) BETWEEN 1 AND 3 GROUP BY 1)
SELECT n0 AS start, concat_ws('-', n0, n1, m.dst) AS walk FROM w2""",
)
def crossing_walks(t):
    from ..operators import graph

    seeds = t("orders").select(F.col("o_orderkey").alias("node"))
    w = graph.point_walks(_points(t), "track", "cell", "idx", "fam", seeds, 2, 1, 3, lambda src, dst: (src * 31 + dst * 17) % 1009)
    return w.select("start", F.concat_ws("-", F.transform("walk", lambda x: x.cast("string"))).alias("walk"))
