"""Graphs: nations, customers, suppliers and parts as nodes; trade as edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import graph, joins
from ..operators.ragged import numbered
from .registry import query

# Edges between parts that are consecutive lines of an order.
_E = """e AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
  WHERE a.l_partkey <> b.l_partkey),
d AS (SELECT a AS src, b AS dst, b - a AS delta0 FROM e UNION ALL SELECT b, a, a - b FROM e),
g AS (SELECT src, dst, CASE WHEN src < dst THEN (src + dst) % 7 - 3 ELSE -((src + dst) % 7 - 3) END AS delta FROM d)"""


_OPENING = _E.replace("a.l_linenumber + 1 = b.l_linenumber", "a.l_linenumber = 1 AND b.l_linenumber = 2")


def _least_label(name: str, edges: str) -> str:
    """Each node's least reachable node, by labels that only fall."""
    return f"""{name}(node, root) USING KEY (node) AS (SELECT src, src FROM {edges} UNION
  SELECT w.dst, min(r.root) FROM {name} r JOIN {edges} w ON r.node = w.src LEFT JOIN recurring.{name} k ON k.node = w.dst GROUP BY w.dst, k.root HAVING k.root IS NULL OR min(r.root) < k.root)"""


def _edges(t, opening: bool = False):
    """Parts of consecutive lines; ``opening``: of the first and second line only."""
    one = lambda k, name: t("lineitem").select("l_orderkey", (F.col("l_linenumber") + k).alias("n"), F.col("l_partkey").alias(name))
    e = one(1, "p").join(one(0, "q"), ["l_orderkey", "n"]).where("p != q")
    return (e.where("n = 2") if opening else e).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _directed(t, opening: bool = False):
    e = joins.both_ways(_edges(t, opening))
    w: Column = (F.col("src") + F.col("dst")) % 7 - 3
    return e.select("src", "dst", F.when(F.col("src") < F.col("dst"), w).otherwise(-w).alias("delta"))


_LEAST_COST = """r(node, cost) USING KEY (node) AS ({first} UNION
  SELECT w.dst, min(r.cost + w.w) FROM r JOIN w ON r.node = w.src LEFT JOIN recurring.r k ON k.node = w.dst GROUP BY w.dst, k.cost HAVING k.cost IS NULL OR min(r.cost + w.w) < k.cost)"""

# From the least part of each component to all that it reaches.
_BFS = f"""WITH RECURSIVE {_E}, {_least_label("c", "g")},
tree(node, depth, acc, parent) USING KEY (node) AS (SELECT DISTINCT root, 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM c UNION
  SELECT g.dst, t.depth + 1, CAST(min(t.acc + g.delta) AS BIGINT), arg_min(g.src, (t.acc + g.delta, g.src)) FROM tree t JOIN g ON t.node = g.src LEFT JOIN recurring.tree k ON k.node = g.dst WHERE k.node IS NULL GROUP BY g.dst, t.depth)"""
_PATHS = """w(node, up, path) AS (SELECT node, parent, [node] FROM tree UNION ALL SELECT w.node, t.parent, list_append(w.path, w.up) FROM w JOIN tree t ON t.node = w.up), p AS (SELECT node, path FROM w WHERE up IS NULL)"""


def _walked(t):
    """The directed edges, made once, and the tree over them."""
    directed = graph.Tables(t("lineitem").sparkSession, "walked").put(_directed(t), "edges")
    seeds = graph.components(directed.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("root").alias("node")).distinct()
    return directed, graph.breadth_first(directed, seeds, None)


def _tree(t):
    return _walked(t)[1]


@query("K01 K10 A29", f"{_BFS} SELECT node, depth, acc, parent FROM tree")
def bfs_hops(t):
    return _tree(t).select("node", "depth", "acc", "parent")


@query("K02 G35", f"{_BFS} SELECT CAST(floor(p_size / 10.0) + acc AS BIGINT) AS vote, count(*) AS votes FROM tree JOIN part ON node = p_partkey GROUP BY 1")
def vote_tally(t):
    p = t("part").select(F.col("p_partkey").alias("node"), "p_size")
    return _tree(t).join(p, "node").groupBy((F.floor(F.col("p_size") / 10) + F.col("acc")).cast("long").alias("vote")).agg(F.count("*").alias("votes"))


@query(
    "K03 J27",
    f"""{_BFS} SELECT g.src, g.dst, CAST(x.acc + g.delta - y.acc AS BIGINT) AS holonomy FROM g JOIN tree x ON g.src = x.node JOIN tree y ON g.dst = y.node
WHERE g.src < g.dst AND NOT (coalesce(y.parent = g.src, false) OR coalesce(x.parent = g.dst, false))""",
)
def cycle_holonomy(t):
    return graph.holonomy(*_walked(t)).withColumn("holonomy", F.col("holonomy").cast("long"))


@query(
    "K12",
    f"""{_BFS}, {_PATHS} SELECT node, CAST(len(path) AS BIGINT) AS length, array_to_string(path, '-') AS path FROM p""",
)
def tree_paths(t):
    p = graph.paths_to_root(_tree(t))
    return p.select("node", F.size("path").cast("long").alias("length"), F.concat_ws("-", F.transform("path", lambda x: x.cast("string"))).alias("path"))


_H = "h AS (SELECT g.src, g.dst, CAST(x.acc + g.delta - y.acc AS BIGINT) AS holonomy FROM g JOIN tree x ON g.src = x.node JOIN tree y ON g.dst = y.node WHERE g.src < g.dst AND NOT (coalesce(y.parent = g.src, false) OR coalesce(x.parent = g.dst, false)))"


@query(
    "K04",
    f"""{_BFS}, {_H}, {_PATHS},
j AS (SELECT src, dst, holonomy, p.path AS pp, q.path AS qq, list_filter(p.path, lambda x: list_contains(q.path, x))[1] AS lca FROM h JOIN p ON p.node = src JOIN p q ON q.node = dst WHERE holonomy <> 0)
SELECT src, dst, holonomy, lca, array_to_string(list_concat(pp[1:list_position(pp, lca)], list_reverse(qq[1:list_position(qq, lca) - 1])), '-') AS cycle FROM j""",
)
def fundamental_cycles(t):
    directed, tree = _walked(t)
    loops = graph.holonomy(directed, tree).withColumn("holonomy", F.col("holonomy").cast("long")).where("holonomy != 0")
    c = graph.fundamental_cycles(loops, tree)
    return c.withColumn("cycle", F.concat_ws("-", F.transform("cycle", lambda x: x.cast("string"))))


@query("K23", f"{_BFS} SELECT node, depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY parent NULLS FIRST, node) - 1 AS BIGINT) AS slot FROM tree")
def layout_slots(t):
    return graph.layout_slots(_tree(t)).select("node", "depth", F.col("slot").cast("long").alias("slot"))


@query(
    "K06 K07",
    f"""WITH RECURSIVE {_OPENING}, {_least_label("r", "g")}
SELECT root, count(*) AS nodes, CAST(sum(p_size) AS BIGINT) AS area, row_number() OVER (ORDER BY count(*) DESC, sum(p_size) DESC, root) AS rank FROM r JOIN part ON node = p_partkey GROUP BY 1""",
)
def components_rank(t):
    # All consecutive lines would make one component.
    c = graph.components(_edges(t, opening=True)).join(t("part").select(F.col("p_partkey").alias("node"), "p_size"), "node")
    c = c.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("p_size").alias("area"))
    return numbered(c, [F.desc("nodes"), F.desc("area"), F.col("root")], "rank").withColumn("rank", F.col("rank") + 1)


@query("K19 U04", f"WITH {_E}, t AS (SELECT x.a AS n1, x.b AS n2, y.b AS n3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), u AS (SELECT unnest([n1, n2, n3]) AS node FROM t) SELECT node, count(*) AS triangles FROM u GROUP BY 1")
def triangles_per_node(t):
    return graph.triangles(_edges(t))


@query("K19", f"WITH {_E}, s AS (SELECT x.src AS a, y.src AS c, count(*) AS n FROM g x JOIN g y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) SELECT a, c, CAST(n * (n - 1) // 2 AS BIGINT) AS cycles FROM s WHERE n > 1")
def four_cycles(t):
    return graph.four_cycles(_edges(t))


@query(
    "K11",
    f"""WITH RECURSIVE {_E}, w AS (SELECT src, dst, 1 + (src + dst) % 5 AS w FROM g), {_LEAST_COST.format(first="SELECT CAST(100 AS BIGINT), CAST(0 AS BIGINT)")} SELECT node, CAST(cost AS DOUBLE) AS cost FROM r""",
)
def shortest_paths(t):
    e = _directed(t).select("src", "dst", (1.0 + (F.col("src") + F.col("dst")) % 5).alias("weight"))
    return graph.shortest_paths(e, t("part").where("p_partkey = 100").select(F.col("p_partkey").alias("node"))).select("node", "cost")


_QUADS = """c AS (SELECT DISTINCT l_suppkey AS i, l_partkey % 60 AS j FROM lineitem WHERE l_quantity > 25), n AS (SELECT i, j, i * 60 + j AS node FROM c),
w AS (SELECT a.node AS src, b.node AS dst, CASE WHEN a.i = b.i OR a.j = b.j THEN 1 ELSE sqrt(2) END AS w FROM n a JOIN (VALUES (0, 1), (1, 0), (1, 1), (1, -1), (0, -1), (-1, 0), (-1, -1), (-1, 1)) m(di, dj) ON true JOIN n b ON b.i = a.i + di AND b.j = a.j + dj)"""


def _quads(t):
    c = t("lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 60).alias("j")).distinct()
    return c.withColumn("node", F.col("i") * 60 + F.col("j"))


@query("K11 K07", f"""WITH RECURSIVE {_QUADS}, {_LEAST_COST.format(first="SELECT min(node), CAST(0 AS DOUBLE) FROM n")} SELECT node, round(cost, 6) AS cost FROM r""")
def grid_geodesics(t):
    from ..operators import blocks

    c = _quads(t)
    first = c.agg(F.min("node").alias("first"))
    c = c.join(F.broadcast(first))  # first is one row
    g = blocks.geodesics(c.withColumn("seed", F.col("node") == F.col("first")), "i", "j", "seed")
    return g.select((F.col("i") * 60 + F.col("j")).alias("node"), F.round("cost", 6).alias("cost"))


@query(
    "K14",
    f"""WITH RECURSIVE {_OPENING}, n AS (SELECT src AS node FROM g GROUP BY 1 HAVING count(*) = 2), i AS (SELECT src, dst FROM g WHERE src IN (FROM n) AND dst IN (FROM n)),
r AS (SELECT node, node AS chain FROM n UNION SELECT dst, chain FROM r JOIN i ON node = src), c AS (SELECT node, min(chain) AS chain FROM r GROUP BY 1)
SELECT chain, count(*) AS length FROM c GROUP BY 1""",
)
def degree_two_chains(t):
    # With all consecutive lines no part has only two neighbours.
    return graph.chains(_edges(t, opening=True)).groupBy("chain").agg(F.count("*").alias("length"))


@query(
    "K20",
    f"""WITH {_OPENING}, p AS (SELECT src, dst, (src * 7 + dst * 13) % 50 AS position FROM g),
c1 AS (SELECT a.src AS s, a.dst AS c, b.position AS entry FROM p a JOIN p b ON b.src = a.dst AND b.dst = a.src), x1 AS (SELECT s, c, p.dst AS x FROM c1 JOIN p ON p.src = c AND p.dst <> s AND abs(position - entry) >= 10),
o1 AS (SELECT s, c FROM x1 JOIN p ON p.src = x AND p.dst = s UNION SELECT s, c FROM x1 JOIN p v ON v.src = x AND v.dst <> c AND v.dst <> s JOIN p h ON h.src = v.dst AND h.dst = s),
w1 AS (SELECT s, arg_min(c, ((s * 31 + c * 17) % 101, c)) AS u FROM o1 GROUP BY s),
c2 AS (SELECT s, u, a.dst AS c, b.position AS entry FROM w1 JOIN p a ON a.src = u AND a.dst <> s JOIN p b ON b.src = a.dst AND b.dst = u), x2 AS (SELECT s, u, c, p.dst AS x FROM c2 JOIN p ON p.src = c AND p.dst <> u AND abs(position - entry) >= 10),
o2 AS (SELECT s, u, c FROM x2 WHERE x = s UNION SELECT s, u, c FROM x2 JOIN p ON x <> s AND p.src = x AND p.dst = s), w2 AS (SELECT s, arg_min(c, ((u * 31 + c * 17) % 101, c)) AS v FROM o2 GROUP BY s)
SELECT n.src AS start, concat_ws('-', n.src, u, v) AS walk FROM (SELECT DISTINCT src FROM p) n LEFT JOIN w1 ON w1.s = n.src LEFT JOIN w2 ON w2.s = n.src""",
)
def gated_walks(t):
    """Over the first two lines of each order: with all consecutive lines a part has some 45 neighbours, and returns over three tracks are their cubes."""
    g = _directed(t, opening=True)
    records = graph.cut_lineage(g.select("src", "dst", ((F.col("src") * 7 + F.col("dst") * 13) % 50).alias("position")))
    order = (F.col("src") * 31 + F.col("dst") * 17) % 101
    w = graph.gated_walks(records, records.select(F.col("src").alias("node")).distinct(), 2, 10.0, order)
    return w.select("start", F.concat_ws("-", F.transform("walk", lambda x: x.cast("string"))).alias("walk"))


@query(
    "G47",
    f"""{_BFS}, h AS (SELECT g.src, g.dst, x.acc + g.delta - y.acc AS h, least(coalesce(x.parent, -1), coalesce(y.parent, -1)) AS key FROM g JOIN tree x ON g.src = x.node JOIN tree y ON g.dst = y.node WHERE g.src < g.dst AND NOT (coalesce(y.parent = g.src, false) OR coalesce(x.parent = g.dst, false)))
SELECT key, count(*) AS cycles, CAST(max(abs(h)) AS BIGINT) AS worst FROM h GROUP BY 1 ORDER BY worst DESC, cycles DESC, key LIMIT 10""",
)
def worst_cycle_groups(t):
    h = graph.holonomy(*_walked(t), parents=True)
    h = h.groupBy(F.least(F.coalesce("sp", F.lit(-1)), F.coalesce("dp", F.lit(-1))).alias("key"))
    return h.agg(F.count("*").alias("cycles"), F.max(F.abs("holonomy")).cast("long").alias("worst")).orderBy(F.desc("worst"), F.desc("cycles"), "key").limit(10)


_KINDS = "k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS n FROM (SELECT DISTINCT event_type FROM events))"


@query(
    "K05",
    f"""WITH {_KINDS}, s AS (SELECT user_id, n AS a, lead(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events JOIN k USING (event_type)),
e AS (SELECT DISTINCT user_id, least(a, b) AS src, greatest(a, b) AS dst FROM s WHERE a <> b), d AS (SELECT *, dst - src + CASE WHEN (user_id + src * 3 + dst * 5) % 4 = 0 THEN 1 ELSE 0 END AS delta FROM e),
v AS (SELECT CAST(unnest(generate_series(-2, 2)) AS BIGINT) AS o), x AS (SELECT [0, v1.o, v2.o, v3.o, v4.o] AS o FROM v v1, v v2, v v3, v v4),
c AS (SELECT user_id, x.o AS o, count(*) FILTER (dst + x.o[dst + 1] - src - x.o[src + 1] <> delta) AS n FROM d, x GROUP BY 1, 2) SELECT user_id, min(n) AS changed FROM c GROUP BY 1""",
)
def fewest_repairs(t):
    from pyspark.sql import Window

    from ..operators import ragged, repairs

    kinds = t("events").select("event_type").distinct()
    kinds = ragged.numbered(kinds, ["event_type"], "n")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = t("events").join(kinds, "event_type").select("user_id", F.col("n").alias("a"), F.lead("n").over(w).alias("b")).where("a != b")
    e = s.select("user_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    e = e.withColumn("delta", F.col("dst") - F.col("src") + ((F.col("user_id") + F.col("src") * 3 + F.col("dst") * 5) % 4 == 0).cast("long"))
    return repairs.repaired(e, "user_id", "src", "dst", "delta").groupBy("user_id").agg(F.sum(F.col("changed").cast("long")).alias("changed"))
