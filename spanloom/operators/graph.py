"""Graphs as edge tables. Loops run rounds of joins, a bounded number or until nothing is new; each round's result is cut off from its plan."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that the driver and all executors share. Where that is unset, one of this machine does if all of Spark runs on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Tables:
    """Tables of a loop in the shared folder, by name: what a round wrote is read without the plan that made it, nor what Spark inferred from that."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def breadth_first(edges: DataFrame, seeds: DataFrame, hops: int | None, node: str = "node") -> DataFrame:
    """node, depth, acc, parent: reached from the seeds over (src, dst, delta) within ``hops``, or at all; first reach wins.

    In a level, a node takes the offer of the least (accumulated delta, parent), so the result has no order to depend on.
    """
    seen = cut_lineage(seeds.select(F.col(node).alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("acc"), F.lit(None).cast(dict(seeds.dtypes)[node]).alias("parent")).distinct())
    front = seen
    for depth in itertools.count(1) if hops is None else range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("acc") + F.col("delta")).cast("long").alias("acc"), F.col("src").alias("parent"))
        step = step.groupBy("node").agg(F.min(F.struct("acc", "parent")).alias("o")).join(seen.select("node"), "node", "left_anti")
        front = cut_lineage(step.select("node", F.lit(depth).alias("depth"), "o.acc", "o.parent"))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def holonomy(edges: DataFrame, tree: DataFrame, parents: bool = False) -> DataFrame:
    """Edges (src, dst, delta) between reached nodes that the tree does not use, with how far their cycle fails to close.

    ``parents``: with sp and dp, the parents of src and dst in the tree.
    """
    t = tree.select("node", "acc", "parent")
    a = t.select(F.col("node").alias("src"), F.col("acc").alias("sa"), F.col("parent").alias("sp"))
    b = t.select(F.col("node").alias("dst"), F.col("acc").alias("da"), F.col("parent").alias("dp"))
    # The order of src and dst is given: half of the edges meet nothing.
    j = edges.where("src < dst").join(a, "src").join(b, "dst")
    used = F.coalesce(F.col("dp") == F.col("src"), F.lit(False)) | F.coalesce(F.col("sp") == F.col("dst"), F.lit(False))
    return j.where(~used).select("src", "dst", (F.col("sa") + F.col("delta") - F.col("da")).alias("holonomy"), *(["sp", "dp"] if parents else []))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root on another: then every root is its component's least node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of the component, by star contractions until all edges are stars.

    A node's least neighbour comes from a partial aggregate and is written, so that the join with it can be split at hubs.
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = cut_lineage(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _from_lower_degree(edges: DataFrame) -> DataFrame:
    """Each undirected edge a < b once, from its end of lower degree: wedges over it stay few even at hubs."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    deg = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    e = e.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles."""
    e = _from_lower_degree(edges)
    wedge = e.alias("p").join(e.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("n1"), F.col("p.y").alias("n2"), F.col("q.y").alias("n3"))
    closing = e.select(F.least("x", "y").alias("n2"), F.greatest("x", "y").alias("n3"))
    return wedge.join(closing, ["n2", "n3"]).select(F.explode(F.array("n1", "n2", "n3")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """a, c, cycles: pairs of opposite corners and the 4-cycles through them, from the number of their shared neighbours."""
    from .joins import dealt_pairs

    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    shared = dealt_pairs(both, "a", "b", "a", "c").groupBy("a", "c").agg(F.count("*").alias("n"))
    return shared.where("n > 1").select("a", "c", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("cycles"))


def paths_to_root(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """node, path: from the node back to its root, over the parents, at most ``depth`` steps (default: all)."""
    if depth is None:
        depth = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    p = tree.select("node", "parent", F.array("node").alias("path"))
    up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
    for k in range(depth):
        p = p.join(up, "parent", "left").select("node", F.col("next").alias("parent"), F.when(F.col("parent").isNotNull(), F.concat("path", F.array("parent"))).otherwise(F.col("path")).alias("path"))
        if k % 16 == 15:
            p = cut_lineage(p)
    return p.select("node", "path")


def fundamental_cycles(loops: DataFrame, tree: DataFrame) -> DataFrame:
    """``loops`` (src, dst) with lca and cycle: the tree's path from src up to the lowest common ancestor and down to dst.

    The loop's own edge closes the cycle from dst back to src.
    """
    p = cut_lineage(paths_to_root(tree))
    j = loops.join(p.select(F.col("node").alias("src"), F.col("path").alias("__p")), "src").join(p.select(F.col("node").alias("dst"), F.col("path").alias("__q")), "dst")
    j = j.withColumn("lca", F.get(F.filter("__p", lambda x: F.array_contains(F.col("__q"), x)), F.lit(0)))
    up = F.slice("__p", F.lit(1), F.array_position("__p", F.col("lca")).cast("int"))
    down = F.slice("__q", F.lit(1), (F.array_position("__q", F.col("lca")) - 1).cast("int"))
    return j.withColumn("cycle", F.concat(up, F.reverse(down))).select(*loops.columns, "lca", "cycle")


def shortest_paths(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, cost, parent: least total weight from any seed over (src, dst, weight > 0), and the node before (the least of equals).

    Rounds relax the edges of what was improved in the round before, until nothing is, or ``rounds`` times. Edges are made
    once, and a round writes what it improved: Spark knows its size, and while that is small does not deal the edges anew.
    """
    kind, tables = dict(seeds.dtypes)["node"], Tables(edges.sparkSession, "shortest")
    edges = tables.put(edges.select("src", "dst", "weight"), "edges")
    best = tables.put(seeds.select("node", F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("parent")).distinct(), "best")
    front = best
    for round_ in itertools.count() if rounds is None else range(rounds):
        offers = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("parent"))
        offers = offers.groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("o"))
        old = best.select("node", F.col("cost").alias("had"))
        front = tables.put(offers.join(old, "node", "left").where("had is null or o.cost < had").select("node", "o.cost", "o.parent"), f"front-{round_}")
        if front.isEmpty():
            break
        best = tables.put(best.join(front.select("node"), "node", "left_anti").unionByName(front), f"best-{round_}")
    return best


def quad_edges(cells: DataFrame, node: str, i: str, j: str, keys: list[str] | None = None) -> DataFrame:
    """src, dst, weight: both ways between neighbouring cells of a key, 1 along a side and the square root of 2 at a corner."""
    keys = keys or []
    moves = [(a, b, 1.0 if a == 0 or b == 0 else 2**0.5) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    move = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in moves]))
    d = cells.select(*keys, F.col(node).alias("src"), i, j, move.alias("m"))
    d = d.select(*keys, "src", (F.col(i) + F.col("m.a")).alias(i), (F.col(j) + F.col("m.b")).alias(j), F.col("m.w").alias("weight"))
    return d.join(cells.select(*keys, i, j, F.col(node).alias("dst")), [*keys, i, j]).select("src", "dst", "weight")


def chains(edges: DataFrame) -> DataFrame:
    """node, chain: components of nodes of degree two, joined by edges between such nodes; alone ones are their own."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    two = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d")).where("d = 2").select("n")
    inner = e.join(two.withColumnRenamed("n", "a"), "a", "left_semi").join(two.withColumnRenamed("n", "b"), "b", "left_semi")
    c = components(inner)
    return two.select(F.col("n").alias("node")).join(c, "node", "left").select("node", F.coalesce("root", "node").alias("chain"))


def crossing_walks(records: DataFrame, seeds: DataFrame, hops: int, least: float, most: float, order) -> DataFrame:
    """start, walk: from each seed ``hops`` crossings onto tracks that the walk has not met; walks that cannot go on are left out.

    ``records`` (src, dst, self_local, partner_local): both directions of each crossing. On a track that a walk came to, it
    leaves between ``least`` and ``most`` steps from where it came. Of the records that fit, the first by ``order`` (a
    column of src and dst) is taken, then by dst and places.
    """
    w = seeds.select(F.col("node").alias("start"), F.array("node").alias("walk"), F.lit(None).cast(dict(records.dtypes)["partner_local"]).alias("entry"))
    for _ in range(hops):
        step = w.withColumn("src", F.element_at("walk", -1)).join(records, "src").where(~F.array_contains(F.col("walk"), F.col("dst")))
        step = step.where(F.col("entry").isNull() | F.abs(F.col("self_local") - F.col("entry")).between(least, most))
        first = F.min(F.struct(order.alias("o"), "dst", "self_local", "partner_local")).alias("n")
        step = step.groupBy("start").agg(first, F.first("walk").alias("walk"))
        w = cut_lineage(step.select("start", F.concat("walk", F.array("n.dst")).alias("walk"), F.col("n.partner_local").alias("entry")))
    return w.select("start", "walk")


def point_walks(points: DataFrame, track: str, cell: str, index: str, family: str, seeds: DataFrame, hops: int, least: float, most: float, order, chunk: int = 1024) -> DataFrame:
    """start, walk: ``crossing_walks`` over the crossings of points (``joins.crossing_events``), without a row for each crossing.

    ``order`` is a function of the columns src and dst. A walk goes to the cells of its track that fit, finds its first record
    among each cell's tracks, which lie there as arrays of at most ``chunk``, and comes back with that one alone.
    """
    tables = Tables(points.sparkSession, "point-walks")
    p = points.select(F.col(cell).alias("cell"), F.col(track).alias("src"), F.col(index).alias("i"), F.col(family).alias("f")).where("cell is not null and src is not null")
    p = tables.put(p.repartition("cell").groupBy("cell", "src").agg(F.min("i").alias("self_local"), F.min_by("f", "i").alias("fam")), "points")
    part = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("src")) - 1) / chunk)
    cells = p.withColumn("part", part).groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("src", "self_local", "fam"))).alias("t"))
    cells = tables.put(cells.select("cell", F.col("t.src").alias("dsts"), F.col("t.self_local").alias("locals"), F.col("t.fam").alias("fams")), "cells")
    w = seeds.select(F.col("node").alias("start"), F.array("node").alias("walk"), F.lit(None).cast(dict(p.dtypes)["self_local"]).alias("entry"))
    for hop in range(hops):
        step = w.withColumn("src", F.element_at("walk", -1)).join(p, "src")
        step = step.where(F.col("entry").isNull() | F.abs(F.col("self_local") - F.col("entry")).between(least, most)).drop("entry").join(cells, "cell")
        # A track is of its own family, so the first hop leaves nothing out. Arrays are in the order of dst: the first least one is the record.
        fits = lambda x, f: (f != F.col("fam")) & ~F.array_contains(F.col("walk"), x) if hop else f != F.col("fam")  # noqa: B023, E731
        ranks = F.zip_with("dsts", "fams", lambda x, f: F.when(fits(x, f), order(F.col("src"), x)))  # noqa: B023
        step = step.select("start", "walk", "self_local", "dsts", "locals", F.inline(F.array(F.struct(ranks.alias("os")))))
        step = step.select("start", "walk", "self_local", "dsts", "locals", F.array_min("os").alias("o"), (F.array_position("os", F.array_min("os")) - 1).cast("int").alias("k")).where("o is not null")
        step = step.select("start", F.struct("o", F.get("dsts", F.col("k")).alias("dst"), "self_local", F.get("locals", F.col("k")).alias("partner_local")).alias("n"), "walk")
        step = step.repartition("start").groupBy("start").agg(F.min(F.struct("n", "walk")).alias("b"))
        w = tables.put(step.select("start", F.concat("b.walk", F.array("b.n.dst")).alias("walk"), F.col("b.n.partner_local").alias("entry")), f"walks-{hop}")
    return w.select("start", "walk")


def gated_walks(records: DataFrame, seeds: DataFrame, steps: int, least_travel: float, order, most_tracks: int = 4) -> DataFrame:
    """start, walk: up to ``steps`` steps, each onto a track from which the walk could still return to its start.

    ``records`` (src, dst, position on src): one for each ordered pair. A candidate passes if a cycle of at most
    ``most_tracks`` tracks closes through it: start ... current, candidate, and on to the start over tracks not met yet,
    leaving the candidate ``least_travel`` or more from where it was entered. Of the candidates that pass, the first by
    ``order`` (a column of src and dst), then dst, is taken; a walk without one ends.
    """
    tables = Tables(records.sparkSession, "walks")
    w = seeds.select(F.col("node").alias("start"), F.array("node").alias("walk"))
    for step in range(1, steps + 1):
        if step + 1 > most_tracks:
            break
        current = w.where(F.size("walk") == step).withColumn("src", F.element_at("walk", -1))
        c = current.join(records.select("src", F.col("dst").alias("c")), "src").where(~F.array_contains(F.col("walk"), F.col("c")))
        entry = records.select(F.col("src").alias("c"), F.col("dst").alias("src"), F.col("position").alias("entry"))
        candidates = tables.put(c.join(entry, ["c", "src"]), f"candidates-{step}")
        ok = returning(records, candidates, least_travel, most_tracks - step, tables, f"{step}")
        ok = ok.withColumnRenamed("c", "dst").groupBy("start").agg(F.min(F.struct(order.alias("o"), "dst")).alias("n"))
        w = w.join(ok, "start", "left").select("start", F.when((F.size("walk") == step) & F.col("n").isNotNull(), F.concat("walk", F.array("n.dst"))).otherwise(F.col("walk")).alias("walk"))
        w = tables.put(w, f"walks-{step}")
    return w


def returning(records: DataFrame, candidates: DataFrame, least_travel: float, hops: int, tables: Tables, name: str) -> DataFrame:
    """start, src, c of the ``candidates`` (start, walk, src, c, entry) from which a simple path of at most ``hops`` hops leads to the start.

    A path keeps off the walk, and leaves c ``least_travel`` or more from the entry. It is looked for from both ends: paths of half
    the hops on from the candidates, and back from the starts, meet in a track that both end in. So a search of n hops makes
    paths of n / 2; a candidate that has its path is not searched further.
    """
    out, way = records.select(F.col("src").alias("end"), F.col("dst").alias("next"), "position"), records.select(F.col("dst").alias("end"), F.col("src").alias("next"))
    keys = ["start", "src", "c"]
    on = candidates.select(*keys, "walk", "entry", F.col("c").alias("end"), F.array("c").alias("path"))
    back = candidates.select("start", "walk").distinct().select("start", "walk", F.col("start").alias("end"), F.array().cast(dict(candidates.dtypes)["walk"]).alias("far"))
    found = None
    for hop in range(1, hops + 1):
        if hop % 2:
            # One hop on; the first one leaves the candidate far enough from where it was entered.
            far = F.abs(F.col("position") - F.col("entry")) >= least_travel if hop == 1 else F.lit(True)
            fresh = ~F.array_contains(F.col("path"), F.col("next")) & (~F.array_contains(F.col("walk"), F.col("next")) | (F.col("next") == F.col("start")))
            on = on.join(out, "end").where(far & fresh).select(*keys, "walk", "entry", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
            on = tables.put(on, f"on-{name}-{hop}")
            if hop > 1:
                on = on.where("end != start")
        else:
            back = back.join(way, "end").where(~F.array_contains(F.col("walk"), F.col("next")) & ~F.array_contains(F.col("far"), F.col("next")))
            back = tables.put(back.select("start", "walk", F.col("next").alias("end"), F.concat("far", F.array("next")).alias("far")), f"back-{name}-{hop}")
        if hop == 1:
            new = on.where("end = start").select(*keys)
            on = on.where("end != start")
        else:
            meet = on.join(back.select("start", "end", "far"), ["start", "end"])
            new = meet.where(F.size(F.array_intersect("path", "far")) == 1).select(*keys)
        found = new.distinct() if found is None else found.unionByName(new.distinct())
        found = tables.put(found.distinct(), f"found-{name}-{hop}")
        on = on.join(found, keys, "left_anti")
    return found


def layout_slots(tree: DataFrame) -> DataFrame:
    """A slot within each depth, ordered by the parent, then the node."""
    return tree.withColumn("slot", F.row_number().over(Window.partitionBy("depth").orderBy("parent", "node")) - 1)
