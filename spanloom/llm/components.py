"""Connected components of a distributed edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """k, m: of each u the least v. The key is made anew, so that a join on it deals both of its sides anew and its hot keys can be split."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.concat("u", F.lit(b"")).alias("k"), "m")


def _is_done(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root on another: then every root is its component's least node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """edges (a, b; binary) -> node, root: each node of an edge with the least node of its component.

    Large star: a node's larger neighbours are hung on the least of its neighbours and itself; small star: likewise its
    smaller ones. Rounds go on until the edges are stars; each ends in a written table. A node with very many neighbours
    is met by a partial aggregate and by a join that can be split. Loops and repeated edges count nothing; no edges: no rows.
    The result reads the last round's table in ``scratch``.
    """
    scratch, rounds = scratch or Scratch(edges.sparkSession, "components"), 0
    now = scratch.put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    while not _is_done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.put(large, f"{name}-{rounds}-large")
        hung = large.join(_least(large), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.groupBy("u").agg(F.min("v").alias("v"))
        small = scratch.put(hung.unionByName(kept).distinct(), f"{name}-{rounds + 1}")
        scratch.drop(f"{name}-{rounds}", f"{name}-{rounds}-large")
        now, rounds = small, rounds + 1
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
