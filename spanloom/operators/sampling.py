"""Sampling that gives the same rows on every run: draws are hashes of (seed, id), not random numbers."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import stable_hash
from .ragged import numbered


def systematic(df: DataFrame, order: str, every: int, key: str | None = None) -> DataFrame:
    """Each ``every``-th row of each key (or of all), the first included."""
    if key is None:
        return numbered(df, [order], "rn").withColumn("rn", F.col("rn") + 1).where((F.col("rn") - 1) % every == 0)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where((F.col("rn") - 1) % every == 0)


def hash_sample(df: DataFrame, key: str, n: int, seed: str, by: str | None = None) -> DataFrame:
    """n rows, or n of each group, without replacement: those of least hash."""
    d = df.withColumn("h", stable_hash(key, seed=seed))
    if by is None:
        return d.orderBy("h", key).limit(n)
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("h", key))).where(F.col("rn") <= n)


def stratified_quota(df: DataFrame, group: str, key: str, n: int, seed: str, weights: dict | None = None) -> DataFrame:
    """n rows over the groups: whole shares first, then the largest remainders; a quota over its group repeats rows.

    ``weights``: by group; default: the same for all. A weight of 0 leaves a group out; a missing one is an error.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    if weights is None:
        w = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(table[F.col(group)], F.raise_error(F.lit("a group has no weight")).cast("double"))
    whole = Window.partitionBy()  # one row per group
    q = sizes.withColumn("w", w.cast("double")).where("w > 0")
    q = q.withColumn("share", F.col("w") * n / F.sum("w").over(whole)).withColumn("base", F.floor("share"))
    q = q.withColumn("left", n - F.sum("base").over(whole)).withColumn("rank", F.row_number().over(Window.orderBy(F.round(F.col("base") - F.col("share"), 9), group)))
    q = q.withColumn("quota", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).cast("long")).select(group, "size", "quota")
    d = df.withColumn("h", stable_hash(key, seed=seed)).withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("h", key)))
    d = d.join(q, group)
    copies = F.floor((F.col("quota") - F.col("rn")) / F.col("size")) + 1
    return d.withColumn("copies", copies.cast("long")).where("copies > 0 and rn <= quota").select(group, key, "quota", "copies")


def weighted_order(df: DataFrame, key: str, weight: str, n: int, seed: str, by: str) -> DataFrame:
    """n rows of each group without replacement, more likely the more they weigh: largest u ** (1 / w), as -log(u) / w ascending."""
    u = (stable_hash(key, seed=seed) + 1) / float(1 << 60)
    d = df.where(F.col(weight) > 0).withColumn("draw", F.round(-F.log(u) / F.col(weight), 12))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("draw", key))).where(F.col("rn") <= n)


def even_indices(n: Column, k: int) -> Column:
    """k of n places, evenly, ends included, rounded half to even."""
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i / (k - 1) * (n - 1)).cast("int")))


def block_representatives(df: DataFrame, cells: tuple[str, str], block: int, keys: list[str]) -> DataFrame:
    """Of each block of cells the one nearest to its centre, ties by place."""
    i, j = cells
    d = df.withColumn("bi", F.floor(F.col(i) / block)).withColumn("bj", F.floor(F.col(j) / block))
    far = F.pow(F.col(i) - (F.col("bi") * block + (block - 1) / 2), 2) + F.pow(F.col(j) - (F.col("bj") * block + (block - 1) / 2), 2)
    rest = [c for c in df.columns if c not in keys]
    return d.groupBy(*keys, "bi", "bj").agg(F.min_by(F.struct(*rest), F.struct(far, F.col(i), F.col(j))).alias("r")).select(*keys, "bi", "bj", "r.*")


def spaced_top_k(candidates: DataFrame, key: str, position: str, clearance: str, ident: str, k: int) -> DataFrame:
    """k of each key's candidates, far apart: the least position first, the farthest from it second, then again and again
    the one whose nearest chosen is farthest. k = 1: the clearest. Ties: more clearance, then the least id.

    Each choice is a partial aggregate over a join with those before it, k at most for a key: no key is gathered.
    """
    from .graph import cut_lineage

    c = candidates.select(key, F.col(position).cast("double").alias("p"), F.col(clearance).cast("double").alias("c"), F.col(ident).cast("long").alias("id"))
    item = F.struct("p", "c", "id")

    def first(score: Column) -> Column:
        return F.max_by(item, F.struct(score, "c", -F.col("id")))

    chosen = c.groupBy(key).agg(F.array(first(F.col("c") if k == 1 else -F.col("p"))).alias("chosen"))
    for _ in range(1, k):
        chosen = cut_lineage(chosen)
        left = c.join(chosen, key).where(~F.exists("chosen", lambda y: y["id"] == F.col("id")))
        gap = F.array_min(F.transform("chosen", lambda y: F.abs(F.col("p") - y["p"])))
        best = left.withColumn("gap", gap).groupBy(key).agg(first(F.col("gap")).alias("best"))
        chosen = chosen.join(best, key, "left").select(key, F.when(F.col("best").isNotNull(), F.concat("chosen", F.array("best"))).otherwise(F.col("chosen")).alias("chosen"))
    return chosen.select(key, F.posexplode("chosen").alias("rank", "x")).select(key, "rank", F.col("x.id").alias(ident), F.col("x.p").alias(position))


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str = "upto") -> DataFrame:
    """``df`` with the running sum of ``value`` over all rows in ``order``: tasks sum ranges of the rows, and what lies before a task is added."""
    from .graph import cut_lineage

    d = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    # One row a task: a small table, summed in one.
    sums = d.groupBy("__part").agg(F.sum(value).alias("__s"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__inside", inside).join(sums, "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """draw, key: ``n`` draws with replacement, likely by ``weight`` (whole numbers; others than positive are never drawn).

    A draw is a hash of seed and number, modulo the total; it takes the first row, by key, whose running sum is above it.
    """
    c = prefix_sums(df.where(F.col(weight) > 0).select(key, F.col(weight).cast("long").alias("w")), [key], "w")
    from .graph import cut_lineage

    c = cut_lineage(c)
    total = c.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("t")).first()[0]
    spark = df.sparkSession
    if total == 0:
        return spark.range(0).select(F.col("id").alias("draw")).join(df.select(key), F.lit(False))
    draws = spark.range(n).select(F.col("id").alias("draw"), (stable_hash("id", seed=seed) % total).alias("u"))
    # Rows are dealt to the stretches of the range of sums that they reach into, draws to the one that they fall in.
    width = max(1, total // 4096)
    stretch = lambda x: F.floor(x / width)
    c = c.withColumn("lo", F.col("upto") - F.col("w")).withColumn("__b", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("upto") - 1))))
    return draws.withColumn("__b", stretch(F.col("u"))).join(c, "__b").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("upto"))).select("draw", key)


def distant_endpoints(df: DataFrame, by: str, key: str, distance: str, n: int, seed: str) -> DataFrame:
    """by, key, rn: of each group's rows at least half as far as its farthest (and over 0), ``n`` drawn by the square of
    their distance, without replacement; a group with fewer gives its rows again and again, in their order of drawing."""
    far = df.where(F.col(distance) > 0)
    most = far.groupBy(by).agg(F.max(distance).alias("__most"))
    far = far.join(most, by).where(F.col(distance) >= 0.5 * F.col("__most")).withColumn("__w", F.pow(F.col(distance) / F.col("__most"), 2))
    d = weighted_order(far, key, "__w", n, seed, by)
    size = d.groupBy(by).agg(F.count("*").alias("__n"))
    again = F.sequence(F.col("rn"), F.lit(n).cast("int"), F.col("__n").cast("int"))
    return d.join(size, by).withColumn("rn", F.explode(again)).select(by, key, F.col("rn").cast("long").alias("rn"))


def diverse_seeds(df: DataFrame, key: str, length: str, coords: list[str], n: int, seed: str) -> DataFrame:
    """rank, key, coords: ``n`` of the rows in the top quarter by length. The first by a seeded hash; each next one, by the
    hash of its rank, of those whose distance to the nearest chosen is in the top quarter of what is left.

    A round is two aggregates; what is chosen, n rows, is all that the driver holds.
    """
    cut = F.percentile(F.col(length), 0.75)
    top = df.agg(cut.alias("__cut"))
    c = df.join(F.broadcast(top), F.col(length) >= F.col("__cut")).select(key, *coords)  # top is one row
    from .graph import cut_lineage

    c, chosen = cut_lineage(c), []
    while len(chosen) < n:
        left = c.where(~F.col(key).isin([r[key] for r in chosen])) if chosen else c
        if chosen:
            gaps = [F.sqrt(sum((F.pow(F.col(x) - F.lit(float(r[x])), 2) for x in coords), F.lit(0.0))) for r in chosen]
            left = left.withColumn("__gap", F.round(F.least(*gaps) if len(gaps) > 1 else gaps[0], 9))
            bar = left.agg(F.percentile("__gap", 0.75)).first()[0]
            left = left.where(F.col("__gap") >= F.lit(bar)) if bar is not None else left
        h = stable_hash(F.lit(len(chosen)), key, seed=seed)
        row = left.orderBy(h, key).select(key, *coords).first()
        if row is None:
            break
        chosen.append(row)
    kinds = dict(df.dtypes)
    schema = ", ".join(["rank bigint", f"{key} {kinds[key]}", *(f"{x} {kinds[x]}" for x in coords)])
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(chosen)], schema)


def eviction_plan(residents: DataFrame, wanted: DataFrame, key: str, stamp: str, capacity: int) -> DataFrame:
    """key, action: what a cache of ``capacity`` does for ``wanted`` keys: 'hit' those that are resident, 'load' the others, and
    'evict' for them, beyond its free places, the residents of least stamp that are not wanted (ties by key).

    More wanted than the capacity is an error.
    """
    w = wanted.select(key).distinct()
    r = residents.groupBy(key).agg(F.max(stamp).alias("__stamp"))
    j = w.join(r, key, "left").select(key, F.when(F.col("__stamp").isNull(), "load").otherwise("hit").alias("action"))
    n = j.agg(F.count("*").alias("n"), F.count(F.when(F.col("action") == "load", 1)).alias("new")).first()
    if n.n > capacity:
        raise ValueError(f"{n.n} keys are wanted, and the cache holds {capacity}")
    need = max(0, r.count() + n.new - capacity)
    out = r.join(w, key, "left_anti").orderBy("__stamp", key).limit(need)
    return j.unionByName(out.select(key, F.lit("evict").alias("action")))


def spatial_labels(cells: DataFrame, track: str, coords: list[str], labels: int, reach: int, seed: str) -> DataFrame:
    """track, label, forced: labels 1 to ``labels`` so that tracks with cells within ``reach`` of each other differ; reach 0: in one cell.

    Labels go around by the tracks' own order; a track whose label a neighbour has, that comes before it in a seeded order,
    takes the next one that none of these has. Where all are taken, it takes the one that the fewest of them have (then the
    least): forced.
    Each label waits for those before it nearby, so connected cells are walked in one task, in the order: its tracks stream
    by, and it keeps, for each cell, how many have which label (of a track with several cells, the track itself). Cells that
    are not connected are dealt to tasks.
    """
    from .graph import components, cut_lineage
    from .ragged import numbered
    from .raster import neighbours

    t = numbered(cells.select(track).distinct(), [track], "rank").withColumn("h", stable_hash(track, seed=seed))
    one = cut_lineage(cells.select(track, *coords).distinct().dropna(subset=coords))
    # A cell goes by its least track. Cells are connected that are near, or that one track has.
    rep = one.groupBy(*coords).agg(F.min(track).alias("a"))
    near = neighbours(rep, coords, reach).join(rep.withColumnRenamed("a", "b"), coords).select("a", "b")
    own = one.join(rep, coords).groupBy(track).agg(F.min("a").alias("a"), F.collect_set("a").alias("b"), F.collect_list(F.struct(*coords)).alias("at"))
    own = cut_lineage(own)
    c = components(near.unionByName(own.where(F.size("b") > 1).select("a", F.explode("b").alias("b"))))
    own = own.join(c.withColumnRenamed("node", "a"), "a", "left").select(track, F.coalesce("root", "a").alias("block"), "at")
    t = t.join(own, track, "left").select(F.coalesce("block", track).alias("block"), "h", track, "rank", "at")
    kind = t.select(track).schema.simpleString()[len("struct<") : -1]
    ordered = t.repartition("block").sortWithinPartitions("block", "h", track)
    return ordered.mapInArrow(_walked_labels(track, coords, labels, reach), f"{kind}, label bigint, forced boolean")


def _walked_labels(track: str, coords: list[str], labels: int, reach: int):
    """Labels the rows (block, track, rank, at) in their order, a block after the other."""
    moves = list(itertools.product(range(-reach, reach + 1), repeat=len(coords)))

    def run(batches):
        block, single, several = None, {}, {}
        for b in batches:
            at = b.column("at")
            places = list(zip(*[at.flatten().field(i).to_pylist() for i in range(len(coords))], strict=True))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)).tolist()
            found, forced, start = [], [], 0
            for its, who, rank, end in zip(b.column("block").to_pylist(), b.column(track).to_pylist(), b.column("rank").to_pylist(), ends, strict=True):
                mine, start = places[start:end], end
                if its != block:
                    block, single, several = its, {}, {}
                used, others = {}, {}
                for place in {tuple(map(sum, zip(p, m, strict=True))) for p in mine for m in moves}:
                    for label, n in single.get(place, {}).items():
                        used[label] = used.get(label, 0) + n
                    others.update(several.get(place, {}))
                for label in others.values():
                    used[label] = used.get(label, 0) + 1
                free = next((x for x in (1 + (rank + k) % labels for k in range(labels)) if x not in used), None)
                label = free or min((n, x) for x, n in used.items())[1]
                found.append(label)
                forced.append(free is None)
                if len(mine) == 1:
                    there = single.setdefault(mine[0], {})
                    there[label] = there.get(label, 0) + 1
                else:
                    for p in mine:
                        several.setdefault(p, {})[who] = label
            yield pa.RecordBatch.from_arrays([b.column(track), pa.array(found, pa.int64()), pa.array(forced, pa.bool_())], names=[track, "label", "forced"])

    return run


def strips(cells: DataFrame, keys: list[str], i: str, j: str, anchors: DataFrame, n: int, along: str) -> DataFrame:
    """anchor's columns, rank, i, j: ``n`` places of the cells' run through each anchor (keys, i, j) along one axis, evenly, ends included,
    rounded half to even; an anchor that is no cell has none."""
    across = i if along == j else j
    runs = cells.select(*keys, i, j).distinct()
    place = Window.partitionBy(*keys, across).orderBy(along)
    runs = runs.withColumn("__run", F.col(along) - F.row_number().over(place))
    ends = runs.groupBy(*keys, across, "__run").agg(F.min(along).alias("__lo"), F.max(along).alias("__hi"))
    own = anchors.columns
    a = anchors.join(ends, [*keys, across]).where(F.col(along).between(F.col("__lo"), F.col("__hi")))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * k / max(1, n - 1)).cast("long"))
    a = a.select(*[F.col(c).alias(f"__a_{c}") for c in own], *keys, F.col(across).alias("__across"), F.posexplode(at).alias("rank", "__at"))
    return a.select(*[F.col(f"__a_{c}").alias(f"anchor_{c}") for c in own], "rank", F.col("__across").alias(across), F.col("__at").alias(along))
