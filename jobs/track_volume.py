"""Job: a label volume of tracks, slab by slab; a rerun makes only the slabs whose points have changed.

A track is an order: its lines, by line number, are points at z = ship day, y = quantity, x = discount in percent, in voxels
of a given size. Lines between the points are rasterised without gaps; a voxel has the label of the least track in it
(1 + track % labels) and how many tracks cross it.

    python -m jobs.track_volume --lines FILE --out DIR [--config jobs/track_volume.json] [--slabs LO HI]

``--lines`` is Parquet with l_orderkey, l_linenumber, l_shipdate, l_quantity, l_discount. Under ``--out``:

    voxels/slab=K   z, y, x, label, track, tracks
    ledger/slab=K   segments, digest, settings, voxels: what the slab was made of

A slab's ledger row has the number and a digest of the segments that touch it, and the settings. A run compares them with
the input as it is now, and rasterises only segments that touch slabs that differ (all of them at first); ``--slabs`` leaves those outside [LO, HI)
as they are. Voxels are written first, the ledger after them, both by dynamic partition overwrite: a run that broke off
leaves slabs that the next one makes again, with the same rows. A slab that has lost all its segments gets a ledger row of none,
and ``volume`` leaves its old voxels out. Lines with a null in a column that is read are no points.
"""

from __future__ import annotations

import argparse
import itertools
import json
import logging
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.expr import half_even
from spanloom.operators.ragged import over
from spanloom.sources.files import settings_key

LOG = logging.getLogger("track_volume")
CONFIG = Path(__file__).with_suffix(".json")
VOXELS = "z bigint, y bigint, x bigint, label bigint, track bigint, tracks bigint, slab bigint"
LEDGER = "segments bigint, digest bigint, settings string, voxels bigint, slab bigint"
_AXES = ("z", "y", "x")
#: Steps along segments that a task holds at a time, beyond those of one track.
AT_ONCE = 1 << 22
#: Steps that are made at a time, beyond those of one segment: few enough for a processor's cache.
BLOCK = 1 << 14
#: Voxels with their counts that a task holds, beyond those of ``AT_ONCE`` steps.
HELD = 1 << 20


def configured(path: str | Path = CONFIG) -> dict:
    """voxel: size of a voxel in days, units and percent; slab: its depth in voxels; labels: how many."""
    return json.loads(Path(path).read_text())


def points(lines: DataFrame, config: dict) -> DataFrame:
    """track, pos, z, y, x (in voxels)."""
    place = (F.datediff("l_shipdate", F.lit("1970-01-01")), F.col("l_quantity"), F.col("l_discount") * 100)
    p = lines.select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("pos"), *[(c.cast("double") / size).alias(a) for a, c, size in zip(_AXES, place, config["voxel"], strict=True)])
    return p.dropna()


def segments(points: DataFrame) -> DataFrame:
    """track, from (p_z, p_y, p_x) and to (z, y, x), and n, the steps in between: a track's first point is a segment of its own.

    A window over one track, of few points.
    """
    w = over("track", ["pos", *_AXES])
    s = points
    for a in _AXES:
        s = s.withColumn(f"p_{a}", F.coalesce(F.lag(a).over(w), a))
    return s.withColumn("n", F.ceil(F.greatest(*[F.abs(F.col(a) - F.col(f"p_{a}")) for a in _AXES])))


def _slabs(config: dict):
    """The first and the last slab that a segment touches."""
    slab = lambda c: F.floor(half_even(c) / config["slab"]).cast("long")
    return slab(F.least("z", "p_z")), slab(F.greatest("z", "p_z"))


def inputs(segments: DataFrame, config: dict) -> DataFrame:
    """slab, segments, digest: what each slab is made of. Segments that touch the same slabs are counted before they are dealt to them."""
    lo, hi = _slabs(config)
    some = segments.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("segments"), F.bit_xor(F.xxhash64("track", "pos", *_AXES, *[f"p_{a}" for a in _AXES])).alias("digest"))
    each = some.select(F.explode(F.sequence("lo", "hi")).alias("slab"), "segments", "digest")
    return each.groupBy("slab").agg(F.sum("segments").alias("segments"), F.bit_xor("digest").alias("digest"))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z, y, x, the least track and how many, of some whole tracks at a time. Segments come track by track."""
    parts, rows = [], 0
    for s in _whole_tracks(batches):
        parts.append(_counted(s))
        rows += parts[-1].num_rows
        if rows > HELD:
            parts = _merged(parts)
            rows = sum(p.num_rows for p in parts)
            if rows > HELD // 2:
                yield from parts
                parts, rows = [], 0
    yield from _merged(parts)


def _merged(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """A row for each voxel of some counts of different tracks."""
    if len(parts) < 2:
        return parts
    g = pa.Table.from_batches(parts).group_by(list(_AXES), use_threads=False).aggregate([("track", "min"), ("tracks", "sum")])
    return g.select([*_AXES, "track_min", "tracks_sum"]).rename_columns([*_AXES, "track", "tracks"]).combine_chunks().to_batches()


def _whole_tracks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The segments of some whole tracks at a time, of about ``AT_ONCE`` steps."""
    held, steps, enough = [], 0, AT_ONCE
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            steps += int(held[-1]["n"].sum()) + batch.num_rows
            if steps < enough:
                continue
        if not steps:
            continue
        s = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        starts = np.append(np.flatnonzero(s["first"]), len(s["n"]))
        upto = np.concatenate([[0], np.cumsum(s["n"] + 1)])[starts]
        # The last track may go on in the next batch.
        begin, known = 0, len(starts) - (1 if batch is None else 2)
        while begin < known and (batch is None or upto[known] - upto[begin] >= AT_ONCE):
            end = min(known, max(begin + 1, int(np.searchsorted(upto, upto[begin] + AT_ONCE, side="right")) - 1))
            yield {c: v[starts[begin] : starts[end]] for c, v in s.items()}
            begin = end
        held, steps = [{c: v[starts[begin] :] for c, v in s.items()}], int(upto[-1] - upto[begin])
        enough = max(AT_ONCE, 2 * steps)


def _counted(s: dict[str, np.ndarray]) -> pa.RecordBatch:
    """z, y, x, the least track and how many, of the segments of whole tracks."""
    ids, rank = np.unique(s["track"], return_inverse=True)
    order = np.argsort(s["n"], kind="stable")
    s = {c: v[order] for c, v in s.items()}
    s["rank"] = rank[order].astype("float64")
    # A voxel of each step, once a track, in the order of voxels, then tracks. One number has both, where it is exact; no step
    # rounds to a voxel beyond one around what is between the ends.
    bits = len(ids).bit_length()
    low = [float(np.floor(min(s[a].min(), s[f"p_{a}"].min()))) - 1 for a in _AXES]
    high = [float(np.ceil(max(s[a].max(), s[f"p_{a}"].max()))) + 1 for a in _AXES]
    size = [int(hi - lo) + 1 for lo, hi in zip(low, high, strict=True)]
    reach = [max(n, abs(int(lo)), abs(int(hi))) + 1 for n, lo, hi in zip(size, low, high, strict=True)]
    if math.prod(reach) << bits < 1 << 50:
        each = np.empty(int((s["n"] + 1).sum()), "int32" if math.prod(size) << bits < 1 << 31 else "int64")
        zero, at = ((low[0] * size[1] + low[1]) * size[2] + low[2]) * (1 << bits), 0
        for rank, (packed, y, x) in _stepped(s):
            packed *= size[1]
            packed += y
            packed *= size[2]
            packed += x
            packed *= 1 << bits
            np.add(packed, rank - zero, out=each[at : at + packed.size].reshape(packed.shape), casting="unsafe")
            at += packed.size
        each.sort()
        each = each[np.concatenate([[True], each[1:] != each[:-1]])]
        voxel = each >> bits
        first = np.flatnonzero(np.concatenate([[True], voxel[1:] != voxel[:-1]]))
        least, packed, out = each[first] & ((1 << bits) - 1), voxel[first].astype("int64"), []
        for lo, n in zip(low[::-1], size[::-1], strict=True):
            packed, c = np.divmod(packed, n)
            out.append(c + int(lo))
        out, met = out[::-1], len(voxel)
    else:
        parts = [[c.ravel().astype("int64") for c in (*cells, np.broadcast_to(rank, cells[0].shape))] for rank, cells in _stepped(s)]
        each = _distinct([np.concatenate(c) for c in zip(*parts, strict=True)])
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in each[:3]], axis=0)]))
        least, out, met = each[3][first], [c[first] for c in each[:3]], len(each[0])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*out, ids[least], np.diff(np.append(first, met)))], names=[*_AXES, "track", "tracks"])


def _stepped(s: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Some segments with one number of steps at a time: their ranks as a column, and their steps' z, y, x in rows, until the next are made."""
    n, at = s["n"], 0
    room = np.empty((len(_AXES), max(BLOCK, int(n[-1]) + 1)))
    while at < len(n):
        m = int(n[at])
        end = min(int(np.searchsorted(n, m, side="right")), at + max(1, BLOCK // (m + 1)))
        k, cells = np.arange(m + 1, dtype="float64"), []
        for a, flat in zip(_AXES, room, strict=True):
            p, c = s[f"p_{a}"][at:end, None], flat[: (end - at) * (m + 1)].reshape(end - at, m + 1)
            np.multiply(s[a][at:end, None] - p, k, out=c)
            c /= max(m, 1)
            c += p
            cells.append(np.rint(c, out=c))
        yield s["rank"][at:end, None], cells
        at = end


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows of whole numbers, in order."""
    low = [int(c.min()) for c in columns]
    size = [int(c.max()) - lo + 1 for c, lo in zip(columns, low, strict=True)]
    if math.prod(size) >= 1 << 62:
        return list(np.unique(np.stack(columns, axis=1), axis=0).T)
    packed = np.zeros(len(columns[0]), "int64")
    for c, lo, n in zip(columns, low, size, strict=True):
        packed = packed * n + (c - lo)
    packed, out = np.unique(packed), []
    for lo, n in zip(low[::-1], size[::-1], strict=True):
        packed, c = np.divmod(packed, n)
        out.append(c + lo)
    return out[::-1]


def voxels(segments: DataFrame, config: dict) -> DataFrame:
    """Rows of VOXELS of whole segments; one that comes twice counts once.

    A track's segments lie in one task, in a row, so that its voxels are told apart in the task that makes them, and what is
    shuffled are counts of voxels, not the voxels of tracks.
    """
    w = over("track", ["pos", *_AXES])
    tracks = segments.withColumn("track", F.col("track").cast("long")).withColumn("first", F.row_number().over(w) == 1)
    each = tracks.select("track", "first", *[f"p_{a}" for a in _AXES], *_AXES, "n").mapInArrow(_crossed, "z bigint, y bigint, x bigint, track bigint, tracks bigint")
    out = each.groupBy(*_AXES).agg(F.min("track").alias("track"), F.sum("tracks").alias("tracks"))
    return out.select(*_AXES, (1 + F.col("track") % config["labels"]).alias("label"), "track", "tracks", F.floor(F.col("z") / config["slab"]).cast("long").alias("slab"))


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as it is now; without rows if it was never written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replaces the slabs that ``rows`` has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(path)


def run(spark: SparkSession, lines: str, out: str, config: dict | None = None, slabs: tuple[int, int] | None = None) -> dict:
    """Makes the slabs that are not there or not current; how many there are, were made, and their voxels."""
    config, out = config or configured(), out.rstrip("/")
    settings = settings_key(**config)
    every = segments(points(spark.read.parquet(lines), config))
    now = inputs(every, config).withColumn("settings", F.lit(settings))
    old = _written(spark, f"{out}/ledger", LEDGER)
    # The ledger has a row for each slab: a table of the volume's depth, not of its points.
    both = now.alias("now").join(old.alias("old"), "slab", "full_outer")
    same = F.col("now.segments").eqNullSafe(F.col("old.segments")) & F.col("now.digest").eqNullSafe(F.col("old.digest")) & (F.col("old.settings") == settings)
    gone = F.col("now.segments").isNull() & (F.col("old.segments") == 0)
    stale = ~F.coalesce(same | gone, F.lit(False))
    if slabs:
        stale = stale & (F.col("slab") >= slabs[0]) & (F.col("slab") < slabs[1])
    # Written, since the ledger that it is made of is written below, and all segments are read for it.
    plan = f"{out}/plan"
    both.select("slab", F.coalesce("now.segments", F.lit(0)).cast("long").alias("segments"), F.coalesce("now.digest", F.lit(0)).cast("long").alias("digest"), stale.alias("stale")).write.mode("overwrite").parquet(plan)
    planned = spark.read.schema("slab bigint, segments bigint, digest bigint, stale boolean").parquet(plan)
    stale = planned.where("stale").drop("stale")
    depth, todo, kept = planned.agg(F.expr("count_if(segments > 0)"), F.expr("count_if(stale)"), F.expr("count_if(segments > 0 and not stale)")).first()
    LOG.info("%s: %d slabs, %d of them to make", lines, depth, todo)
    if todo == 0:
        return {"slabs": depth, "made": 0, "voxels": 0}
    met = every
    if kept:
        lo, hi = _slabs(config)
        met = every.withColumn("slab", F.explode(F.sequence(lo, hi))).join(stale.select("slab"), "slab", "left_semi").drop("slab").dropDuplicates()
    _overwrite(voxels(met, config).join(stale.select("slab"), "slab", "left_semi"), f"{out}/voxels")
    made = _written(spark, f"{out}/voxels", VOXELS).join(stale.where("segments > 0"), "slab", "left_semi").groupBy("slab").agg(F.count("*").alias("voxels"))
    ledger = stale.join(made, "slab", "left").select("segments", "digest", F.lit(settings).alias("settings"), F.coalesce("voxels", F.lit(0)).cast("long").alias("voxels"), "slab")
    _overwrite(ledger, f"{out}/ledger")
    done = {"slabs": depth, "made": todo, "voxels": _written(spark, f"{out}/ledger", LEDGER).join(stale.select("slab"), "slab", "left_semi").agg(F.sum("voxels")).first()[0]}
    LOG.info("%(made)d slabs with %(voxels)d voxels written", done)
    return done


def volume(spark: SparkSession, out: str) -> DataFrame:
    """All voxels of the slabs that the ledger knows."""
    ledger = _written(spark, f"{out}/ledger", LEDGER).where("segments > 0")
    return _written(spark, f"{out}/voxels", VOXELS).join(ledger.select("slab"), "slab", "left_semi")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--lines", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--slabs", nargs=2, type=int, metavar=("LO", "HI"))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("track_volume").getOrCreate()
    try:
        run(spark, args.lines, args.out, configured(args.config), tuple(args.slabs) if args.slabs else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
