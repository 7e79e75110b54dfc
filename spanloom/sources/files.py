"""Sources and sinks: point collections, fibres, axes, tables of tracks, resumable and staged writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ragged import numbered

#: Keys of the point collection format. Fixed values.
_POINT = "struct<p: array<double>, wind_a: double, creation_time: bigint>"
_COLLECTION = f"struct<name: string, points: map<string, {_POINT}>, metadata: map<string, string>, color: array<double>>"
_DOCUMENT = f"vc_pointcollections_json_version string, collections map<string, {_COLLECTION}>"


def point_collections(spark: SparkSession, *paths: str) -> DataFrame:
    """source_file, collection_id, name, point_id, z, y, x, winding: points of version "1" documents; others give no rows.

    Coordinates are x, y, z in the files and z, y, x here; a missing or NaN winding is null. Missing files are skipped.
    """
    docs = spark.read.schema(_DOCUMENT).option("multiLine", True).option("ignoreMissingFiles", True).option("allowNonNumericNumbers", True).json(list(paths)).withColumn("source_file", F.input_file_name())
    c = docs.where("vc_pointcollections_json_version = '1'").select("source_file", F.explode("collections").alias("collection_id", "c"))
    p = c.select("source_file", "collection_id", "c.name", F.explode("c.points").alias("point_id", "p"))
    axis = lambda i: F.get("p.p", F.lit(i))
    return p.select("source_file", F.col("collection_id").cast("bigint").alias("collection_id"), "name", F.col("point_id").cast("bigint").alias("point_id"), axis(2).alias("z"), axis(1).alias("y"), axis(0).alias("x"), F.when(~F.isnan("p.wind_a"), F.col("p.wind_a")).alias("winding"))


def fibres(spark: SparkSession, *paths: str, scale: float = 0.25) -> DataFrame:
    """source_file, name, tag, pos, z, y, x of fibres' control points, scaled; documents of other types or without points give none."""
    schema = "type string, name string, control_points array<array<double>>, line_points array<array<double>>, hv_classification struct<automatic_tag: string>"
    docs = spark.read.schema(schema).option("multiLine", True).json(list(paths)).withColumn("source_file", F.input_file_name())
    p = docs.where("control_points is not null").select("source_file", "name", F.col("hv_classification.automatic_tag").alias("tag"), F.posexplode("control_points").alias("pos", "p")).where("size(p) = 3")
    return p.select("source_file", "name", "tag", "pos", *[(F.get("p", F.lit(i)) * scale).alias(c) for i, c in ((2, "z"), (1, "y"), (0, "x"))])


def axis_points(spark: SparkSession, path: str) -> DataFrame:
    """z, y, x of an axis: a JSON array of points under "control_points" (x, y, z keys), or lines of "z, y, x" text."""
    if path.endswith(".json"):
        d = spark.read.schema("control_points array<struct<x: double, y: double, z: double>>").option("multiLine", True).json(path)
        return d.select(F.explode("control_points").alias("p")).select("p.z", "p.y", "p.x").orderBy("z")
    return spark.read.schema("z double, y double, x double").csv(path, ignoreLeadingWhiteSpace=True).orderBy("z")


def fingerprints(files: DataFrame) -> DataFrame:
    """name, size, modified of the files that a scan reads."""
    return files.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def is_current(files: DataFrame, manifest: DataFrame) -> bool:
    """Whether a scan's files are those that the manifest was written for."""
    now = fingerprints(files)
    return now.exceptAll(manifest).isEmpty() and manifest.exceptAll(now).isEmpty()


def write_tracks(points: DataFrame, path: str, track: str = "source_id") -> None:
    """One row per track, with its points in order and its bounds, ranged by z so that a scan of a slab skips files' row groups."""
    from ..operators.ragged import arclength_tortuosity

    t = points.groupBy(track).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.array_sort(F.collect_list(F.struct("pos", "z", "y", "x"))).alias("points"))
    t.join(arclength_tortuosity(points, track, "pos", ["z", "y", "x"]).drop("points"), track).repartitionByRange("z_min").sortWithinPartitions("z_min").write.mode("overwrite").parquet(path)


def tracks_within(spark: SparkSession, path: str, lo: float, hi: float) -> DataFrame:
    """Tracks with all points in [lo, hi); both bounds are pushed to the scan."""
    return spark.read.parquet(path).where((F.col("z_min") >= lo) & (F.col("z_max") < hi))


def slab_jobs(spark: SparkSession, lo: int, hi: int, stride: int, depth: int) -> DataFrame:
    """lo, hi of slabs that begin every ``stride`` and are ``depth`` deep, cut at the end."""
    return spark.range(lo, hi, stride).select(F.col("id").alias("lo"), F.least(F.col("id") + depth, F.lit(hi)).alias("hi"))


def appended_with_new_ids(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and, numbered on from its largest id in their own order, the rows of ``new``."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    fresh = numbered(new, [key], "rn").crossJoin(F.broadcast(top)).withColumn(key, (F.col("top") + F.col("rn") + 1).cast("long")).drop("rn", "top")  # top is one row
    return old.unionByName(fresh)


def write_new_partitions(df: DataFrame, path: str, key: str) -> None:
    """Appends only the partitions that are not there yet: a run goes on where the last one stopped."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    todo = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if there else df
    todo.write.mode("append").partitionBy(key).parquet(path)


def write_flat_metrics(df: DataFrame, path: str) -> None:
    """JSON with everything, and CSV with the columns that are not nested."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Wavefront text: valid vertices numbered from 1 in (i, j) order, and the faces whose four corners are valid."""
    v = numbered(vertices, ["i", "j"], "n").withColumn("n", F.col("n") + 1)
    corner = lambda a, b, s: v.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col("n").alias(s))
    f = faces.select("i", "j")
    for s, (a, b) in zip("abcd", ((0, 0), (0, 1), (1, 1), (1, 0)), strict=True):
        f = f.join(corner(a, b, s), ["i", "j"])
    lines = v.select(F.lit(0).alias("k"), F.col("n"), F.format_string("v %s %s %s", "x", "y", "z").alias("value"))
    lines = lines.unionByName(f.select(F.lit(1).alias("k"), F.col("a").alias("n"), F.format_string("f %d %d %d %d", "a", "b", "c", "d").alias("value")))
    lines.orderBy("k", "n").select("value").write.mode("overwrite").text(path)


def settings_key(**settings) -> str:
    """A name for a cached result: the digest of its settings, whatever their order."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def migrated_settings(old, renames: dict[str, str], known: list[str], defaults):
    """A struct of settings (renamed, known ones, defaults where absent) and unknown (names that no longer exist)."""
    name = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    fresh = F.transform_keys(old, lambda k, v: F.coalesce(name[k], k))
    kept = F.map_filter(fresh, lambda k, v: k.isin(*known))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(kept, k))
    unknown = F.filter(F.map_keys(fresh), lambda k: ~k.isin(*known))
    return F.struct(F.map_concat(kept, missing).alias("settings"), unknown.alias("unknown"))


def surface_index(spark: SparkSession, path: str) -> DataFrame:
    """name, scale, area, bad: surfaces' meta.json files of the one known format; files that are no JSON are marked, not dropped."""
    schema = "format string, uuid string, scale array<double>, area_vx2 double, _corrupt_record string"
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(path)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    d = d.select(F.coalesce("uuid", folder).alias("name"), "scale", F.col("area_vx2").alias("area"), "format", F.col("_corrupt_record").isNotNull().alias("bad"))
    return d.where("format = 'tifxyz' or bad").drop("format")


def write_report(df: DataFrame, path: str, title: str, rows: int = 200) -> None:
    """A page of text markup with the first ``rows`` rows: a bounded table for people, made on the driver."""
    import html

    cells = lambda tag, r: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in r)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in df.limit(rows).collect())
    page = f"<!DOCTYPE html><title>{html.escape(title)}</title><table><tr>{cells('th', df.columns)}</tr>{body}</table>"
    df.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
