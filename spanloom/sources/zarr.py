"""Volumes as folders of chunk files beside a JSON of their shape: reading, and writing that goes on where it stopped."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    raise ValueError(f"a compressor is not read: {kind}")


def _document(spark: SparkSession, path: str) -> dict:
    """A JSON file whose name begins with a dot: Spark's own readers leave such files out."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def metadata(spark: SparkSession, path: str) -> dict:
    """The volume's JSON: shape, chunks, dtype, order, fill_value, compressor, dimension_separator."""
    return _document(spark, f"{path}/.zarray")


def levels(spark: SparkSession, path: str) -> DataFrame:
    """level, scale of a pyramid's group: what its datasets multiply coordinates by, along the first axis."""
    doc = _document(spark, f"{path}/.zattrs")
    rows = [(d["path"], float(d["coordinateTransformations"][0]["scale"][0])) for d in doc["multiscales"][0]["datasets"]]
    return spark.createDataFrame(rows, "level string, scale double")


def voxels(spark: SparkSession, path: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> DataFrame:
    """z, y, x, value: the volume's voxels that are not its fill value, of the half-open box [low, high) or of all.

    Only chunk files that the box meets are read. Absent chunks are fill value; chunks at the end are cut to the shape.
    """
    m = metadata(spark, path)
    shape, chunks, kind, fill = m["shape"], m["chunks"], np.dtype(m["dtype"]), m.get("fill_value") or 0
    box = tuple(low or (0, 0, 0)), tuple(min(h, s) for h, s in zip(high or shape, shape, strict=True))
    mark = m.get("dimension_separator", ".")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"(\d+)[./](\d+)[./](\d+)$", 0)
    at = F.split(name, f"[{'.' if mark == '.' else '/'}]")
    files = files.where(name != "").select(*[F.element_at(at, k + 1).cast("long").alias(f"c{k}") for k in range(3)], "content")
    for k in range(3):
        files = files.where((F.col(f"c{k}") * chunks[k] < box[1][k]) & ((F.col(f"c{k}") + 1) * chunks[k] > box[0][k]))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, c, content in batch.itertuples(index=False):
                v = np.frombuffer(_unpacked(content, m.get("compressor")), kind).reshape(chunks, order=m.get("order", "C"))
                first = np.array([a, b, c]) * chunks
                at = np.argwhere(v != fill)
                place = at + first
                inside = np.all((place >= box[0]) & (place < box[1]), axis=1)
                value = v[tuple(at[inside].T)].astype(np.float64)
                yield pd.DataFrame({"z": place[inside, 0], "y": place[inside, 1], "x": place[inside, 2], "value": value})

    return files.mapInPandas(decode, "z bigint, y bigint, x bigint, value double")


def write_volume(cells: DataFrame, path: str, shape: tuple[int, int, int], chunk: int, dtype: str = "<u2", value: str = "value") -> int:
    """Writes the chunks of ``cells`` (z, y, x, value) that are not there yet; how many were written.

    A chunk is written beside its place and then moved there, so one that is there is whole, and a run goes on where the last
    one stopped. Executors write to ``path``, a URI that they all reach. Cells outside of the shape are an error.
    """
    spark = cells.sparkSession
    doc = {"zarr_format": 2, "shape": list(shape), "chunks": [chunk] * 3, "dtype": dtype, "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": "zlib", "level": 1}, "dimension_separator": "."}
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(base)
    named = jvm.org.apache.hadoop.fs.Path(base, ".zarray")
    if not system.exists(named):
        out = system.create(named)
        out.write(bytearray(json.dumps(doc, indent=1).encode()))
        out.close()
    there = [s.getPath().getName() for s in system.listStatus(base)]
    done = spark.createDataFrame([(n,) for n in there], "chunk string")
    fits = (F.least("z", "y", "x") >= 0) & (F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2])
    cells = cells.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("a cell is outside of the volume")).cast("boolean")))
    part = lambda c: F.floor(F.col(c) / chunk).cast("string")
    todo = cells.where(F.col(value) != 0).withColumn("chunk", F.concat_ws(".", part("z"), part("y"), part("x"))).join(done, "chunk", "left_anti")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as fs

        name = rows["chunk"].iloc[0]
        v = np.zeros((chunk,) * 3, dtype)
        v[tuple(rows[c].to_numpy(int) % chunk for c in "zyx")] = rows[value].to_numpy()
        files, root = fs.FileSystem.from_uri(path)
        with files.open_output_stream(f"{root}/.{name}.new") as out:
            out.write(zlib.compress(v.tobytes(), 1))
        files.move(f"{root}/.{name}.new", f"{root}/{name}")
        return pd.DataFrame({"chunk": [name]})

    return todo.select("chunk", "z", "y", "x", value).groupBy("chunk").applyInPandas(write, "chunk string").agg(F.count("*")).first()[0]
