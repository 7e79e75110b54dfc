"""Surfaces stored as image folders (z, y, x and further planes as TIFF, a JSON of metadata), key-value stores, layouts, bricks."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags and types of the TIFF format. Fixed values.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIP_AT, _SAMPLES, _ROWS, _STRIP_SIZE, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_AT, _TILE_SIZE, _FORMAT = 322, 323, 324, 325, 339
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
_NONE, _LZW, _DEFLATE, _PACKBITS, _OLD_DEFLATE = 1, 5, 8, 32773, 32946


def write_tiff(a: np.ndarray) -> bytes:
    """A single plane of numbers, uncompressed, in one strip."""
    a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
    kind = {"f": 3, "i": 2, "u": 1}[a.dtype.kind]
    tags = [(_WIDTH, 4, a.shape[1]), (_HEIGHT, 4, a.shape[0]), (_BITS, 3, 8 * a.itemsize), (_COMPRESSION, 3, _NONE), (_PHOTOMETRIC, 3, 1)]
    tags += [(_STRIP_AT, 4, 0), (_SAMPLES, 3, 1), (_ROWS, 4, a.shape[0]), (_STRIP_SIZE, 4, a.nbytes), (_FORMAT, 3, kind)]
    begin = 8 + 2 + 12 * len(tags) + 4
    body = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", begin if t == _STRIP_AT else v)) for t, k, v in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + body + struct.pack("<I", 0) + a.tobytes()


def _unpacked_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def _unpacked_lzw(data: bytes) -> bytes:
    out, bits, have, at, width, table, last = bytearray(), 0, 0, 0, 9, [], b""
    while at < len(data) or have >= width:
        while have < width and at < len(data):
            bits, have, at = bits << 8 | data[at], have + 8, at + 1
        if have < width:
            break
        code = bits >> (have - width)
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def read_tiff(data: bytes) -> np.ndarray:
    """The first image of a TIFF file, (height, width) or with samples last: strips or tiles; plain, deflate, LZW or PackBits; with or without differences."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    (count,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {}
    for k in range(count):
        tag, kind, n, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind in _TYPES:
            letter, size = _TYPES[kind]
            raw = value if n * size <= 4 else data[(o := struct.unpack(order + "I", value)[0]) : o + n * size]
            tags[tag] = struct.unpack(f"{order}{n}{letter}", raw[: n * size])
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1), one(_BITS, 1)
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(_FORMAT, 1)]}{bits // 8}")
    unpack = {_NONE: bytes, _LZW: _unpacked_lzw, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress, _PACKBITS: _unpacked_bits}.get(one(_COMPRESSION, 1))
    if unpack is None or bits % 8:
        raise ValueError("a TIFF file of this compression or depth is not read")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    if _TILE_AT in tags:
        w, h, places, sizes = one(_TILE_WIDTH), one(_TILE_HEIGHT), tags[_TILE_AT], tags[_TILE_SIZE]
    else:
        w, h, places, sizes = width, one(_ROWS, height), tags[_STRIP_AT], tags[_STRIP_SIZE]
    across = -(-width // w)
    for k, (o, n) in enumerate(zip(places, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if _TILE_AT in tags else min(h, height - y)
        part = np.frombuffer(unpack(data[o : o + n]), dtype, rows * w * samples).reshape(rows, w, samples)
        if one(_PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y : y + rows, x : x + w] = part[: height - y, : width - x]
    return out[:, :, 0] if samples == 1 else out


def surfaces(spark: SparkSession, path: str) -> DataFrame:
    """surface (its folder's name), i, j, z, y, x, winding: the valid vertices of all image folders under ``path``.

    A vertex is invalid where all coordinates are -1, or where a mask plane is 0. Folders without all three planes, and those
    whose planes differ in size, give none. Without a winding plane, or where it is 0 or NaN, winding is null. A folder is one
    group: a surface's planes are read whole, as the format has them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    part = F.split("path", "/")
    files = files.select(F.element_at(part, -2).alias("surface"), F.element_at(part, -1).alias("plane"), "content").where(F.col("plane").isin("z.tif", "y.tif", "x.tif", "mask.tif", "winding.tif"))

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        planes = {p[:-4]: read_tiff(c) for p, c in zip(rows["plane"], rows["content"], strict=True)}
        none = pd.DataFrame({c: [] for c in ("surface", "i", "j", "z", "y", "x", "winding")}, dtype=object)
        if not {"z", "y", "x"} <= planes.keys() or len({planes[c].shape[:2] for c in "zyx"}) > 1:
            return none
        grid = np.stack([planes[c].astype(np.float64) for c in "zyx"], axis=-1)
        valid = np.any(grid != -1, axis=-1)
        if "mask" in planes:
            valid &= (planes["mask"] if planes["mask"].ndim == 2 else planes["mask"][..., 0]) != 0
        i, j = np.nonzero(valid)
        winding = planes["winding"][i, j].astype(np.float64) if "winding" in planes else np.zeros(len(i))
        turns = [None if w == 0 or np.isnan(w) else w for w in winding.tolist()]
        return pd.DataFrame({"surface": rows["surface"].iloc[0], "i": i, "j": j, "z": grid[i, j, 0], "y": grid[i, j, 1], "x": grid[i, j, 2], "winding": pd.Series(turns, dtype=object)})

    return files.groupBy("surface").applyInPandas(decode, "surface string, i bigint, j bigint, z double, y double, x double, winding double")


def write_surfaces(vertices: DataFrame, path: str, step: float, voxel_um: float, source: str, provenance: dict | None = None) -> DataFrame:
    """Writes each surface (surface, i, j, z, y, x) as an image folder; what was written: surface, rows, columns, quads, area, low, high.

    Planes are 32-bit, -1 where there is no vertex, from the least i and j on; the metadata hold scale, bounds, the area of the
    valid quads and ``provenance``. A folder is written beside its place and then moved there: it is never half there.
    Executors write to ``path``, a URI that they all reach.
    """
    more = dict(provenance or {})

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as fs

        name = str(rows["surface"].iloc[0])
        i, j = (rows[c].to_numpy(int) - rows[c].min() for c in "ij")
        grid = np.full((i.max() + 1, j.max() + 1, 3), -1.0, np.float32)
        grid[i, j] = rows[list("zyx")].to_numpy(np.float32)
        valid = np.any(grid != -1, axis=-1)
        quads = int((valid[:-1, :-1] & valid[1:, :-1] & valid[:-1, 1:] & valid[1:, 1:]).sum())
        low, high = (getattr(grid[valid], f)(axis=0)[::-1].tolist() for f in ("min", "max"))
        area = quads * step**2
        meta = {"scale": [1 / step, 1 / step], "bbox": [low, high], "area_vx2": area, "area_cm2": area * voxel_um**2 / 1e8, "format": "tifxyz", "type": "seg", "uuid": name, "source": source, **more}
        system, root = fs.FileSystem.from_uri(path)
        staged = f"{root}/.{name}.new"
        system.create_dir(staged, recursive=True)
        planes = {f"{c}.tif": write_tiff(grid[..., k]) for k, c in enumerate("zyx")}
        for file, content in {**planes, "meta.json": json.dumps(meta, indent=1).encode()}.items():
            with system.open_output_stream(f"{staged}/{file}") as out:
                out.write(content)
        if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{name}")
        system.move(staged, f"{root}/{name}")
        return pd.DataFrame({"surface": [name], "rows": [grid.shape[0]], "columns": [grid.shape[1]], "quads": [quads], "area": [float(area)], "low": [low], "high": [high]})

    done = vertices.select("surface", "i", "j", "z", "y", "x").groupBy("surface").applyInPandas(write, "surface string, rows bigint, columns bigint, quads bigint, area double, low array<double>, high array<double>")
    # Written once, here: the list of what was written must not write again when it is read.
    return done.sparkSession.createDataFrame(done.collect(), done.schema)


def dbm_records(spark: SparkSession, path: str, parts: int = 16) -> DataFrame:
    """ordinal, key, value: all records of a SQLite key-value store, numbered in the order of their keys.

    Read without a lock or side files. Tasks read ranges of the order; ``path`` must be a file that all executors reach.
    """

    def connect():
        import sqlite3

        return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)

    with connect() as c:
        (n,) = c.execute("SELECT count(*) FROM Dict").fetchone()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                lo, hi = n * k // parts, n * (k + 1) // parts
                with connect() as c:
                    rows = c.execute("SELECT key, value FROM Dict ORDER BY key LIMIT ? OFFSET ?", (hi - lo, lo)).fetchall()
                if rows:
                    yield pd.DataFrame({"ordinal": range(lo, hi), "key": [bytes(r[0]) for r in rows], "value": [bytes(r[1]) for r in rows]})

    return spark.range(0, parts, 1, parts).mapInPandas(read, "ordinal bigint, key binary, value binary")


def container_problems(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """path, problem: what is wrong with archives that hold a saved state: 'legacy' (no archive), 'corrupt' (its list or a record's
    checksum fails), 'missing: ...' (records, by the end of their names). Whole files give no row."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths).select("path", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if not content.startswith(b"PK"):
                    out.append((path, "legacy"))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        broken, names = z.testzip(), z.namelist()
                except (zipfile.BadZipFile, zlib.error, EOFError):
                    broken, names = "", []
                lost = [r for r in required if not any(n == r or n.endswith(f"/{r}") for n in names)]
                if broken is not None:
                    out.append((path, "corrupt"))
                elif lost:
                    out.append((path, f"missing: {', '.join(lost)}"))
            yield pd.DataFrame(out, columns=["path", "problem"], dtype=object)

    return files.mapInPandas(check, "path string, problem string")


def layout(spark: SparkSession, root: str, entries: list[tuple[str, str, bool]], one_of: dict[str, str] | None = None) -> DataFrame:
    """key, status, paths: what of a conventional layout (key, relative path, required) is under ``root``.

    'found', 'missing' (required) or 'absent'. ``one_of``: key -> glob of which exactly one must match; more are 'ambiguous',
    and all are listed.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for key, relative, required in entries:
        there = system.exists(jvm.org.apache.hadoop.fs.Path(base, relative))
        rows.append((key, "found" if there else "missing" if required else "absent", [relative] if there else []))
    for key, glob in (one_of or {}).items():
        found = sorted(s.getPath().toString().removeprefix(system.makeQualified(base).toString() + "/") for s in system.globStatus(jvm.org.apache.hadoop.fs.Path(base, glob)) or [])
        rows.append((key, "absent" if not found else "found" if len(found) == 1 else "ambiguous", found))
    return spark.createDataFrame(rows, "key string, status string, paths array<string>")


def fetched(spark: SparkSession, source: str, target: str) -> bool:
    """Copies ``source`` to ``target`` unless that is there; by way of a name beside it, so that it is never half there. Whether it was copied."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    there = at(target).getFileSystem(conf)
    if there.exists(at(target)):
        return False
    staged = at(target + ".part")
    jvm.org.apache.hadoop.fs.FileUtil.copy(at(source).getFileSystem(conf), at(source), there, staged, False, True, conf)
    return bool(there.rename(staged, at(target)))


def bricks(cells: DataFrame, coords: list[str], value: str, size: int) -> DataFrame:
    """c_* and data: dense bricks of size cells along each axis, row-major, 0 where there is no cell; bricks without cells are left out."""
    from ..operators.raster import chunk_of

    n = size ** len(coords)
    d = chunk_of(cells.where(F.col(value) != 0), coords, size)
    g = d.groupBy(*[f"c_{c}" for c in coords]).agg(F.array_sort(F.collect_list(F.struct(F.col("offset").cast("int").alias("at"), F.col(value).alias("v")))).alias("s"))
    zero = F.lit(0).cast(dict(cells.dtypes)[value])
    # Each cell with the zeros before it, and those after the last one: one pass, whatever the size.
    before = lambda i: F.coalesce(F.get("s", i - 1)["at"], F.lit(-1))
    runs = F.flatten(F.transform("s", lambda x, i: F.concat(F.array_repeat(zero, x["at"] - before(i) - 1), F.array(x["v"]))))
    data = F.concat(runs, F.array_repeat(zero, n - 1 - F.element_at("s", -1)["at"]))
    twice = F.exists(F.transform("s", lambda x, i: x["at"] == before(i)), lambda x: x)
    return g.select(*[f"c_{c}" for c in coords], F.when(twice, F.raise_error("a cell is there twice")).otherwise(data).alias("data"))


def wrong_bricks(packed: DataFrame, cells: DataFrame, coords: list[str], value: str, size: int, share: int, seed: str) -> DataFrame:
    """Of one in ``share`` bricks, chosen by a seeded hash, those that are not what the cells give now."""
    from ..functions.expr import stable_hash

    keys = [f"c_{c}" for c in coords]
    chosen = lambda df: df.where(stable_hash(*keys, seed=seed) % share == 0)
    return chosen(packed).exceptAll(chosen(bricks(cells, coords, value, size)))


def write_pyramid(cells: DataFrame, path: str, coords: list[str], value: str, levels: int, size: int) -> None:
    """A volume and its halvings (means without no-data, rounded half to even), one folder a level, partitioned by brick; bricks that are there stay."""
    from ..operators.aggs import pooled_mean
    from .files import write_new_partitions

    for level in range(levels):
        if level:
            cells = pooled_mean(cells, {c: F.floor(F.col(c) / 2) for c in coords}, value).where(F.col(value) != 0)
        packed = bricks(cells, coords, value, size)
        named = packed.withColumn("brick", F.concat_ws("_", *[F.col(f"c_{c}").cast("string") for c in coords]))
        write_new_partitions(named.select("brick", "data"), f"{path}/{level}", "brick")
