"""Image folders, key-value stores, bricks and loss maps on small cases."""

import json
import pickle
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from spanloom.operators import lossmaps
from spanloom.sources import images


def tiff(a, compression, pack, tile=None, order="<", predictor=1):
    """A plain writer of strips of 3 rows, or tiles."""
    h, w = a.shape
    if predictor == 2:
        a = np.diff(a, axis=1, prepend=np.zeros((h, 1), a.dtype))
    if tile:
        parts = []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                t = np.zeros((tile, tile), a.dtype)
                t[: min(tile, h - y), : min(tile, w - x)] = a[y : y + tile, x : x + tile]
                parts.append(t)
    else:
        parts = [a[y : y + 3] for y in range(0, h, 3)]
    data = [pack(p.astype(p.dtype.newbyteorder(order)).tobytes()) for p in parts]
    tags = [(256, w), (257, h), (258, 8 * a.itemsize), (259, compression), (277, 1), (339, {"u": 1, "i": 2, "f": 3}[a.dtype.kind]), (317, predictor)]
    tags += [(322, tile), (323, tile)] if tile else [(278, 3)]
    n = len(tags) + 2
    begin = 8 + 2 + 12 * n + 4 + 8 * len(data)
    at, out = [], begin
    for d in data:
        at.append(out)
        out += len(d)
    lists = 8 + 2 + 12 * n + 4
    many = [(324 if tile else 273, lists), (325 if tile else 279, lists + 4 * len(data))]
    entry = lambda t, c, v: struct.pack(f"{order}HHII", t, 4, c, v)
    one = len(data) == 1
    body = b"".join(entry(t, 1, v) for t, v in tags) + entry(many[0][0], len(data), at[0] if one else many[0][1]) + entry(many[1][0], len(data), len(data[0]) if one else many[1][1])
    tail = struct.pack(f"{order}{len(data)}I", *at) + struct.pack(f"{order}{len(data)}I", *map(len, data))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}IH", 8, n) + body + struct.pack(f"{order}I", 0) + tail + b"".join(data)


def lzw(data):
    table, width, out, bits, n, cur = {bytes([k]): k for k in range(256)}, 9, bytearray(), 0, 0, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8

    put(256)
    size = 258
    for b in data:
        nxt = cur + bytes([b])
        if nxt in table:
            cur = nxt
            continue
        put(table[cur])
        table[nxt] = size
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
        if size > 4093:
            put(256)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        cur = bytes([b])
    if cur:
        put(table[cur])
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def packbits(data):
    out = bytearray()
    i = 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
        else:
            out += bytes([0, data[i]])
        i += run
    return bytes(out)


@pytest.mark.parametrize("compression, pack", [(1, bytes), (8, zlib.compress), (5, lzw), (32773, packbits)])
def test_tiff_files_are_read(compression, pack):
    rng = np.random.default_rng(compression)
    for a in (rng.normal(0, 50, (11, 70)).astype(np.float32), (rng.integers(0, 4, (40, 60)) * 60).astype(np.uint8), rng.integers(0, 60_000, (2, 5)).astype(np.uint16)):
        for order in "<>":
            assert np.array_equal(images.read_tiff(tiff(a, compression, pack, order=order)), a)
        assert np.array_equal(images.read_tiff(tiff(a, compression, pack, tile=16)), a)
        if a.dtype.kind == "u":
            assert np.array_equal(images.read_tiff(tiff(a, compression, pack, predictor=2)), a)
    with pytest.raises(ValueError):
        images.read_tiff(b"no image")


def test_written_tiff_comes_back():
    for a in (np.arange(12, dtype=np.float32).reshape(3, 4) - 1, np.arange(6, dtype=np.uint8).reshape(6, 1)):
        assert np.array_equal(images.read_tiff(images.write_tiff(a)), a)


def test_surface_folders(spark, tmp_path):
    rows = [(s, i + 5, j, float(i), float(j), float(i * j)) for s in ("a", "b") for i in range(3) for j in range(3) if (i, j) != (2, 2)]
    v = spark.createDataFrame(rows, "surface string, i int, j int, z double, y double, x double")
    done = {r.surface: r for r in images.write_surfaces(v, f"file://{tmp_path}/s", 20.0, 8.0, "made", {"parent": "p"}).collect()}
    assert (done["a"].rows, done["a"].columns, done["a"].quads, done["a"].area) == (3, 3, 3, 1200.0)
    meta = json.loads((tmp_path / "s/a/meta.json").read_text())
    assert meta["format"] == "tifxyz" and meta["scale"] == [0.05, 0.05] and meta["parent"] == "p" and meta["bbox"] == [[0.0, 0.0, 0.0], [2.0, 2.0, 2.0]]
    # A mask takes vertices away, a winding plane gives them theirs, and a folder with a plane missing is none.
    mask, winding = np.ones((3, 3), np.uint8), np.zeros((3, 3), np.float32)
    mask[0, 0], winding[1, 1] = 0, 7.5
    (tmp_path / "s/a/mask.tif").write_bytes(images.write_tiff(mask))
    (tmp_path / "s/a/winding.tif").write_bytes(images.write_tiff(winding))
    (tmp_path / "s/b/x.tif").unlink()
    got = images.surfaces(spark, f"{tmp_path}/s").collect()
    assert sorted((r.surface, r.i, r.j, r.z, r.y, r.x, r.winding) for r in got) == sorted((s, i - 5, j, z, y, x, 7.5 if (i - 5, j) == (1, 1) else None) for s, i, j, z, y, x in rows if s == "a" and (i, j) != (5, 0))


def test_key_value_store(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE Dict (key BLOB UNIQUE NOT NULL, value BLOB NOT NULL)")
        c.executemany("INSERT INTO Dict VALUES (?, ?)", [(f"k{i * 37 % 101:03}".encode(), pickle.dumps(i)) for i in range(101)])
    for parts in (1, 7, 200):
        got = images.dbm_records(spark, path, parts).orderBy("ordinal").collect()
        assert [bytes(r.key) for r in got] == [f"k{i:03}".encode() for i in range(101)] and [r.ordinal for r in got] == list(range(101))
    with sqlite3.connect(path) as c:
        c.execute("DELETE FROM Dict")
    assert images.dbm_records(spark, path).count() == 0


def test_bricks_are_checked(spark):
    rows = [(z, y, (z * 5 + y) % 9) for z in range(10) for y in range(7)]
    cells = spark.createDataFrame(rows, "z int, y int, v int")
    packed = images.bricks(cells, ["z", "y"], "v", 4)
    held = {(r.c_z, r.c_y): r.data for r in packed.collect()}
    for z, y, v in rows:
        assert held[z // 4, y // 4][z % 4 * 4 + y % 4] == v
    assert images.wrong_bricks(packed, cells, ["z", "y"], "v", 4, 1, "s").count() == 0
    moved = spark.createDataFrame([(z, y, v + (z == 0 and y == 1)) for z, y, v in rows], "z int, y int, v int")
    assert images.wrong_bricks(packed, moved, ["z", "y"], "v", 4, 1, "s").count() == 1


def test_full_bricks_take_one_pass(spark):
    """600 bricks of 4,096 cells: looking each cell up among all of its brick takes minutes."""
    import time

    cells = spark.range(600 * 4096).where("id % 7 != 3").select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16 % 16).alias("y"), F.floor(F.col("id") / 256).alias("z"), (F.col("id") % 50 + 1).cast("int").alias("v"))
    began = time.time()
    got = images.bricks(cells, ["z", "y", "x"], "v", 16).select(F.size("data").alias("n"), F.aggregate("data", F.lit(0), lambda s, x: s + x).alias("total")).groupBy("n").agg(F.count("*").alias("bricks"), F.sum("total").alias("total")).collect()
    assert [tuple(r) for r in got] == [(4096, 600, cells.agg(F.sum("v")).first()[0])]
    assert time.time() - began < 40
    with pytest.raises(Exception, match="twice"):
        images.bricks(cells.limit(5).unionByName(cells.limit(5)), ["z", "y", "x"], "v", 16).collect()


def test_loss_map_of_two_samples(spark):
    """Two samples at one place, residuals 1 and 3, weight 2: one pixel of 4."""
    s = spark.createDataFrame([("patch", 4.0, 0.0, 100.0, 1.0), ("patch", 4.0, 0.0, 100.0, 3.0), ("patch", 4.0, 0.0, 500.0, 1.0), ("patch", 4.0, 0.0, float("nan"), 1.0), ("other", 4.0, 0.0, 100.0, 1.0)], "name string, z double, y double, x double, residual double")
    windings = spark.createDataFrame([(10, 0, 8)], "winding bigint, first bigint, end bigint")
    pixels = spark.createDataFrame([(r, c) for r in range(4) for c in range(8) if (r, c) != (0, 1)], "row bigint, col bigint")
    weights = spark.createDataFrame([("patch", 2.0), ("other", 0.0)], "name string, weight double")
    p = lossmaps.projected(s, windings, pixels, 0.0, 4.0, 10.0, 4)
    (e,) = lossmaps.entries(p, weights).collect()
    assert (e.name, e.sample_count, e.eligible, e.projected, e.off_surface, e.omitted, e.pixels, e.p50, e.maximum) == ("patch", 2, 3, 2, 0, 1, 1, 4.0, 4.0)
    shown = {(r.row, r.col): r.a for r in lossmaps.coloured(lossmaps.maps(p, weights), lossmaps.entries(p, weights), pixels).collect()}
    assert set(shown) == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)} and set(shown.values()) == {235}


def test_saved_states_are_checked(spark, tmp_path):
    import io
    import zipfile

    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n * 90)
        return out.getvalue()

    whole = archive("x/data.pkl", "x/version")
    files = {"a": whole, "b": whole[:-30], "c": b"\x80\x02", "d": archive("x/version"), "e": whole.replace(b"data.pklx", b"data.pkl!", 1)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path[-1]: r.problem for r in images.container_problems(spark, [str(tmp_path / n) for n in files], ["data.pkl", "version"]).collect()}
    assert got == {"b": "corrupt", "c": "legacy", "d": "missing: data.pkl", "e": "corrupt"}
