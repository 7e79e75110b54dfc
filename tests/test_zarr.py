"""Volumes as chunk files, of this package's writing and of others'."""

import json
import zlib

import numpy as np
import pytest
import zstandard

from spanloom.sources import zarr


def put(folder, a, chunks, separator=".", compressor=None, order="C"):
    folder.mkdir()
    doc = {"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "order": order, "fill_value": 0, "compressor": compressor, "filters": None, "dimension_separator": separator}
    (folder / ".zarray").write_text(json.dumps(doc))
    pack = {None: bytes, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress}[compressor and compressor["id"]]
    for c in np.ndindex(*(-(-s // n) for s, n in zip(a.shape, chunks))):
        v = np.zeros(chunks, a.dtype)
        part = a[tuple(slice(k * n, (k + 1) * n) for k, n in zip(c, chunks))]
        v[tuple(slice(0, n) for n in part.shape)] = part
        if part.any():
            file = folder / separator.join(map(str, c))
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(pack(v.tobytes(order)))


@pytest.mark.parametrize("separator, compressor, order", [(".", None, "C"), ("/", {"id": "zlib"}, "F"), ("/", {"id": "zstd"}, "C")])
def test_volumes_are_read(spark, tmp_path, separator, compressor, order):
    rng = np.random.default_rng(3)
    a = (rng.integers(0, 9, (7, 9, 11)) * (rng.random((7, 9, 11)) < 0.3)).astype("<u2")
    a[:3, :4] = 0
    put(tmp_path / "v", a, (3, 4, 5), separator, compressor, order)
    got = {(r.z, r.y, r.x): r.value for r in zarr.voxels(spark, str(tmp_path / "v")).collect()}
    assert got == {tuple(map(int, p)): float(a[tuple(p)]) for p in np.argwhere(a)}
    box = {(r.z, r.y, r.x): r.value for r in zarr.voxels(spark, str(tmp_path / "v"), (2, 0, 4), (6, 8, 99)).collect()}
    assert box == {p: v for p, v in got.items() if 2 <= p[0] < 6 and p[1] < 8 and p[2] >= 4}


def test_writing_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(z, y, x, z + y + x + 1) for z in range(9) for y in range(3) for x in range(5)]
    cells = spark.createDataFrame(rows, "z bigint, y bigint, x bigint, value int")
    path = f"file://{tmp_path}/v"
    assert zarr.write_volume(cells.where("z < 4"), path, (9, 3, 5), 4) == 2 and zarr.write_volume(cells, path, (9, 3, 5), 4) == 4 and zarr.write_volume(cells, path, (9, 3, 5), 4) == 0
    assert sorted((r.z, r.y, r.x, int(r.value)) for r in zarr.voxels(spark, path).collect()) == rows
    with pytest.raises(Exception, match="outside"):
        zarr.write_volume(cells, f"file://{tmp_path}/w", (8, 3, 5), 4)
    (tmp_path / "v/.zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [2.0**k] * 3}]} for k in range(3)]}]}))
    assert [tuple(r) for r in zarr.levels(spark, path).collect()] == [("0", 1.0), ("1", 2.0), ("2", 4.0)]
