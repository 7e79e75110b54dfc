import random
import zlib

import numpy as np
import pytest

from spanloom.llm import media_jpeg as m


class Writer:
    """A plain bit-by-bit progressive encoder, to test the reader with."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def codes(symbols):
    """Eight-bit codes for up to 255 symbols."""
    return {s: (i, 8) for i, s in enumerate(symbols)}


def magnitude(v):
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def first_pass(w, blocks, ss, se, al, table):
    run = 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.put(*table[n << 4])
            w.put(run - (1 << n), n) if n else None
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(ss, se + 1):
            v = int(abs(b[k])) >> al
            if v == 0:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.put(*table[0xF0])
                zeros -= 16
            size, x = magnitude(v if b[k] > 0 else -v)
            w.put(*table[zeros << 4 | size])
            w.put(x, size)
            zeros = 0
        if zeros:
            run += 1
            if run == 32767:
                flush()
    flush()


def refine_pass(w, blocks, ss, se, al, table):
    run, held = 0, []

    def flush():
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            w.put(*table[n << 4])
            w.put(run - (1 << n), n) if n else None
            for x in held:
                w.put(x, 1)
        run, held = 0, []

    for b in blocks:
        size = [int(abs(x)) >> al for x in b]
        last = max((k for k in range(ss, se + 1) if size[k] == 1), default=-1)
        zeros, corrections = 0, []
        for k in range(ss, se + 1):
            if size[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                flush()
                w.put(*table[0xF0])
                for x in corrections:
                    w.put(x, 1)
                corrections, zeros = [], zeros - 16
            if size[k] > 1:
                corrections.append(size[k] & 1)
                continue
            flush()
            w.put(*table[zeros << 4 | 1])
            w.put(int(b[k] > 0), 1)
            for x in corrections:
                w.put(x, 1)
            corrections, zeros = [], 0
        if zeros or corrections:
            run += 1
            held += corrections
            if run == 32767 or len(held) > 900:
                flush()
    flush()


def encode(coefficients, sampling, width, height, interval):
    """coefficients: (padded rows, padded columns, 64) arrays."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    out = [b"\xff\xd8", m._QUANT]
    spec = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out.append(m._segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + spec))
    level, rest = codes(range(12)), codes([r << 4 | s for r in range(16) for s in range(11) if s or r < 16])
    out += [m._table(0, 0, {8: list(level)}), m._table(1, 0, {8: list(rest)}), m._segment(0xDD, interval.to_bytes(2, "big"))]
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    units = [[(c, r * v + j, x * h + k) for c, (h, v) in enumerate(sampling) for j in range(v) for k in range(h)] for r in range(down) for x in range(across)]

    def parts(items, write):
        step, done = interval or len(items), []
        for i in range(0, len(items), step):
            w = Writer()
            write(w, items[i : i + step])
            done.append(w.bytes())
        return b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i < len(done) - 1 else b"") for i, x in enumerate(done))

    def levels(w, items):
        before = [0] * len(sampling)
        for unit in items:
            for c, r, x in unit:
                v = int(coefficients[c][r, x, 0]) >> 1
                size, bits = magnitude(v - before[c]) if v != before[c] else (0, 0)
                w.put(*level[size])
                w.put(bits, size)
                before[c] = v

    def low(w, items):
        for unit in items:
            for c, r, x in unit:
                w.put(int(coefficients[c][r, x, 0]) & 1, 1)

    ids = [(i + 1, 0) for i in range(len(sampling))]
    out += [m._scan(ids, 0, 0, 0, 1), parts(units, levels)]
    for c, (h, v) in enumerate(sampling):
        own = coefficients[c][: -(-(-(-height * v // vm)) // 8), : -(-(-(-width * h // hm)) // 8)].reshape(-1, 64)
        for ss, se in ((1, 5), (6, 63)):
            out += [m._scan([(c + 1, 0)], ss, se, 0, 2), parts(list(own), lambda w, b: first_pass(w, b, ss, se, 2, rest))]
            for al in (1, 0):
                out += [m._scan([(c + 1, 0)], ss, se, al + 1, al), parts(list(own), lambda w, b: refine_pass(w, b, ss, se, al, rest))]
    out += [m._scan(ids, 0, 0, 1, 0), parts(units, low), b"\xff\xd9"]
    return b"".join(out)


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)]])
def test_reader_gathers_every_scan(sampling):
    rng = np.random.default_rng(len(sampling) + sampling[0][1])
    for width, height, interval, dense in ((8, 8, 0, 0.5), (37, 29, 0, 0.1), (50, 17, 2, 0.02), (65, 70, 0, 0.0), (33, 40, 1, 0.9)):
        hm, vm = sampling[0]
        across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
        want = []
        for h, v in sampling:
            x = rng.integers(-300, 300, (down * v, across * h, 64)) // rng.choice([1, 40, 200], (down * v, across * h, 64))
            x[rng.random(x.shape) > dense] = 0
            x[-(-(-(-height * v // vm)) // 8) :, :, 1:] = 0
            x[:, -(-(-(-width * h // hm)) // 8) :, 1:] = 0
            want.append(x)
        image = m.read_jpeg(encode(want, sampling, width, height, interval))
        for c, x in zip(image.components, want, strict=True):
            assert (c.coefficients == x).all()
        assert m.to_rgb(image).shape == (height, width, 3)


def test_inverse_transform_and_colours():
    rng = np.random.default_rng(0)
    x = np.zeros((1, 1, 64), int)
    x[0, 0] = rng.integers(-40, 40, 64)
    zeros = np.zeros((1, 1, 64), int)
    grey = m.to_rgb(m.read_jpeg(encode([x, zeros, zeros], [(1, 1)] * 3, 8, 8, 0)))
    order = m.zigzag()
    assert order[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(order) == list(range(64))
    for yy in range(8):
        for xx in range(8):
            total = 0.0
            for k in range(64):
                v, u = divmod(int(order[k]), 8)
                scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
                total += scale * x[0, 0, k] * np.cos((2 * xx + 1) * u * np.pi / 16) * np.cos((2 * yy + 1) * v * np.pi / 16)
            assert abs(int(grey[yy, xx, 0]) - np.clip(total + 128, 0, 255)) <= 0.51
    assert (grey[:, :, 0] == grey[:, :, 1]).all()


def test_payloads_come_back():
    rng = random.Random(1)
    for size in (0, 1, 191, 192, 193, 5000, 40_000):
        data = bytes(rng.choices(range(256), k=size))
        image = m.read_jpeg(m.write_jpeg(m.padded(data)))
        assert m.read_payload(image) == m.padded(data)
    long = bytes(192 * 40_000) + b"\xff" * 192 * 3
    assert m.read_payload(m.read_jpeg(m.write_jpeg(long))) == long


def test_written_files_also_read_symbol_by_symbol(monkeypatch):
    data = m.padded(bytes(range(256)) * 3)
    monkeypatch.setattr(m, "_levels_at_once", lambda *a: False)
    monkeypatch.setattr(m, "_first_at_once", lambda *a: False)
    monkeypatch.setattr(m, "_last_bits_at_once", lambda *a: False)
    assert m.read_payload(m.read_jpeg(m.write_jpeg(data))) == data


def test_frame(spark):
    rows = [(1, "héllo", "x"), (1, "héllo", "x"), (None, None, None), (3, "", "y"), (4, "z" * 1000, None)]
    files = m.stored(spark.createDataFrame(rows, "doc_id bigint, text string, media string"))
    got = m.described(files).collect()
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(6, 192), (6, 192), (0, 192), (0, 192), (1000, 1152)]
    assert got[0] == got[1] and got[2].payload_sha256 == got[3].payload_sha256
    assert got[4].tail_crc32 == zlib.crc32(b" " * 16) and got[4].feature.startswith("48x16;")  # 6 units: three of 16 x 16 pixels
    rgb = m.tensors(files).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in rgb)
    assert m.described(m.stored(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_payloads_lie_in_subsampled_components():
    """Byte for byte against the coefficients: four blocks of luma, then the chroma blocks, for each 384 bytes."""
    rng = random.Random(4)
    data = bytes(rng.choices(range(256), k=192 * 7))
    image = m.read_jpeg(m.write_jpeg(data))
    assert [(c.h, c.v) for c in image.components] == [(2, 2), (1, 1), (1, 1)] and (image.width, image.height) == (16, 64)
    full = data + b" " * 192
    for i, b in enumerate(full):
        unit, rest = divmod(i, 384)
        block, k = divmod(rest, 64)
        c, r, x = (0, 2 * unit + block // 2, block % 2) if block < 4 else (block - 3, unit, 0)
        assert image.components[c].coefficients[r, x, k] == (b + 256 if k == 0 else b if b >= 128 else b - 255)


def test_tensor_against_a_plain_decoder():
    """Pixel by pixel: the sum of cosines, chroma of half the resolution, and the colour transform."""
    rng = random.Random(5)
    image = m.read_jpeg(m.write_jpeg(bytes(rng.choices(range(60, 256), k=384))))
    order, rgb = m.zigzag(), m.to_rgb(image)
    assert rgb.shape == (16, 16, 3)

    def sample(block, yy, xx):
        total = 128.0
        for k in range(64):
            v, u = divmod(int(order[k]), 8)
            scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
            total += scale * block[k] * np.cos((2 * xx + 1) * u * np.pi / 16) * np.cos((2 * yy + 1) * v * np.pi / 16)
        return float(np.clip(np.rint(total), 0, 255))

    y, cb, cr = (c.coefficients for c in image.components)
    for yy in range(16):
        for xx in range(16):
            a = sample(y[yy // 8, xx // 8], yy % 8, xx % 8)
            b, r = (sample(c[0, 0], yy // 2, xx // 2) - 128 for c in (cb, cr))
            want = np.clip([a + 1.402 * r, a - 0.344136 * b - 0.714136 * r, a + 1.772 * b], 0, 255)
            assert np.abs(rgb[yy, xx] - want).max() <= 1.5


def test_stored_files_and_tensors_are_tables(spark, tmp_path):
    """Files written, read back, decoded to a stored tensor column: its feature is the one that the query gives."""
    rows = [(i, "wörd " * (7 * i), "x") for i in range(6)] + [(9, None, "x"), (10, "z" * 300_000, None)]
    m.stored(spark.createDataFrame(rows, "doc_id bigint, text string, media string")).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    m.tensors(files).write.parquet(str(tmp_path / "tensors"))
    held = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "tensors")).collect()}
    for r in m.described(files).collect():
        t = held[r.doc_id]
        assert r.feature == m.feature(np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3)) and r.media_bytes == len(t.media)
    nulls = m.described(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).first()
    assert nulls.feature is None and nulls.payload_bytes is None
