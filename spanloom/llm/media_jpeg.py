"""Media columns: progressive JPEG files that hold a payload exactly, and a decoder for them and other progressive files.

A JPEG's unit is the quantised coefficient. A payload byte b is the level b + 256 of a block, or, among the block's other
coefficients, b if b >= 128 and b - 255 otherwise: magnitudes of eight bits, whose sign and bits are b itself. Chroma has
half the resolution both ways: two units of 192 bytes are four blocks of luma and one of either chroma component, 16 x 16
pixels. The file is sent by spectral selection (levels first, then bands of the rest) and successive approximation (all
but the last bits, then those, one by one). The decoder takes any Huffman-coded progressive file: it gathers scans in
coefficient arrays, inverse-transforms them, upsamples components to full size and gives RGB. Scans whose codes all have
one length are read at once, after a check that they have; others symbol by symbol.

Null text is empty; an empty payload is one unit of spaces; a very long text is one file of as many pixels as it needs,
bounded by a row's size alone; equal texts give equal files and features; rows are stored alone, so order, ties and
repeats play no part; an empty table gives an empty result. Other columns are kept, but the operators' own names win.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, arrow_map, text_bytes

UNIT = 192
_MAX_SIDE = 4095  # MCUs of 16 in the 65,535 pixels that a side may have


def padded(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of 192."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


# ---------------------------------------------------------------- writer


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, at: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(i, ())) for i in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | at]) + counts + b"".join(bytes(lengths[i]) for i in sorted(lengths)))


def _scan(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c, t in components for x in (c, t)), ss, se, ah << 4 | al]))


#: Codes of one bit. Levels lose two bits at first and then have seven, all others one and then have seven.
_LEVELS = _table(0, 0, {1: [7]})
_FIRST = _table(1, 0, {1: [7]})
_REFINE = _table(1, 1, {4: [n << 4 for n in range(15)]})
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))
#: Blocks of a unit of the file, of luma across and down and of each chroma component.
_SAMPLING = ((2, 2), (1, 1), (1, 1))
_MCU = 64 * sum(h * v for h, v in _SAMPLING)
#: (component, first coefficient, last coefficient) of the scans after the levels.
_BANDS = ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63))


def _stuffed(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    return raw.replace(b"\xff", b"\xff\x00") if b"\xff" in raw else raw


def _packed(bits: np.ndarray) -> bytes:
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])))


def component_bytes(payload: np.ndarray, wide: int, high: int) -> list[np.ndarray]:
    """(blocks, 64) of each component, its blocks row by row, of a payload that is cut in MCUs row by row."""
    mcus, at, out = payload.reshape(high, wide, _MCU // 64, 64), 0, []
    for h, v in _SAMPLING:
        own = mcus[:, :, at : at + h * v].reshape(high, wide, v, h, 64)
        out.append(np.ascontiguousarray(own.transpose(0, 2, 1, 3, 4)).reshape(-1, 64))
        at += h * v
    return out


def payload_bytes(components: list[np.ndarray], wide: int, high: int) -> np.ndarray:
    """The other way round."""
    own = [c.reshape(high, v, wide, h, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, h * v, 64) for c, (h, v) in zip(components, _SAMPLING, strict=True)]
    return np.concatenate(own, axis=2).reshape(-1)


def write_jpeg(payload: bytes) -> bytes:
    """The progressive JPEG of a payload of a positive multiple of 192 bytes."""
    n = -(-len(payload) // _MCU)
    wide = -(-n // _MAX_SIDE)
    high = -(-n // wide)
    parts = component_bytes(np.frombuffer(payload.ljust(wide * high * _MCU), np.uint8), wide, high)
    size = (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big")
    spec = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(_SAMPLING))
    out = [b"\xff\xd8", _segment(0xFE, b"units=%d" % (len(payload) // UNIT)), _QUANT, _segment(0xC2, b"\x08" + size + bytes([len(_SAMPLING)]) + spec), _segment(0xDD, b"\x00\x01"), _LEVELS]
    # Levels: one restart interval for each block, so that none is told by difference from the one before. A code and its bits are one byte.
    for c, b in enumerate(parts):
        rows = np.empty((len(b), 3), np.uint8)
        rows[:, 0] = 64 | b[:, 0] >> 2
        rows[:, 1] = 0xFF
        rows[:, 2] = 0xD0 + (np.arange(len(b)) & 7)
        out += [_scan([(c + 1, 0)], 0, 0, 0, 2), rows.tobytes()[:-2]]
    out += [_segment(0xDD, b"\x00\x00"), _FIRST, _REFINE]
    for c, b in enumerate(parts):
        for al in (1, 0):
            out += [_scan([(c + 1, 0)], 0, 0, al + 1, al), _packed(b[:, 0] >> al & 1)]
    for c, ss, se in _BANDS:
        out += [_scan([(c + 1, 0)], ss, se, 0, 1), (parts[c][:, ss : se + 1] >> 1).tobytes()]
    for c, b in enumerate(parts):
        last = ((b & 1) ^ (b < 128)).astype(np.uint8)
        bits = []
        for at in range(0, len(b), 32767):
            run = min(32767, len(b) - at)
            k = run.bit_length() - 1
            head = format(k, "04b") + (format(run - (1 << k), f"0{k}b") if k else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, last[at : at + run, 1:].ravel()]
        out += [_scan([(c + 1, 1)], 1, 63, 1, 0), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reader


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks of the component's own scans
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))  # (padded rows, padded columns, 64), zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


@dataclass(frozen=True)
class Huffman:
    codes: dict[tuple[int, int], int]  # (length, code) -> symbol

    @property
    def first(self) -> tuple[int, int, int]:
        """Length, code and symbol of the shortest code."""
        (length, code), symbol = next(iter(self.codes.items()))
        return length, code, symbol


class Bits:
    """A scan's bits, without stuffing, read one at a time or many at once."""

    def __init__(self, data: np.ndarray):
        self.data, self.bits, self.at = data, np.unpackbits(data), 0

    def take(self, n: int) -> int:
        out = 0
        for x in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | x
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length, x in enumerate(self.bits[self.at : self.at + 16].tolist(), 1):
            code = code << 1 | x
            if (got := table.codes.get((length, code))) is not None:
                self.at += length
                return got
        raise ValueError("no such Huffman code in a scan")

    def signed(self, size: int) -> int:
        x = self.take(size)
        return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1


def _parse_tables(body: bytes, tables: dict[tuple[int, int], Huffman]) -> None:
    i = 0
    while i < len(body):
        kind, counts, code, codes = divmod(body[i], 16), body[i + 1 : i + 17], 0, {}
        i += 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[length, code] = body[i]
                code, i = code + 1, i + 1
            code <<= 1
        tables[kind] = Huffman(codes)


def read_jpeg(data: bytes) -> Image:
    """Coefficient arrays of a progressive JPEG."""
    raw = np.frombuffer(data, np.uint8)
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    marks = marks[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]  # where segments begin and scans end
    tables: dict[tuple[int, int], Huffman] = {}
    quant: dict[int, np.ndarray] = {}
    image, comment, interval, i, ids = None, b"", 0, 2, []
    while i < len(data):
        while data[i + 1] == 0xFF:
            i += 1
        marker = data[i + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        body, i = data[i + 4 : i + 2 + size], i + 2 + size
        if marker == 0xC4:
            _parse_tables(body, tables)
        elif marker == 0xDB:
            at = 0
            while at < len(body):
                wide, name = divmod(body[at], 16)
                quant[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float32)
                at += 65 + 64 * wide
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comment = body
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
            raise ValueError(f"frame type {marker:02x} is not progressive Huffman coding")
        elif marker == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image = Image(wide, high, [Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])], quant, comment)
            ids = [body[6 + 3 * k] for k in range(body[5])]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-wide // (8 * hm)), -(-high // (8 * vm))
            for c in image.components:
                c.wide, c.high = -(-(-(-wide * c.h // hm)) // 8), -(-(-(-high * c.v // vm)) // 8)
                c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int32)
        elif marker == 0xDA:
            end = int(marks[np.searchsorted(marks, i)]) if np.searchsorted(marks, i) < len(marks) else len(data)
            chosen = [(image.components[ids.index(body[1 + 2 * k])], body[2 + 2 * k]) for k in range(body[0])]
            ss, se, approx = body[-3:]
            _read_scan(raw[i:end], chosen, ss, se, approx >> 4, approx & 15, tables, interval, (across, down))
            i = end
    image.comment = comment
    return image


def _intervals(raw: np.ndarray) -> list[np.ndarray]:
    """The stretches between restart markers, each without stuffing."""
    full = np.flatnonzero(raw[:-1] == 0xFF)
    if len(full) == 0:
        return [raw]
    follow = raw[full + 1]
    restart = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[follow == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    clean = raw[keep]
    if len(restart) == 0:
        return [clean]
    return np.split(clean, np.cumsum(keep)[restart])


def _blocks(chosen, units: tuple[int, int]):
    """(component, table, block) of a scan, unit by unit; a scan of one component goes over its own blocks."""
    if len(chosen) == 1:
        c, t = chosen[0]
        return [[(c, t, r, x)] for r in range(c.high) for x in range(c.wide)]
    across, down = units
    return [[(c, t, m * c.v + j, x * c.h + k) for c, t in chosen for j in range(c.v) for k in range(c.h)] for m in range(down) for x in range(across)]


def _read_scan(raw, chosen, ss, se, ah, al, tables, interval, units) -> None:
    if ss == 0 and ah == 0 and interval == 1 and _levels_at_once(raw, chosen, al, tables, units):
        return
    parts = _intervals(raw)
    if ss == 0:
        if not (ah and _last_bits_at_once(parts, chosen, al, interval)):
            _levels(parts, chosen, ah, al, tables, interval, units)
        return
    c, t = chosen[0]
    table = tables[1, t & 15]
    own = c.coefficients[: c.high, : c.wide]
    blocks = own.reshape(-1, 64) if own.flags.c_contiguous else own.reshape(-1, 64).copy()
    step = interval or len(blocks)
    for k, part in enumerate(parts):
        here = blocks[k * step : (k + 1) * step]
        if ah:
            _refine(Bits(part), here, ss, se, al, table)
        elif not _first_at_once(part, here, ss, se, al, table):
            _first(Bits(part), here, ss, se, al, table)
    if not np.shares_memory(blocks, own):
        own[...] = blocks.reshape(own.shape)


def _levels_at_once(raw, chosen, al, tables, units) -> bool:
    """Levels of intervals of one unit each, all of one length and without stuffing, and each component's codes of one length."""
    if len(chosen) == 1:
        across, down = chosen[0][0].wide, chosen[0][0].high
    elif all((c.h, c.v) == (1, 1) for c, _ in chosen):
        across, down = units
    else:
        return False
    stride, rest = divmod(len(raw) + 2, across * down)
    if rest or stride < 3:
        return False
    rows = np.append(raw, np.array([0xFF, 0xD0], np.uint8)).reshape(across * down, stride)
    if np.any(rows[:, -2] != 0xFF) or np.any(rows[:, -1] & 0xF8 != 0xD0) or np.any(rows[:, :-2] == 0xFF):
        return False
    bits = np.unpackbits(rows[:, :-2], axis=1)
    at, found = 0, []
    for _, t in chosen:
        length, code, size = tables[0, t >> 4].first
        if at + length + size > bits.shape[1] or size == 0:
            return False
        if np.any(bits[:, at : at + length] != [code >> (length - 1 - j) & 1 for j in range(length)]):
            return False
        x = bits[:, at + length : at + length + size] @ (1 << np.arange(size - 1, -1, -1))
        found.append(np.where(x >> (size - 1) != 0, x, x - (1 << size) + 1) << al)
        at += length + size
    for (c, _), x in zip(chosen, found, strict=True):
        c.coefficients[:down, :across, 0] = x.reshape(down, across)
    return True


def _last_bits_at_once(parts, chosen, al, interval) -> bool:
    """One bit more for the levels of one component."""
    if len(chosen) != 1 or interval:
        return False
    c = chosen[0][0]
    bits = np.unpackbits(parts[0])[: c.high * c.wide].astype(np.int32)
    c.coefficients[: c.high, : c.wide, 0] |= bits.reshape(c.high, c.wide) << al
    return True


def _levels(parts, chosen, ah, al, tables, interval, units) -> None:
    every = _blocks(chosen, units)
    step = interval or len(every)
    for k, part in enumerate(parts):
        bits, before = Bits(part), {id(c): 0 for c, _ in chosen}
        for unit in every[k * step : (k + 1) * step]:
            for c, t, r, x in unit:
                if ah:
                    c.coefficients[r, x, 0] |= bits.take(1) << al
                else:
                    before[id(c)] += bits.signed(bits.symbol(tables[0, t >> 4]))
                    c.coefficients[r, x, 0] = before[id(c)] << al


def _first_at_once(part, blocks, ss, se, al, table) -> bool:
    """A band without zeros whose codes all have one length."""
    length, code, symbol = table.first
    size, width = symbol & 15, se - ss + 1
    n, stride = len(blocks) * width, length + (symbol & 15)
    if symbol >> 4 or size == 0 or not 0 <= 8 * len(part) - n * stride < 8:
        return False
    if stride == 8:
        head, x = part >> size, (part & ((1 << size) - 1)).astype(np.int32)
        if np.any(head != code):
            return False
    else:
        bits = np.unpackbits(part)[: n * stride].reshape(n, stride)
        if np.any(bits[:, :length] != [code >> (length - 1 - j) & 1 for j in range(length)]):
            return False
        x = bits[:, length:] @ (1 << np.arange(size - 1, -1, -1))
    top = 1 << (size - 1)
    blocks[:, ss : se + 1] = (np.where(x >= top, x, x - 2 * top + 1) * (1 << al)).reshape(-1, width)
    return True


def _first(bits: Bits, blocks, ss, se, al, table) -> None:
    i = 0
    while i < len(blocks):
        k, skip = ss, 1
        while k <= se:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                blocks[i, k] = bits.signed(size) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run)
                break
        i += skip


def _correct(bits: Bits, band: np.ndarray, al: int) -> None:
    """One bit more for each coefficient of the stretch that is not zero, in order."""
    flat = band.reshape(-1)
    live = np.flatnonzero(flat)
    if len(live) == len(flat):
        flat += np.sign(flat) * (bits.many(len(flat)).astype(flat.dtype) << al)
    else:
        flat[live] += np.sign(flat[live]) * (bits.many(len(live)).astype(flat.dtype) << al)
    if not np.shares_memory(flat, band):
        band[...] = flat.reshape(band.shape)


def _refine(bits: Bits, blocks, ss, se, al, table) -> None:
    i, k = 0, ss
    while i < len(blocks):
        run, size = divmod(bits.symbol(table), 16)
        if size == 0 and run < 15:
            # The rest of this block and all of the next ones: only corrections, taken at once.
            count = (1 << run) + bits.take(run)
            _correct(bits, blocks[i : i + 1, k : se + 1], al)
            _correct(bits, blocks[i + 1 : i + count, ss : se + 1], al)
            i, k = i + count, ss
            continue
        new = (1 if bits.take(1) else -1) * (1 << al) if size else 0
        # Over the places that are not zero, with their corrections, to the zero after ``run`` other zeros.
        zeros = np.flatnonzero(blocks[i, k : se + 1] == 0)
        stop = k + int(zeros[run]) if run < len(zeros) else se + 1
        _correct(bits, blocks[i : i + 1, k:stop], al)
        if size:
            blocks[i, stop] = new
        k = stop + 1
        if k > se:
            i, k = i + 1, ss


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _transform() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples): the inverse cosine transform of a block as one matrix."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)
    both = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return both[zigzag()].astype(np.float32)


_INVERSE = _transform()


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) bytes. Components of lower resolution are repeated; one component is grey."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        rows, cols, _ = c.coefficients.shape
        step = image.quant[c.quant]
        matrix = _INVERSE if np.all(step == 1) else _INVERSE * step[:, None]
        plane = c.coefficients.reshape(-1, 64).astype(np.float32) @ matrix
        plane = plane.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + 128
        if hm % c.h == 0 and vm % c.v == 0:
            plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1) if (c.h, c.v) != (hm, vm) else plane
        else:
            y = np.arange(image.height) * c.v // vm
            x = np.arange(image.width) * c.h // hm
            plane = plane[y[:, None], x[None, :]]
        planes.append(np.clip(np.rint(plane[: image.height, : image.width]), 0, 255))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def read_payload(image: Image) -> bytes:
    """The payload of a file by ``write_jpeg``."""
    parts = [c.coefficients.reshape(-1, 64) for c in image.components]
    out = []
    for x in parts:
        b = np.where(x > 0, x, x + 255)
        b[:, 0] = x[:, 0] - 256
        out.append(b.astype(np.uint8))
    units = int(image.comment.removeprefix(b"units="))
    return payload_bytes(out, image.width // 16, image.height // 16)[: units * UNIT].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, and for each channel the sum and a 16-bin histogram, as text: whole numbers, so the same everywhere."""
    high, wide, _ = rgb.shape
    parts = [f"{high}x{wide}"]
    for k in range(3):
        bins = np.bincount(rgb[:, :, k].ravel() >> 4, minlength=16)
        parts.append(f"{int(rgb[:, :, k].sum(dtype=np.int64))}:" + ",".join(map(str, bins.tolist())))
    return ";".join(parts)


# ---------------------------------------------------------------- columns


def _own(df: DataFrame, made: set[str]) -> list[str]:
    return [c for c in df.columns if c not in made]


def _schema(df: DataFrame, own: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in own), more])


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_bytes and media: the JPEG file of each whole text."""
    own = _own(docs, {"text", "n_bytes", "media"})

    def kernel(t: pa.Table):
        data, offsets = text_bytes(t.column("text"))
        raw = data.tobytes()
        media = [write_jpeg(padded(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield t.drop_columns(["text"]).append_column("n_bytes", pa.array(np.diff(offsets))).append_column("media", pa.array(media, pa.binary()))

    return arrow_map(docs.select(*[f"`{c}`" for c in own], "text"), kernel, _schema(docs, own, "n_bytes bigint, media binary"))


def _with_tensors(t: pa.Table, images: list[Image | None]) -> pa.Table:
    rgb = [None if x is None else to_rgb(x) for x in images]
    for k, name in enumerate(("height", "width")):
        t = t.append_column(name, pa.array([None if x is None else x.shape[k] for x in rgb], pa.int32()))
    return t.append_column("rgb", pa.array([None if x is None else x.tobytes() for x in rgb], pa.binary()))


def _images(t: pa.Table) -> list[Image | None]:
    return [None if m is None else read_jpeg(m) for m in t.column("media").to_pylist()]


def tensors(files: DataFrame) -> DataFrame:
    """``files`` (media: progressive JPEG files; null gives nulls) with height, width and rgb: the bytes of the (height, width, 3) tensor."""
    own = _own(files, {"height", "width", "rgb"})

    def kernel(t: pa.Table):
        yield _with_tensors(t, _images(t))

    return arrow_map(files.select(*[f"`{c}`" for c in own]), kernel, _schema(files, own, "height int, width int, rgb binary"), "media")


def features(t: pa.Table) -> list[str | None]:
    """Of a table's tensor columns height, width and rgb, the feature of each row."""
    out = []
    for high, wide, raw in zip(*(t.column(c).to_pylist() for c in ("height", "width", "rgb")), strict=True):
        out.append(None if raw is None else feature(np.frombuffer(raw, np.uint8).reshape(high, wide, 3)))
    return out


def described(files: DataFrame) -> DataFrame:
    """``files`` (media by ``stored``; null gives nulls) without media, with what reading it back gives: payload and media
    digests, and the feature of its tensor. The tensor columns are those of ``tensors``, made and read in one pass."""
    made = {"payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}
    own = [c for c in _own(files, made) if c != "media"]

    def kernel(t: pa.Table):
        images, media = _images(t), t.column("media").to_pylist()
        payload = [None if x is None else read_payload(x) for x in images]
        of = lambda f, values: [None if v is None else f(v) for v in values]
        sha = lambda v: hashlib.sha256(v).hexdigest()
        found = (
            ("payload_bytes", of(len, payload), pa.int64()),
            ("payload_sha256", of(sha, payload), pa.string()),
            ("tail_crc32", of(lambda v: zlib.crc32(v[-16:]), payload), pa.int64()),
            ("media_bytes", of(len, media), pa.int64()),
            ("media_sha256", of(sha, media), pa.string()),
            ("feature", features(_with_tensors(t.select(["media"]), images)), pa.string()),
        )
        t = t.drop_columns(["media"])
        for name, values, kind in found:
            t = t.append_column(name, pa.array(values, kind))
        yield t

    more = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return arrow_map(files.select(*[f"`{c}`" for c in own], "media"), kernel, _schema(files, own, more), "media", CHUNK_BYTES >> 2)
