"""Scalar expressions. Angles in radians; "half even" is rint, "half up" is floor(x + 1/2): never Spark's round()."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Bits of a coordinate in a packed cell key: three of them fit a signed 64-bit number.
CELL_BITS = 20


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def theta(y, x) -> Column:
    """Angle in [0, 2 pi); an x near 0 is held away from it."""
    x = col(x)
    return F.pmod(F.atan2(col(y), F.when(F.abs(x) < 1e-10, 1e-10).otherwise(x)), F.lit(TWO_PI))


def angle_of(y, x) -> Column:
    """atan2 that heeds the sign of an x of 0, as other engines' and numpy's do: Spark's takes -0.0 for 0.0, the opposite way."""
    y, x = col(y).cast("double"), col(x).cast("double")
    return F.when((y == 0) & (x == 0) & (x.cast("string") == "-0.0"), F.lit(math.pi)).otherwise(F.atan2(y, x))


def wrap(angle) -> Column:
    return F.pmod(col(angle), F.lit(TWO_PI))


def circular_distance(a, b) -> Column:
    d = F.abs(wrap(a) - wrap(b))
    return F.least(d, F.lit(TWO_PI) - d)


def half_even(x) -> Column:
    return F.rint(col(x))


def half_up(x) -> Column:
    return F.floor(col(x) + 0.5)


def huber(x, delta: float) -> Column:
    a = F.abs(col(x))
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def guarded_ratio(top, bottom, least=1e-9) -> Column:
    """top / bottom with a floor under bottom."""
    return col(top) / F.greatest(col(bottom), F.lit(least))


def pack_cell(z, y, x) -> Column:
    """One 60-bit key; coordinates outside [0, 2**20) are an error, not another cell."""
    limit = 1 << CELL_BITS
    z, y, x = (col(c).cast("long") for c in (z, y, x))
    fits = (F.least(z, y, x) >= 0) & (F.greatest(z, y, x) < limit)
    key = F.shiftleft(z, 2 * CELL_BITS).bitwiseOR(F.shiftleft(y, CELL_BITS)).bitwiseOR(x)
    return F.when(fits, key).otherwise(F.raise_error(F.lit("a coordinate is outside the packed range")))


def unpack_cell(key) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << CELL_BITS) - 1)
    return tuple(F.shiftright(col(key), s).bitwiseAND(mask) for s in (2 * CELL_BITS, CELL_BITS, 0))


def source_id(ordinal, index) -> Column:
    """A record's id: the ordinal of its key in the high 32 bits, its index in the low ones."""
    return F.shiftleft(col(ordinal).cast("long"), 32).bitwiseOR(col(index).cast("long"))


def decode_distance(v, offset: float, unit: float) -> Column:
    """Signed distance from its byte code; 0 is no data."""
    return F.when(col(v) != 0, (col(v) - offset) * unit)


def decode_component(v) -> Column:
    """A byte as a direction component in about [-1, 1]."""
    return (col(v) - 128) / 127.0


def shifted_radius(radius, angle, per_turn: float) -> Column:
    return F.greatest(F.lit(0.0), col(radius) - col(angle) / TWO_PI * per_turn)


def band_score(x, low: float, high: float, width: float) -> Column:
    """1 inside [low, high], falling as a Gaussian of the log ratio outside."""
    x = F.greatest(col(x), F.lit(1e-12))
    off = F.when(x < low, F.log(low / x)).when(x > high, F.log(x / high)).otherwise(0.0)
    return F.exp(-0.5 * (off / width) * (off / width))


def ramp(step, begin: float, end: float) -> Column:
    """0 before begin, 1 after end, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(step) - begin) / max(end - begin, 1e-12)))


def at_level(x, source_level: int, target_level: int) -> Column:
    """A coordinate of one pyramid level at another."""
    return col(x) / float(2 ** (target_level - source_level))


def numeric_suffix(name) -> Column:
    return F.regexp_extract(col(name), r"(\d+)$", 1).cast("int")


def expm_2x2(a, b, c, d) -> tuple[Column, Column, Column, Column]:
    """The exponential of [[a, b], [c, d]], by rows: e^s (cosh q I + sinh q / q (A - s I)), s half the trace, q^2 = s^2 - det."""
    a, b, c, d = (col(x) for x in (a, b, c, d))
    s = (a + d) / 2
    q2 = (a - d) * (a - d) / 4 + b * c
    q = F.sqrt(F.abs(q2))
    even = F.when(q2 >= 0, F.cosh(q)).otherwise(F.cos(q))
    odd = F.when(q < 1e-8, F.lit(1.0)).when(q2 >= 0, F.sinh(q) / q).otherwise(F.sin(q) / q)
    e = F.exp(s)
    return e * (even + odd * (a - s)), e * odd * b, e * odd * c, e * (even + odd * (d - s))


def stable_hash(*parts, seed: str = "0") -> Column:
    """A 60-bit number that other engines can compute too: the first 15 hex digits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def winding_by_circumference(u, lowest, highest) -> Column:
    """A whole winding in [lowest, highest] from a uniform draw u in [0, 1): k comes with the weight of its circumference, k + 1/2.

    The weights up to k add up to ((k + 1)**2 - lowest**2) / 2, which is solved for k.
    """
    a, b = col(lowest).cast("double"), col(highest).cast("double")
    mass = ((b + 1) * (b + 1) - a * a) / 2
    return F.least(F.greatest(F.ceil(F.sqrt(2 * col(u) * mass + a * a) - 1).cast("double"), a), b).cast("bigint")


def seconds(at) -> Column:
    """Seconds since 1970 of a timestamp without a zone (or one taken as it reads), with fractions."""
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(at).cast("timestamp_ntz"))
    return since / 1e6
