"""Residuals of samples, binned on the pixels of a preview of windings, with the figures of each kind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import angle_of, shifted_radius, wrap
from .raster import neighbours

#: Colours of a map's values from none to the display's largest. Fixed values.
STOPS = ((32, 64, 220), (20, 210, 235), (255, 220, 35), (255, 45, 20))


def projected(samples: DataFrame, windings: DataFrame, pixels: DataFrame, z0: float, spacing: float, per_turn: float, height: int) -> DataFrame:
    """name, residual, row, col, inside, shown: where each finite sample (name, z, y, x, residual) lies on the preview.

    ``windings``: winding, first, end (columns); ``pixels``: row, col of the surface. Inside: its winding and row are in the
    preview; shown: on the surface, too. Negative residuals count 0.
    """
    ok = samples.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("z", "y", "x", "residual")))
    theta = wrap(angle_of("y", "x"))
    shifted = shifted_radius(F.sqrt(F.col("y") * F.col("y") + F.col("x") * F.col("x")), theta, per_turn)
    s = ok.select("name", F.greatest("residual", F.lit(0.0)).alias("residual"), theta.alias("theta"), F.rint(shifted / per_turn).cast("long").alias("winding"), F.rint((F.col("z") - z0) / spacing).cast("long").alias("row"))
    s = s.join(windings, "winding", "left")
    wide = F.col("end") - F.col("first")
    s = s.withColumn("col", F.col("first") + F.least(F.floor(F.col("theta") / (2 * math.pi) * wide), wide - 1))
    s = s.withColumn("inside", F.col("first").isNotNull() & F.col("row").between(0, height - 1))
    s = s.join(pixels.select("row", "col", F.lit(True).alias("on")), ["row", "col"], "left")
    return s.select("name", "residual", "row", "col", "inside", (F.col("inside") & F.coalesce("on", F.lit(False))).alias("shown"))


def maps(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """name, row, col, value: the mean residual of each pixel that is shown, times its kind's weight (name, weight; kinds of weight 0 are left out)."""
    s = samples.where("shown").groupBy("name", "row", "col").agg(F.avg("residual").alias("mean"))
    return s.join(weights.where("weight != 0"), "name").select("name", "row", "col", (F.col("mean") * F.abs("weight")).alias("value"))


def entries(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """The manifest's figures of each kind: counts of samples, pixels, and quantiles of the pixels' values; the display's largest
    is the 95th percentile of the positive ones, or else the largest."""
    count = lambda c: F.count(F.when(c, 1))
    n = samples.groupBy("name").agg(count(F.col("shown")).alias("sample_count"), F.count("*").alias("eligible"), count(F.col("inside")).alias("projected"), count(F.col("inside") & ~F.col("shown")).alias("off_surface"), count(~F.col("inside")).alias("omitted"))
    q = lambda p: F.percentile("value", p)
    v = maps(samples, weights).groupBy("name").agg(F.count("*").alias("pixels"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("value").alias("maximum"), F.percentile(F.when(F.col("value") > 0, F.col("value")), 0.95).alias("display"))
    out = n.join(weights.where("weight != 0"), "name").join(v, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("name", "weight", "sample_count", "eligible", "projected", "off_surface", "omitted", F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels"), *[zero(F.col(c)).alias(c) for c in ("p50", "p95", "maximum")], zero(F.coalesce("display", "maximum")).alias("display"))


def coloured(values: DataFrame, figures: DataFrame, pixels: DataFrame) -> DataFrame:
    """name, row, col, r, g, b, a: the maps' pixels and those around them on the surface (the largest counts), as colours."""
    wide = neighbours(values, ["row", "col"], 1).groupBy("name", "row", "col").agg(F.max("value").alias("value"))
    wide = wide.join(pixels.select("row", "col"), ["row", "col"], "left_semi")
    share = F.when(F.col("display") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.col("display")))).otherwise(0.0)
    d = wide.join(figures.select("name", "display"), "name").withColumn("t", share * (len(STOPS) - 1)).withColumn("k", F.least(F.floor("t"), F.lit(len(STOPS) - 2)).cast("int")).withColumn("f", F.col("t") - F.col("k"))
    stop = lambda c: F.array(*[F.lit(float(s[c])) for s in STOPS])
    mix = lambda c: F.floor(F.get(stop(c), F.col("k")) * (1 - F.col("f")) + F.get(stop(c), F.col("k") + 1) * F.col("f")).cast("int")
    alpha = F.floor(F.least(F.lit(235.0), 28.0 + 207.0 * F.sqrt(F.col("t") / (len(STOPS) - 1)))).cast("int")
    return d.select("name", "row", "col", mix(0).alias("r"), mix(1).alias("g"), mix(2).alias("b"), alpha.alias("a"))
