"""Aggregates with stated ties, empty groups and roundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, half_up


def lower_median(x: str) -> Column:
    """The middle value, the lower of the two middle ones."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")


def median(x) -> Column:
    """The mean of the two middle values."""
    return F.percentile(col(x), 0.5)


def quantiles(x, *q: float) -> Column:
    return F.percentile(col(x), F.array(*[F.lit(v) for v in q]))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, *q: float) -> DataFrame:
    """keys, q: an array of the quantiles, by linear interpolation. Values are ranged over tasks and numbered; only the neighbours of each rank are fetched, so
    that no task holds the values of a key."""
    from .ragged import numbered_within

    d = numbered_within(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), keys, ["__v"], "__rank")
    n = d.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg((F.max("__rank")).alias("__last"))
    ask = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(v)) * F.col("__last")).alias("p")) for i, v in enumerate(q)]))
    ask = n.withColumn("__q", ask).withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__q.p"), F.ceil("__q.p")))))
    same = [d[k].eqNullSafe(ask[f"__k{i}"]) for i, k in enumerate(keys)]
    met = ask.join(d.withColumnRenamed("__rank", "__place"), [F.col("__rank") == F.col("__place"), *same])
    # Of two neighbours each counts the more, the nearer it is.
    share = F.when(F.floor("__q.p") == F.ceil("__q.p"), F.lit(1.0)).otherwise(1 - F.abs(F.col("__q.p") - F.col("__rank")))
    one = met.groupBy(*keys, F.col("__q.i").alias("__i")).agg(F.sum(share * F.col("__v")).alias("__v"))
    out = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("q"))
    return out.select(*keys, F.transform("q", lambda x: x["__v"]).alias("q"))


def mode(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """key, value, n: the most frequent value, the least of equals. Two partial aggregates, no sort of a group."""
    keys = [key] if isinstance(key, str) else key
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("r")).select(*keys, "r.*")


def power_mean(x, p: float) -> Column:
    """((sum x**p) / n) ** (1 / p); 0 for no rows."""
    return F.coalesce(F.pow(F.sum(F.pow(col(x), p)) / F.count(col(x)), 1 / p), F.lit(0.0))


def masked_mean(x, on: Column) -> Column:
    return F.sum(F.when(on, col(x)).otherwise(0.0)) / F.greatest(F.sum(on.cast("int")), F.lit(1))


def nominal_mass_mean(x, w, share: float) -> Column:
    """sum(w x) / max(sum w, share * n): a group with little weight counts little."""
    return F.sum(col(w) * col(x)) / F.greatest(F.sum(col(w)), share * F.count("*"))


def weighted_ratio(hit: Column, weight, least: float = 1e-9) -> Column:
    return F.sum(F.when(hit, col(weight)).otherwise(0.0)) / F.greatest(F.sum(col(weight)), F.lit(least))


def snapped(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median, off (median distance to the nearest whole number), target: the median rounded half up if off is small, else up."""
    m = df.groupBy(key).agg(lower_median(value).alias("median"))
    d = df.join(m, key).groupBy(key, "median").agg(lower_median(f"abs({value} - floor({value} + 0.5))").alias("off"))
    return d.withColumn("target", F.when(F.col("off") <= 0.25, half_up("median")).otherwise(F.ceil("median")))


def all_pairs_l1(df: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """Sum and mean of |x - y| over all pairs of a group's sides 0 and 1, by sorting and running sums, not by pairs.

    For each y of side 1: (x below) * y - their sum + (sum of those above) - (their number) * y.
    """
    w = Window.partitionBy(key).orderBy(value, side).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    on = (F.col(side) == 0).cast("int")
    d = df.where(F.col(value).isNotNull()).withColumn("__n", F.sum(on).over(w)).withColumn("__s", F.sum(on * F.col(value)).over(w))
    d = d.withColumn("__na", F.sum(on).over(whole)).withColumn("__sa", F.sum(on * F.col(value)).over(whole)).where(F.col(side) == 1)
    y = F.col(value)
    part = F.col("__n") * y - F.col("__s") + (F.col("__sa") - F.col("__s")) - (F.col("__na") - F.col("__n")) * y
    out = d.groupBy(key).agg(F.sum(part).alias("total"), F.sum("__na").alias("pairs"))
    return out.withColumn("mean", F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(0.0))


def zero_filled(domain: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """Every key of the domain, with 0 where nothing was counted."""
    return domain.select(key).distinct().join(counted, key, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def bin_means(df: DataFrame, bins: dict[str, Column], value: str) -> DataFrame:
    return df.groupBy(*[b.alias(n) for n, b in bins.items()]).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def tertiles(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """``df`` with low and high (the exact thirds of the values) and bin: 0 up to low, 1 up to high, else 2."""
    keys = [key] if key else []
    q = exact_quantiles(df, keys, value, 1 / 3, 2 / 3).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    j = df.join(q, keys) if keys else df.join(F.broadcast(q))  # without keys q is one row
    return j.withColumn("bin", F.when(F.col(value) <= F.col("low"), 0).when(F.col(value) <= F.col("high"), 1).otherwise(2))


def pooled_mean(df: DataFrame, cells: dict[str, Column], value: str) -> DataFrame:
    """Mean of the values of each coarse cell without no-data (0), rounded half to even; 0 where there is no data."""
    return df.groupBy(*[c.alias(n) for n, c in cells.items()]).agg(F.coalesce(F.rint(F.avg(F.nullif(F.col(value), F.lit(0)))), F.lit(0.0)).cast("long").alias(value))
