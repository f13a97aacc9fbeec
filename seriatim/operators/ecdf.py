"""Empirical distribution functions of two sides, without gathering a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ORIGINAL, SYNTHETIC, bin_of, of

RANGES = 64


def steps(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every distinct value of a key: cdf_o, cdf_s after it, and gap, the distance to the next value.

    Each key's values are cut into RANGES ranges of equal width; running counts stay within a range, and the counts of the
    ranges before it are added, so a key is spread over as many tasks as it has ranges.
    """
    keys = list(keys)
    sizes = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(of(ORIGINAL, F.col("value"))).alias("size_o"), F.count(of(SYNTHETIC, F.col("value"))).alias("size_s"))
    # a row for each key (feature or column); a few where it is the column
    placed = values.join(F.broadcast(sizes) if keys == ["column"] else sizes, keys).withColumn("range", bin_of(F.col("value"), F.col("lo"), F.col("hi"), RANGES))
    counts = placed.where(F.col("value").isNotNull()).groupBy(*keys, "range", "value", "size_o", "size_s").agg(F.count(of(ORIGINAL, F.lit(1))).alias("n_o"), F.count(of(SYNTHETIC, F.lit(1))).alias("n_s"))
    over = Window.partitionBy(*keys).orderBy("range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, "range").agg(F.sum("n_o").alias("all_o"), F.sum("n_s").alias("all_s"), F.min("value").alias("first"))
    base = ranges.select(*keys, "range", F.coalesce(F.sum("all_o").over(before), F.lit(0)).alias("base_o"), F.coalesce(F.sum("all_s").over(before), F.lit(0)).alias("base_s"), F.lead("first").over(over).alias("next"))
    inside = Window.partitionBy(*keys, "range").orderBy("value")
    # RANGES rows for each key
    joined = counts.join(base, [*keys, "range"])
    cdf = [((F.sum(f"n_{x}").over(inside) + F.col(f"base_{x}")) / F.col(f"size_{x}")).alias(f"cdf_{x}") for x in (ORIGINAL, SYNTHETIC)]
    return joined.where("size_o > 0 and size_s > 0").select(*keys, "value", *cdf, (F.coalesce(F.lead("value").over(inside), F.col("next")) - F.col("value")).alias("gap"))


def wasserstein(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First Wasserstein distance of the two sides by key."""
    return steps(values, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.abs(F.col("cdf_o") - F.col("cdf_s")) * F.col("gap")), F.lit(0.0)).alias("w1"))


def kolmogorov(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov statistic of the two sides by key."""
    return steps(values, keys).groupBy(*keys).agg(F.max(F.abs(F.col("cdf_o") - F.col("cdf_s"))).alias("ks"))
