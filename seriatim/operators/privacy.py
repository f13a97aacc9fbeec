"""Privacy: how much the synthetic series give away about single original ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import ORIGINAL, SYNTHETIC, bin_of, clipped, of, ratio
from ..sources.store import written
from .diversity import side
from .fidelity import reranked, side_by_side
from .nearest import correlation_sums, nearest
from .ranks import percentiles
from .shape import kept, overlap, padded, standardized, vectors, without
from .utility import SIDES, two_sided


def distances(points: DataFrame, k: int = 1) -> DataFrame:
    """The k least distances of each synthetic row to original rows, on padded matrices scaled by the original."""
    rows = written(vectors(standardized(padded(points))), "vectors")
    return nearest(side(rows, SYNTHETIC), side(rows, ORIGINAL), k)


def scaled_distance(scale: Column) -> Column:
    return F.least(F.try_divide(F.col("distance"), F.when(scale == 0, 1.0).otherwise(scale)), F.lit(1.0))


def column_distances(matrices: DataFrame) -> DataFrame:
    """(key, dcr_mean) of the matrices of columns (key, variant, series, ord, f, value), each scaled by its original; columns with both sides only."""
    rows = written(vectors(standardized(matrices, keys=("key",)), ("key",)), "columns")
    d = nearest(side(rows, SYNTHETIC), side(rows, ORIGINAL))
    scale = percentiles(d.withColumn("value", F.col("distance")), ["key"], [0.95]).select("key", F.col("q")[0].alias("scale"))
    return d.join(scale, "key").groupBy("key").agg(F.avg(scaled_distance(F.col("scale"))).alias("dcr_mean"))


def distance_to_closest_record(points: DataFrame) -> DataFrame:
    """Least distances over their own 95th percentile, at most 1; the raw mean and minimum beside them."""
    d = distances(points)
    scale = percentiles(d.withColumn("value", F.col("distance")), [], [0.95]).select(F.col("q")[0]).scalar()
    x = d.withColumn("x", scaled_distance(scale))
    return x.agg(F.coalesce(F.avg("x"), F.lit(1.0)).alias("dcr_mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("dcr_std"), F.coalesce(F.min("x"), F.lit(1.0)).alias("dcr_min"), F.avg("distance").alias("raw_mean"), F.min("distance").alias("raw_min"))


#: Scores of measures that the short form of privacy doesn't take.
LEGACY = {"mi_accuracy": 0.55, "mi_auc": 0.52, "mi_risk_score": 0.1, "adr_mean": 0.15, "adr_max": 0.3, "adr_risk_score": 0.15, "reidentification_risk": 0.2, "k_anonymity_score": 0.8, "dp_epsilon_estimate": 2.5, "dp_privacy_score": 0.6}


def legacy_privacy(points: DataFrame) -> DataFrame:
    """The distances to closest records beside constants for every other measure."""
    return distance_to_closest_record(points).select("dcr_mean", "dcr_std", "dcr_min", *(F.lit(x).alias(name) for name, x in LEGACY.items()))


def minimal_privacy(spark: SparkSession, base: float = 0.0) -> DataFrame:
    """The row for sides without enough rows: ``base`` as distance and overall score, an attack that guesses."""
    names = {"dcr_mean": base, "dcr_std": 0.0, "dcr_min": base, "mi_accuracy": 0.5, "mi_auc": 0.5, "mi_risk_score": 0.0, "overall_privacy_score": base}
    return spark.range(1).select(*(F.lit(float(x)).alias(name) for name, x in names.items()))


def attribute_disclosure(points: DataFrame, config: Config = DEFAULT, raw: bool = False) -> DataFrame:
    """Share of each feature's rare original values that occur on the synthetic side: mean and maximum over features.

    Values are compared as standardised, or with ``raw`` as they are.
    """
    m = overlap(points) if raw else padded(points)
    counts = m.where(F.col("value").isNotNull()).groupBy("f", "value").agg(*(F.count(of(x, F.lit(1))).alias(f"n_{x}") for x in SIDES))
    sizes = counts.groupBy("f").agg(F.sum("n_o").alias("size_o"))
    # a row for each feature
    rare = counts.join(sizes, "f").where((F.col("n_o") > 0) & (F.col("n_o") / F.col("size_o") <= config.rare_share))
    risk = rare.groupBy("f").agg(F.avg((F.col("n_s") > 0).cast("double")).alias("risk"))
    per = sizes.join(risk, "f", "left").select("f", F.coalesce("risk", F.lit(0.0)).alias("risk"))
    return per.agg(F.coalesce(F.avg("risk"), F.lit(0.0)).alias("adr_mean"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("adr_max"), F.coalesce(F.avg("risk"), F.lit(0.0)).alias("adr_risk_score"))


def re_identification(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """reidentification_risk: rows with a neighbour within the 1st percentile of their distances, which the nearest always is;
    k_anonymity_score: share of rows whose k nearest lie at k distinct distances (4 digits)."""
    k = config.neighbours
    per = distances(points, k).groupBy("series").agg(F.countDistinct(F.round("distance", 4)).alias("distinct"))
    return per.agg(F.when(F.count(F.lit(1)) > 0, 1.0).otherwise(0.0).alias("reidentification_risk"), F.coalesce(F.avg((F.col("distinct") >= k).cast("double")), F.lit(1.0)).alias("k_anonymity_score"))


def differential_privacy(points: DataFrame) -> DataFrame:
    """epsilon: the largest difference of feature means over the deviation of the differences of feature deviations, at most 100."""
    per = two_sided(padded(points), ["f"]).where("n_o > 0 and n_s > 0")
    row = per.agg(F.max(F.abs(F.col("mean_o") - F.col("mean_s"))).alias("sensitivity"), F.stddev_pop(F.col("sd_o") - F.col("sd_s")).alias("noise"))
    epsilon = F.when(F.col("sensitivity") == 0, 0.1).otherwise(ratio(F.col("sensitivity"), F.col("noise")))
    return row.select(F.coalesce(F.least(epsilon, F.lit(100.0)), F.lit(100.0)).alias("dp_epsilon_estimate"), F.coalesce(1 / (1 + epsilon), F.lit(0.0)).alias("dp_privacy_score"))


def distance_privacy(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A sigmoid of the mean least distance of the synthetic rows (all, or the first ``distance_rows``) over its 75th percentile."""
    m = reranked(standardized(padded(points)))
    rows = written(vectors(m if config.distance_rows is None else m.where((F.col("variant") == ORIGINAL) | (F.col("ord") < config.distance_rows))), "vectors")
    near = nearest(side(rows, SYNTHETIC), side(rows, ORIGINAL))
    q = percentiles(near.withColumn("value", F.col("distance")), [], [0.75]).select(F.col("q")[0]).scalar()
    d = near.agg(F.avg("distance").alias("mean")).withColumn("q", q)
    x = F.when(F.col("q") > 0, F.col("mean") / (F.col("q") + 1e-6)).otherwise(F.col("mean"))
    return d.select(F.coalesce(clipped(0.2 + 0.7 / (1 + F.exp(-2 * (x - 0.5))), 0.2, 0.9), F.lit(0.5)).alias("distance_privacy"))


def pattern_repetition(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """1 less the mean absolute correlation between synthetic rows, all or ``pattern_rows`` at most, chosen by a fixed scramble of ord; 0.1 at least, 0.5 without pairs."""
    if config.pattern_rows is not None:
        rows = rows.orderBy(F.struct((F.col("ord") * 7919) % 10007, "ord")).limit(config.pattern_rows)
    r = correlation_sums(rows).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("r"))
    return r.select(F.coalesce(F.greatest(F.lit(0.1), 1 - F.col("r")), F.lit(0.5)).alias("pattern_diversity"))


def pattern_uniqueness(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    m = padded(points)
    per = m.groupBy("variant", "series").agg(F.var_pop("value").alias("var"))
    sd = [F.when(F.count(of(x, F.col("var"))) > 1, F.stddev_pop(of(x, F.col("var")))).otherwise(0.1).alias(f"sd_{x}") for x in SIDES]
    row = side_by_side([per.agg(*sd), pattern_repetition(vectors(side(reranked(m), SYNTHETIC)), config)])
    score = 0.4 * F.least(F.col("sd_s") / (F.col("sd_o") + 1e-6), F.lit(2.0)) + 0.6 * F.col("pattern_diversity")
    return row.select("pattern_diversity", clipped(0.2 + 0.7 * F.tanh(score), 0.2, 0.9).alias("pattern_uniqueness"))


def kl_privacy(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Mean divergence of synthetic from original histograms (edges - 1 bins, 1e-8 added to each density), mapped to a score."""
    m = kept(padded, points)
    bins = config.overlap_edges - 1
    ranges = m.groupBy("f").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *(F.count(of(x, F.col("value"))).alias(f"size_{x}") for x in SIDES)).where("size_o > 10 and size_s > 10 and hi > lo")
    # a row for each feature
    counts = m.join(ranges, "f").withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins)).groupBy("f", "lo", "hi", "size_o", "size_s", "bin").agg(*(F.count(of(x, F.col("value"))).alias(f"n_{x}") for x in SIDES))
    width = (F.col("hi") - F.col("lo")) / bins
    total = 1 / width + bins * 1e-8
    p, q = ((F.col(f"n_{x}") / (F.col(f"size_{x}") * width) + 1e-8) / total for x in (SYNTHETIC, ORIGINAL))
    # bins without any value have equal masses on both sides and add nothing
    kl = counts.groupBy("f").agg(F.sum(p * F.ln(p / q)).alias("kl")).agg(F.avg("kl").alias("kl"))
    score = F.when(F.col("kl") < 0.05, 0.3).when(F.col("kl") > 2.0, 0.4).otherwise(0.5 + 0.4 * (F.col("kl") - 0.05) / 1.95)
    return kl.select(F.col("kl").alias("mean_kl"), F.when(F.col("kl").isNull(), 0.5).otherwise(clipped(score, 0.2, 0.9)).alias("kl_privacy"))


def moment_privacy(points: DataFrame) -> DataFrame:
    per = two_sided(padded(points), ["f"]).where("n_o > 5 and n_s > 5")
    span = F.col("hi_o") - F.col("lo_o")
    level = F.when(span > 0, ratio(F.abs(F.col("mean_o") - F.col("mean_s")), span))
    spread = F.when(F.col("sd_o") > 0, F.least(ratio(F.abs(F.col("sd_o") - F.col("sd_s")), F.col("sd_o")), F.lit(1.0)))
    m = per.select(F.explode(F.array(level, spread)).alias("x")).agg(F.avg("x").alias("m"))
    return m.select(F.coalesce(clipped(0.3 + 0.6 * F.tanh(2 * F.col("m")), 0.2, 0.9), F.lit(0.5)).alias("moment_privacy"))


def distributional_privacy(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    row = side_by_side([kl_privacy(points, config), moment_privacy(points)])
    return row.withColumn("distributional_privacy", clipped(0.6 * F.col("kl_privacy") + 0.4 * F.col("moment_privacy"), 0.2, 0.9))


def column_distributional_privacy(points: DataFrame) -> DataFrame:
    """Per column: overall_privacy_score from the differences of mean and deviation, and the attack accuracy that it implies. One side only: 0.1, 0.1, 0.9, 0.1."""
    per = two_sided(without(points).where(F.col("value").isNotNull()), ["column"])
    span = F.col("hi_o") - F.col("lo_o")
    level = F.coalesce(F.least(F.lit(1.0), ratio(F.abs(F.col("mean_o") - F.col("mean_s")), span)), F.lit(0.0))
    spread = F.when(span > 0, F.coalesce(F.least(F.lit(1.0), ratio(F.abs(F.col("sd_o") - F.col("sd_s")), F.col("sd_o"))), F.lit(0.0))).otherwise(0.0)
    score = (level + spread) / 2
    both = (F.col("n_o") > 0) & (F.col("n_s") > 0)
    out = per.select("column", F.when(both, score).otherwise(0.1).alias("overall_privacy_score"), F.when(both, F.greatest(F.lit(0.5), 1 - score)).otherwise(0.9).alias("mir_accuracy"))
    return out.select("column", "overall_privacy_score", F.col("overall_privacy_score").alias("dcr_mean"), "mir_accuracy", (1 - F.col("mir_accuracy")).alias("mir_score"))


def fallback_privacy(points: DataFrame) -> DataFrame:
    """The same over all columns pooled, where neither distances nor an attack can be computed."""
    return column_distributional_privacy(without(points, exact=True).withColumn("column", F.lit("all"))).drop("column")
