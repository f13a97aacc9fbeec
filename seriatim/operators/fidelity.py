"""Fidelity: how closely synthetic series follow the original in distribution, shape and time.

Every function takes points and returns a frame; one-row results carry the documented value of degenerate input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import ORIGINAL, SYNTHETIC, bin_of, of
from ..sources.store import mapped, written
from . import ecdf, warping
from .ranks import numbered
from .shape import SERIES, kept, overlap, standardized, without


def summarized(scores: DataFrame, value: str, prefix: str, extreme: str = "max") -> DataFrame:
    """Mean, population deviation and extreme of a column; 1, 0, 1 where there is nothing."""
    pick = F.max if extreme == "max" else F.min
    return scores.agg(F.coalesce(F.avg(value), F.lit(1.0)).alias(f"{prefix}_mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias(f"{prefix}_std"), F.coalesce(pick(value), F.lit(1.0)).alias(f"{prefix}_{extreme}"))


def histogram_distances(matrix: DataFrame, bins: int = DEFAULT.histogram_bins) -> DataFrame:
    """Per feature: L1 distance of the two sides' histograms on their common range. Scaling a feature leaves it unchanged."""
    sides = matrix.where(F.col("value").isNotNull()).groupBy("f").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(of(ORIGINAL, F.lit(1))).alias("size_o"), F.count(of(SYNTHETIC, F.lit(1))).alias("size_s"))
    # a row for each feature
    binned = matrix.join(sides.where("size_o > 0 and size_s > 0"), "f").withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy("f", "size_o", "size_s", "lo", "hi", "bin").agg(F.count(of(ORIGINAL, F.col("value"))).alias("n_o"), F.count(of(SYNTHETIC, F.col("value"))).alias("n_s"))
    return counts.groupBy("f").agg(F.sum(F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.abs(F.col("n_o") / F.col("size_o") - F.col("n_s") / F.col("size_s")))).alias("score"))


def marginal_distribution_difference(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return summarized(histogram_distances(kept(overlap, points), config.histogram_bins), "score", "mdd")


def lag_correlations(x: np.ndarray, max_lag: int) -> np.ndarray:
    """[row, lag - 1]: Pearson correlation of each row with itself lag cells later, over the places where both are known (not NaN); 0 where either is constant there."""
    out = np.zeros((len(x), max_lag))
    for k in range(1, min(max_lag, x.shape[1] - 1) + 1):
        a, b = x[:, k:], x[:, :-k]
        known = ~(np.isnan(a) | np.isnan(b))
        n = np.maximum(known.sum(axis=1), 1)
        # the extremes tell whether a side is constant; its sum of squares may be above 0 by rounding
        varied = np.ones(len(x), bool)
        centred = []
        for side in (a, b):
            lo, hi = np.where(known, side, np.inf).min(axis=1), np.where(known, side, -np.inf).max(axis=1)
            varied &= lo < hi
            mean = np.where(known, side, 0.0).sum(axis=1) / n
            centred.append(np.where(known, side - mean[:, None], 0.0))
        p, q = centred
        size = np.sqrt((p * p).sum(axis=1) / n) * np.sqrt((q * q).sum(axis=1) / n)
        some = varied & (size > 0)
        out[some, k - 1] = ((p * q).sum(axis=1) / n)[some] / size[some]
    return out


def autocorrelations(points: DataFrame, max_lag: int = DEFAULT.max_lag) -> DataFrame:
    """Per series, column and lag: Pearson correlation with the lagged series; 0 where undefined or the series has max_lag values or fewer.

    Series of like lengths are worked on together; a batch of them is bounded as in ``warping``.
    """
    rows = points.groupBy(*SERIES, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"].cast("double")).alias("v"))
    kinds = [points.schema[c].dataType.simpleString() for c in SERIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(batch.column("v").offsets.to_numpy())
            flat, first = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n  # NULLs become NaN
            acf = np.zeros((batch.num_rows, max_lag))
            for some in warping.batches_of(n, n):
                long = some[n[some] > max_lag]
                acf[long] = lag_correlations(warping.padded(flat, first[long], n[long], np.nan), max_lag)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(acf) + 1, dtype=np.int32) * max_lag), pa.array(acf.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*SERIES, "column")), lists], names=[*SERIES, "column", "r"])

    found = mapped(rows, run, ", ".join(f"{c} {kind}" for c, kind in zip(SERIES, kinds)) + ", column string, r array<double>")
    return found.select(*SERIES, "column", F.posexplode("r").alias("lag0", "acf")).select(*SERIES, "column", (F.col("lag0") + 1).alias("lag"), "acf")


def paired(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The i-th original beside the i-th synthetic series: ord, keys, value_o, value_s. Surplus series have no partner."""
    o = frame.where(F.col("variant") == ORIGINAL).select("ord", *keys, F.col(value).alias(f"{value}_o"))
    s = frame.where(F.col("variant") == SYNTHETIC).select("ord", *keys, F.col(value).alias(f"{value}_s"))
    return o.join(s, ["ord", *keys])


def autocorrelation_difference(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    both = paired(written(autocorrelations(points, config.max_lag), "acf"), ["column", "lag"], "acf")
    return summarized(both.groupBy("ord").agg(F.avg(F.abs(F.col("acf_o") - F.col("acf_s"))).alias("score")), "score", "acd")


def statistical_moments_difference(points: DataFrame) -> DataFrame:
    """Mean absolute difference of skewness and excess kurtosis over features with more than 3 values a side."""
    per = overlap(points).groupBy("f").agg(*(agg(of(x, F.col("value"))).alias(f"{name}_{x}") for x in (ORIGINAL, SYNTHETIC) for name, agg in (("n", F.count), ("skew", F.skewness), ("kurt", F.kurtosis))))
    diffs = per.where("n_o > 3 and n_s > 3").agg(F.coalesce(F.avg(F.abs(F.col("skew_o") - F.col("skew_s"))), F.lit(1.0)).alias("skewness_diff"), F.coalesce(F.avg(F.abs(F.col("kurt_o") - F.col("kurt_s"))), F.lit(1.0)).alias("kurtosis_diff"))
    return diffs.withColumn("moment_score", F.greatest(F.lit(0.0), 1 - (F.col("skewness_diff") + F.col("kurtosis_diff")) / 2))


def reranked(matrix: DataFrame) -> DataFrame:
    """ord anew, over the series that the matrix has kept."""
    ids = matrix.select(*SERIES).distinct()
    place = numbered(ids, ["variant"], ["ord", "series"], "place")
    return matrix.join(place, list(SERIES)).drop("ord").withColumnRenamed("place", "ord")


def euclidean_distance(points: DataFrame) -> DataFrame:
    both = paired(reranked(kept(overlap, points)), ["f"], "value")
    return summarized(both.groupBy("ord").agg(F.sqrt(F.avg(F.pow(F.col("value_o") - F.col("value_s"), 2))).alias("score")), "score", "euclidean", "min")


def wasserstein_distance(points: DataFrame) -> DataFrame:
    return summarized(ecdf.wasserstein(written(standardized(kept(overlap, points)), "scaled"), ["f"]), "w1", "wasserstein", "min")


def dtw_distances(points: DataFrame, pairs: int | None = DEFAULT.dtw_pairs) -> DataFrame:
    """Per pair of series (all, or the first ``pairs``) and common column: warping distance over the longer length."""
    taken = points if pairs is None else points.where(F.col("ord") < pairs)
    rows = taken.where(F.col("value").isNotNull()).groupBy(*SERIES, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    both = paired(rows, ["column"], "v").where("size(v_o) > 1 and size(v_s) > 1")
    return warping.distances(both)


def dynamic_time_warping(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return summarized(dtw_distances(points, config.dtw_pairs), "score", "dtw", "min")


def all_fidelity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every fidelity measure and their overall score in one row."""
    parts = [marginal_distribution_difference(points, config), autocorrelation_difference(points, config), statistical_moments_difference(points), dynamic_time_warping(points, config), euclidean_distance(points), wasserstein_distance(points)]
    return side_by_side(parts).withColumn("overall_fidelity_score", overall())


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """One-row frames as one row."""
    out = rows[0].withColumn("one", F.lit(1))
    for row in rows[1:]:
        out = out.join(row.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def overall() -> Column:
    terms = [F.col("mdd_mean"), F.col("acd_mean"), 1 - F.col("moment_score"), *(F.least(F.col(f"{x}_mean"), F.lit(1.0)) for x in ("dtw", "euclidean", "wasserstein"))]
    return F.greatest(F.lit(0.0), 1 - sum(terms[1:], terms[0]) / len(terms))


def pooled(points: DataFrame) -> DataFrame:
    """The points that column measures compare: where series ids are common to both sides only those with the column on both, else all."""
    known = without(points).where(F.col("value").isNotNull())
    both = [F.max(of(x, F.lit(1))).isNotNull() for x in (ORIGINAL, SYNTHETIC)]
    if points.groupBy("series").agg((both[0] & both[1]).alias("common")).where("common").isEmpty():
        return known
    shared = known.groupBy("series", "column").agg((both[0] & both[1]).alias("common")).where("common").drop("common")
    return known.join(shared, ["series", "column"])


def column_fidelity(points: DataFrame) -> DataFrame:
    """Per column of either side: column_fidelity_score, mdd (1 - KS), moment_similarity. A column of one side only: 0, 1, 0."""
    values = written(pooled(points), "pooled")
    ks = ecdf.kolmogorov(values, ["column"])
    aggs = {"n": F.count, "mean": F.avg, "sd": F.stddev_pop, "skew": F.skewness, "kurt": F.kurtosis}
    moments = values.groupBy("column").agg(*(agg(of(x, F.col("value"))).alias(f"{name}_{x}") for x in (ORIGINAL, SYNTHETIC) for name, agg in aggs.items()))
    off = [F.abs(F.col(f"{m}_o") - F.col(f"{m}_s")) / (F.abs(F.col(f"{m}_o")) + 1e-10) for m in ("mean", "sd", "skew", "kurt")]
    similarity = F.greatest(F.lit(0.0), 1 - sum(off[1:], off[0]) / 4)
    both = (F.col("n_o") > 0) & (F.col("n_s") > 0)
    names = without(points).select("column").distinct()
    out = names.join(moments, "column", "left").join(ks, "column", "left").select(
        "column", F.when(both, F.greatest(F.lit(0.0), 1 - F.col("ks"))).alias("k"), F.when(both, F.coalesce(similarity, F.lit(0.0))).otherwise(0.0).alias("moment_similarity")
    )
    return out.select("column", F.coalesce(0.6 * F.col("k") + 0.4 * F.col("moment_similarity"), F.lit(0.0)).alias("column_fidelity_score"), F.coalesce("k", F.lit(1.0)).alias("mdd"), "moment_similarity")
