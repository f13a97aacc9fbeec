"""Diversity: how much of the original's variety the synthetic series show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PRICES, Config
from ..functions.exprs import ORIGINAL, SYNTHETIC, bin_of, capped_ratio, of, pearson, ratio, symmetric_ratio
from ..sources.store import written
from .fidelity import autocorrelations, side_by_side
from .nearest import nearest
from .shape import SERIES, chained, kept, normalized_columns, overlap, standardized, vectors

COLUMN_METRICS = ("variance_ratio", "range_ratio", "entropy_ratio", "autocorr_diversity", "coverage")


def side(frame: DataFrame, variant: str) -> DataFrame:
    return frame.where(F.col("variant") == variant)


def coverage_ratio(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Share of original rows whose nearest synthetic row lies within the threshold, in standardised space."""
    rows = written(vectors(standardized(overlap(points))), "vectors")
    near = nearest(side(rows, ORIGINAL), side(rows, SYNTHETIC))
    return near.agg(F.coalesce(F.avg((F.col("distance") <= config.coverage_threshold).cast("double")), F.lit(0.0)).alias("coverage_ratio"))


#: Projections whose cells close rows share, cells in tolerances, and rows of a cell that meet in one group.
PROJECTIONS, CELL, SALT = 3, 1024, 512


def projection(k: int) -> Column:
    """v along a fixed direction with components within [-1, 1]."""
    along = F.transform("v", lambda x, i: x * (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(1 << 20)) / float(1 << 19) - 1))
    return F.aggregate(along, F.lit(0.0), lambda a, x: a + x)


def close_pairs(rows: DataFrame, t: float) -> DataFrame:
    """(n, m): the multiplicities of each pair of different vectors of ``rows`` (v, n) that lie within ``t`` of each other.

    Such vectors differ by no more than t times the root of their length along any of the directions, so they share a cell of the projections or lie at its border, and a
    vector is copied to the cells whose border it is that near to. A pair is taken in the cell of its first vector. Cells of many vectors are cut into groups of
    about SALT, and each two groups of a cell meet in a task of their own.
    """
    tolerance = t * F.sqrt(F.greatest(F.size("v"), F.lit(1)))
    # sums of many terms lose digits
    slack = tolerance + 1e-12 * F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    placed = rows.select("v", "n", F.xxhash64("v").alias("h"), slack.alias("slack"), (CELL * tolerance).alias("width"), *(projection(k).alias(f"p{k}") for k in range(PROJECTIONS)))
    for k in range(PROJECTIONS):
        placed = placed.withColumn(f"c{k}", F.floor(F.col(f"p{k}") / F.col("width")))
    cells = [f"c{k}" for k in range(PROJECTIONS)]
    placed = written(placed, "placed")
    groups = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SALT).select(*cells, F.ceil(F.col("size") / SALT).cast("int").alias("parts"))
    copies = placed
    for k in range(PROJECTIONS):
        at = F.col(f"p{k}") - F.col(f"c{k}") * F.col("width")
        near = F.array(F.lit(0), F.when(at <= F.col("slack"), -1), F.when(F.col("width") - at <= F.col("slack"), 1))
        copies = copies.withColumn("move", F.explode(F.array_compact(near))).withColumn(f"c{k}", F.col(f"c{k}") + F.col("move"))
    part = F.pmod(F.col("h"), F.col("parts")).cast("int")

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        """Each row for every group of its cell; a cell that is not cut is one group."""
        parts = F.coalesce("parts", F.lit(1))
        return frame.join(groups, cells, "left").withColumn("parts", parts).withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    left = dealt(placed, "a", "b").select(*cells, "a", "b", "v", "n", "h")
    right = dealt(copies, "b", "a").select(*cells, "a", "b", F.col("v").alias("w"), F.col("n").alias("m"), F.col("h").alias("g"))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda a, x: a + x))
    first = (F.col("h") < F.col("g")) | ((F.col("h") == F.col("g")) & (F.col("v") < F.col("w")))
    return left.join(right, [*cells, "a", "b"]).where(first & (F.size("v") == F.size("w"))).where(distance <= t).select("n", "m")


def uniqueness_score(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Share of pairs of synthetic rows that lie further apart than the threshold; 1 for one row or none. Equal rows are counted once as a group."""
    distinct = written(side(vectors(overlap(points)), SYNTHETIC).groupBy("v").agg(F.count(F.lit(1)).alias("n")), "distinct")
    close = close_pairs(distinct, config.uniqueness_threshold).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("apart"))
    within = distinct.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("equal"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    total = F.col("rows") * (F.col("rows") - 1) / 2
    return side_by_side([close, within]).select(F.when(F.col("rows") < 2, 1.0).otherwise(1 - ratio(F.col("apart") + F.col("equal"), total)).alias("uniqueness_score"))


#: For values less a mean, whose last digits depend on the order in which rows are added up: what is so near below an edge of a bin lies on it.
SLACK = 1e-9


def entropies(values: DataFrame, keys: Sequence[str], bins: int = DEFAULT.entropy_bins, slack: float = 0.0) -> DataFrame:
    """Per key and variant: Shannon entropy (nats) of the density over ``bins`` bins of its own range, 1e-10 added to each.

    A constant side gets the range of its value plus and minus 0.5. ``slack`` as in ``bin_of``.
    """
    keys = [*keys, "variant"]
    ranges = values.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(*keys, "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    # a row for each key and variant; a few where the key is the column
    counts = values.where(F.col("value").isNotNull()).join(F.broadcast(ranges) if keys == ["column", "variant"] else ranges, keys).withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins, slack)).groupBy(*keys, "n", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"))
    width = (F.col("hi") - F.col("lo")) / bins
    total = 1 / width + bins * 1e-10
    p, empty = (F.col("c") / (F.col("n") * width) + 1e-10) / total, 1e-10 / total
    terms = counts.select(*keys, (-p * F.ln(p)).alias("h"), (-empty * F.ln(empty)).alias("e"))
    return terms.groupBy(*keys).agg((F.sum("h") + (bins - F.count(F.lit(1))) * F.first("e")).alias("entropy"))


def by_side(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.max(of(ORIGINAL, F.col(value))).alias("o"), F.max(of(SYNTHETIC, F.col(value))).alias("s"))


def statistical_diversity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Mean over features of the symmetric ratios of variance, range and entropy."""
    m = kept(overlap, points)
    per = m.groupBy("f").agg(*(agg(of(x, F.col("value"))).alias(f"{n}_{x}") for x in (ORIGINAL, SYNTHETIC) for n, agg in (("var", F.var_pop), ("lo", F.min), ("hi", F.max))))
    per = per.where("lo_o is not null and lo_s is not null")
    spread = per.agg(F.avg(symmetric_ratio(F.col("var_o"), F.col("var_s"))).alias("variance_ratio"), F.avg(symmetric_ratio(F.col("hi_o") - F.col("lo_o"), F.col("hi_s") - F.col("lo_s"))).alias("range_ratio"))
    entropy = by_side(entropies(m, ["f"], config.entropy_bins), ["f"], "entropy").where("o is not null and s is not null").agg(F.avg(symmetric_ratio(F.col("o"), F.col("s"))).alias("entropy_ratio"))
    return side_by_side([spread, entropy]).select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("variance_ratio", "range_ratio", "entropy_ratio")))


def trend_features(points: DataFrame) -> DataFrame:
    """Per series and column: least-squares slope over time and mean second difference; 0, 0 for one value."""
    order = Window.partitionBy(*SERIES, "column").orderBy("t")
    second = F.col("value") - 2 * F.lag("value", 1).over(order) + F.lag("value", 2).over(order)
    return points.withColumn("second", second).groupBy(*SERIES, "column").agg(F.coalesce(F.regr_slope("value", F.col("t").cast("double")), F.lit(0.0)).alias("slope"), F.coalesce(F.avg("second"), F.lit(0.0)).alias("curvature"))


def spread_ratio(features: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean over keys of the symmetric ratio of the two sides' variance across series."""
    per = features.groupBy(*keys).agg(F.var_pop(of(ORIGINAL, F.col(value))).alias("o"), F.var_pop(of(SYNTHETIC, F.col(value))).alias("s"))
    return per.agg(F.coalesce(F.avg(symmetric_ratio(F.col("o"), F.col("s"))), F.lit(0.0)).alias(name))


def temporal_pattern_diversity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    trends = trend_features(points).select("variant", "column", F.inline(F.array(F.struct(F.lit("slope").alias("what"), F.col("slope").alias("x")), F.struct(F.lit("curvature").alias("what"), F.col("curvature").alias("x")))))
    return side_by_side([spread_ratio(autocorrelations(points, config.max_lag), ["column", "lag"], "acf", "autocorr_diversity"), spread_ratio(trends, ["column", "what"], "x", "trend_diversity")])


def steps_across(chain: DataFrame) -> DataFrame:
    """(variant, column, x, y): neighbouring values of each side's series laid end to end, in order of ord and t, of ``shape.chained`` points.

    Steps within a series are those of the chain, steps from one series to the next come from their last and first
    values, so no window spans a whole side.
    """
    inside = chain.where("not first").select("variant", "column", F.col("before").alias("x"), F.col("value").alias("y"))
    ends = chain.groupBy(*SERIES, "column").agg(F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"))
    border = ends.select("variant", "column", F.lag("last").over(Window.partitionBy("variant", "column").orderBy("ord")).alias("x"), F.col("first").alias("y")).where("x is not null")
    return inside.unionByName(border)


def column_autocorrelation(chain: DataFrame) -> DataFrame:
    """Per column of ``shape.chained`` points: 1 less the difference of the sides' mean lag-1 correlation; that of the series laid end to end where a side has none; else 0."""
    per = chain.groupBy(*SERIES, "column").agg(F.stddev_pop("value").alias("sd"), pearson(F.col("before"), F.col("value")).alias("r"))
    means = by_side(per.where("sd > 1e-8").groupBy("variant", "column").agg(F.avg("r").alias("r")), ["column"], "r").select("column", F.col("o").alias("mean_o"), F.col("s").alias("mean_s"))
    flat = by_side(steps_across(chain).groupBy("variant", "column").agg(pearson(F.col("x"), F.col("y")).alias("r")), ["column"], "r").select("column", F.col("o").alias("flat_o"), F.col("s").alias("flat_s"))
    names = chain.select("column").distinct()
    use = F.when(F.col("mean_o").isNull() | F.col("mean_s").isNull(), F.abs(F.col("flat_o") - F.col("flat_s"))).otherwise(F.abs(F.col("mean_o") - F.col("mean_s")))
    return names.join(means, "column", "left").join(flat, "column", "left").select("column", F.coalesce(F.greatest(F.lit(0.0), 1 - use), F.lit(0.0)).alias("autocorr_diversity"))


def column_diversity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per column of both sides: variance_ratio, range_ratio, entropy_ratio, autocorr_diversity, coverage and their mean, column_diversity_score."""
    m = written(chained(normalized_columns(points)), "normalized")
    known = F.when(F.col("value").isNotNull(), F.col("ord"))
    per = m.groupBy("column").agg(*(agg(of(x, F.col("value"))).alias(f"{n}_{x}") for x in (ORIGINAL, SYNTHETIC) for n, agg in (("var", F.var_samp), ("lo", F.min), ("hi", F.max))), *((F.max(of(x, known)) > F.min(of(x, known))).alias(f"several_{x}") for x in (ORIGINAL, SYNTHETIC)))
    var = [F.when(F.col(f"several_{x}"), F.coalesce(F.col(f"var_{x}"), F.lit(0.0))).otherwise(0.0) for x in (ORIGINAL, SYNTHETIC)]
    low, high = F.greatest("lo_o", "lo_s"), F.least("hi_o", "hi_s")
    shared = F.when(F.col("hi_o") == F.col("lo_o"), F.when(F.col("hi_s") == F.col("lo_s"), 1.0).otherwise(0.0)).when(high <= low, 0.0).otherwise(F.least(ratio(high - low, F.col("hi_o") - F.col("lo_o")), F.lit(1.0)))
    spread = per.select("column", capped_ratio(*var).alias("variance_ratio"), capped_ratio(F.col("hi_o") - F.col("lo_o"), F.col("hi_s") - F.col("lo_s")).alias("range_ratio"), shared.alias("coverage"))
    entropy = by_side(entropies(m, ["column"], config.entropy_bins, SLACK), ["column"], "entropy").select("column", capped_ratio(F.col("o"), F.col("s")).alias("entropy_ratio"))
    out = spread.join(entropy, "column").join(column_autocorrelation(m), "column")
    return out.select("column", *COLUMN_METRICS, (sum((F.col(c) for c in COLUMN_METRICS[1:]), F.col(COLUMN_METRICS[0])) / len(COLUMN_METRICS)).alias("column_diversity_score"))


def weighed(columns: DataFrame) -> DataFrame:
    """Adds the weight of each column: with Volume present, prices share 0.7 and every other column has 0.3; with prices only, others have 0."""
    whole = Window.partitionBy(F.lit(1))  # a row for each column
    price = F.col("column").isin(*PRICES)
    prices, volume = F.sum(price.cast("int")).over(whole), F.max((F.col("column") == "Volume").cast("int")).over(whole)
    kinds = columns.withColumns({"prices": prices, "volume": volume, "columns": F.count(F.lit(1)).over(whole)})
    weight = F.when((F.col("prices") > 0) & (F.col("volume") == 1), F.when(price, 0.7 / F.col("prices")).otherwise(0.3)).when(F.col("prices") > 0, F.when(price, 1.0 / F.col("prices")).otherwise(0.0))
    weight = weight.when(F.col("volume") == 1, F.when(price, 0.0).otherwise(1.0)).otherwise(1.0 / F.col("columns"))
    return kinds.withColumn("w", weight)


def weighted_means() -> list[Column]:
    return [F.coalesce(ratio(F.sum(F.col("w") * F.col(c)), F.sum("w")), F.lit(0.0)).alias(c) for c in COLUMN_METRICS]


def weighted_diversity(columns: DataFrame) -> DataFrame:
    """Column measures weighted to one row, with overall_diversity_score.

    The overall score averages seven terms of which the last two, looked up where they are not, count 0; ``mean_diversity_score`` is
    the mean of the five.
    """
    total = sum((F.col(c) for c in COLUMN_METRICS[1:]), F.col(COLUMN_METRICS[0]))
    return weighed(columns).agg(*weighted_means()).withColumns({"overall_diversity_score": total / 7, "mean_diversity_score": total / 5})


def performance_summary(columns: DataFrame) -> DataFrame:
    """One row: best and worst column with their scores, the gap, whether it is below 0.2, and the overall score less each of both."""
    place = F.struct(-F.col("column_diversity_score"), F.col("column"))
    score = F.col("column_diversity_score")
    row = weighed(columns).agg(F.min_by("column", place).alias("best_column"), F.max(score).alias("best_score"), F.max_by("column", place).alias("worst_column"), F.min(score).alias("worst_score"), *weighted_means())
    overall = sum((F.col(c) for c in COLUMN_METRICS[1:]), F.col(COLUMN_METRICS[0])) / 7
    gap = F.col("best_score") - F.col("worst_score")
    return row.select("best_column", "best_score", "worst_column", "worst_score", gap.alias("performance_gap"), (gap < 0.2).alias("uniform_performance"), (overall - F.col("best_score")).alias("overall_vs_best"), (overall - F.col("worst_score")).alias("overall_vs_worst"))


def column_ranking(columns: DataFrame) -> DataFrame:
    """Columns by score, best first: rank, column, column_diversity_score, gap of best to worst, uniform (gap below 0.2)."""
    order = Window.orderBy(F.desc("column_diversity_score"), "column")  # over a row for each column
    whole = Window.partitionBy(F.lit(1))
    gap = F.max("column_diversity_score").over(whole) - F.min("column_diversity_score").over(whole)
    return columns.select(F.row_number().over(order).alias("rank"), "column", "column_diversity_score", gap.alias("gap"), (gap < 0.2).alias("uniform"))


def legacy_diversity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The mean of seven whole-matrix measures, used where columns cannot be compared."""
    row = side_by_side([coverage_ratio(points, config), uniqueness_score(points, config), statistical_diversity(points, config), temporal_pattern_diversity(points, config)])
    names = row.columns
    return row.withColumn("overall_diversity_score", sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names))


def all_diversity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The weighted measures of the columns beside coverage and uniqueness; where the sides share no column, the whole-matrix form."""
    columns = written(column_diversity(points, config), "columns")
    if columns.isEmpty():
        return legacy_diversity(points, config)
    return side_by_side([weighted_diversity(columns), coverage_ratio(points, config), uniqueness_score(points, config)])
