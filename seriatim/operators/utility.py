"""Utility: whether models and statistics learned from synthetic series serve for the original."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Config
from ..functions.exprs import ORIGINAL, SYNTHETIC, bin_of, clipped, of, pearson, ratio
from ..sources.store import written
from .diversity import by_side, steps_across
from .fidelity import side_by_side
from .ranks import percentiles
from .shape import chained, padded, vectors, without

SIDES = (ORIGINAL, SYNTHETIC)
AGGREGATES = {"n": F.count, "mean": F.avg, "sd": F.stddev_pop, "lo": F.min, "hi": F.max}


def two_sided(values: DataFrame, keys: list[str], quartiles: bool = False) -> DataFrame:
    """Per key: n, mean, sd (population), lo, hi and on demand quartiles q of each side, suffixed _o and _s."""
    if quartiles:
        values = written(values.select(*keys, "variant", "value"), "values")
    aggs = [agg(of(x, F.col("value"))).alias(f"{name}_{x}") for x in SIDES for name, agg in AGGREGATES.items()]
    out = values.groupBy(*keys).agg(*aggs)
    if quartiles:
        q = percentiles(values, [*keys, "variant"], [0.25, 0.5, 0.75])
        out = out.join(q.groupBy(*keys).agg(*(F.max(of(x, F.col("q"))).alias(f"q_{x}") for x in SIDES)), keys, "left")
    return out


def mean_of(terms: list[Column], default: float) -> Column:
    """Mean of the terms that are not NULL."""
    known = F.filter(F.array(*terms), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(default)


def quartile_similarity() -> Column:
    iqr = F.col("q_o")[2] - F.col("q_o")[0]
    off = (F.abs(F.col("q_o")[0] - F.col("q_s")[0]) + F.abs(F.col("q_o")[1] - F.col("q_s")[1]) + F.abs(F.col("q_o")[2] - F.col("q_s")[2])) / 3
    return F.when(iqr > 0, F.greatest(F.lit(0.0), 1 - ratio(off, iqr)))


def range_similarity() -> Column:
    o, s = F.col("hi_o") - F.col("lo_o"), F.col("hi_s") - F.col("lo_s")
    return F.when(o > 0, 1 - F.least(F.lit(1.0), ratio(F.abs(o - s), o)))


def simple_distance(points: DataFrame) -> DataFrame:
    """Root mean square differences of feature means and variances on padded matrices, averaged, within [0.5, 3]."""
    per = padded(points).groupBy("f").agg(*(agg(of(x, F.col("value"))).alias(f"{n}_{x}") for x in SIDES for n, agg in (("mean", F.avg), ("var", F.var_pop))))
    row = per.agg(*(F.sqrt(F.avg(F.pow(F.col(f"{n}_o") - F.col(f"{n}_s"), 2))).alias(n) for n in ("mean", "var")))
    distance = F.coalesce(clipped((F.col("mean") + F.col("var")) / 2, 0.5, 3.0), F.lit(2.0))
    return row.select(distance.alias("cfid_distance"), F.when(F.col("mean").isNull(), 0.33).otherwise(1 / (1 + distance)).alias("cfid_score"))


def column_similarity(points: DataFrame) -> DataFrame:
    """Per column with 5 values or more a side: mean of the moment, quartile and range similarities that are defined."""
    per = two_sided(without(points, exact=True).where(F.col("value").isNotNull()), ["column"], quartiles=True).where("n_o >= 5 and n_s >= 5")
    level = F.when(F.col("sd_o") > 0, 1 - F.least(F.lit(1.0), ratio(F.abs(F.col("mean_o") - F.col("mean_s")), 3 * F.col("sd_o"))))
    spread = F.when(F.col("sd_o") > 0, 1 - F.least(F.lit(1.0), ratio(F.abs(F.col("sd_o") - F.col("sd_s")), F.col("sd_o"))))
    return per.select("column", mean_of([level, spread, quartile_similarity(), range_similarity()], 0.3).alias("similarity"))


def distributional_similarity(points: DataFrame) -> DataFrame:
    row = column_similarity(points).agg(F.avg("similarity").alias("m"))
    distance = F.coalesce(F.greatest(F.lit(0.1), 3 * (1 - F.col("m"))), F.lit(2.0))
    return row.select(distance.alias("cfid_distance"), F.when(F.col("m").isNull(), 0.33).otherwise(1 / (1 + distance)).alias("cfid_score"))


def distribution_similarity(points: DataFrame) -> DataFrame:
    """Mean over features of 1 / (1 + relative differences of mean and deviation)."""
    per = two_sided(padded(points), ["f"]).where("n_o > 0 and n_s > 0")
    off = F.abs(F.col("mean_o") - F.col("mean_s")) / (F.abs(F.col("mean_o")) + 1e-10) + F.abs(F.col("sd_o") - F.col("sd_s")) / (F.col("sd_o") + 1e-10)
    return per.agg(F.coalesce(F.avg(1 / (1 + off)), F.lit(0.0)).alias("distribution_similarity"))


#: Cells of sums of products that a task holds for a key.
CELLS = 1 << 22


def gram(rows: DataFrame, keys: list[str], column: str = "v", cells: int = CELLS) -> DataFrame:
    """Per key: sums of products (i, j, xy) over i <= j of the vectors (without NULLs, of one length for a key) with a 1 put before them.

    Each task adds up its rows first and sends one matrix per key, so the shuffle follows the number of tasks. Where a matrix would have more
    than ``cells`` cells it is cut into stripes of rows i; rows are then sent once for each stripe, and a task holds the stripes it was sent.
    """
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "i int, j int, xy double"])
    kinds = {k: to_arrow_type(rows.schema[k].dataType) for k in keys}
    size = 1 + (rows.agg(F.max(F.size(column))).first()[0] or 0)
    height = max(1, min(size, cells // size))
    stripes = -(-size // height)
    spread = rows.select(*keys, column, F.lit(0).alias("stripe"))
    if stripes > 1:
        spread = rows.select(*keys, column, F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")).repartition("stripe", F.pmod(F.xxhash64(column), F.lit(8)))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, np.ndarray]]:
        """(key, stripe, vectors) of the rows of a batch."""
        codes = np.zeros(batch.num_rows, np.int64)
        for c in (*keys, "stripe"):
            coded = batch.column(c).dictionary_encode()
            codes = np.unique(codes * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
        for code in range(codes.max(initial=-1) + 1):
            some = np.flatnonzero(codes == code)
            lists = batch.column(column).take(pa.array(some))
            yield tuple(batch.column(k)[some[0]].as_py() for k in keys), batch.column("stripe")[some[0]].as_py(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, stripe, x in parts(batch):
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                sums[key, stripe] = sums.get((key, stripe), 0) + x[:, stripe * height : (stripe + 1) * height].T @ x
        for (key, stripe), total in sums.items():
            i, j = np.nonzero(np.arange(len(total))[:, None] + stripe * height <= np.arange(total.shape[1]))
            for lo in range(0, len(i), 1 << 18):
                a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(a), kinds[name]) for name, k in zip(keys, key)), pa.array((a + stripe * height).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=[*keys, "i", "j", "xy"])

    return spread.mapInArrow(run, schema).groupBy(*keys, "i", "j").agg(F.sum("xy").alias("xy"))


def correlation_preservation(points: DataFrame) -> DataFrame:
    """Absolute correlation of the two sides' feature correlations (off the diagonal, where both are defined); 1 for one feature."""
    g = written(gram(written(vectors(padded(points)), "vectors"), ["variant"]), "products")
    edge = g.where("i = 0").select("variant", F.col("j").alias("at"), (F.col("xy")).alias("sum"))
    size = edge.where("at = 0").select("variant", F.col("sum").alias("n"))
    own = g.where("i = j and i > 0").select("variant", F.col("i").alias("at"), F.col("xy").alias("square")).join(edge, ["variant", "at"]).join(size, "variant")
    # a row for each feature and side
    own = own.select("variant", "at", (F.col("sum") / F.col("n")).alias("mean"), "n", F.sqrt(F.greatest(F.col("square") / F.col("n") - F.pow(F.col("sum") / F.col("n"), 2), F.lit(0.0))).alias("sd"))
    a, b = (own.select("variant", "n", F.col("at").alias(k), F.col("mean").alias(f"mean_{k}"), F.col("sd").alias(f"sd_{k}")) for k in "ij")
    r = g.where("i > 0 and i < j").join(a, ["variant", "i"]).join(b.drop("n"), ["variant", "j"])
    r = r.where("sd_i > 1e-9 and sd_j > 1e-9").select("variant", "i", "j", ((F.col("xy") / F.col("n") - F.col("mean_i") * F.col("mean_j")) / (F.col("sd_i") * F.col("sd_j"))).alias("r"))
    both = by_side(r, ["i", "j"], "r").where("o is not null and s is not null")
    return both.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.coalesce(F.abs(pearson(F.col("o"), F.col("s"))), F.lit(0.0))).alias("correlation_preservation"))


def statistical_consistency(points: DataFrame) -> DataFrame:
    row = side_by_side([correlation_preservation(points), distribution_similarity(points)])
    return row.withColumn("statistical_score", (F.col("correlation_preservation") + F.col("distribution_similarity")) / 2)


def contexts(chain: DataFrame) -> DataFrame:
    """Each series of ``shape.chained`` points without its last value; series of one value have none."""
    return chain.where("not last")


def temporal_predictability(points: DataFrame) -> DataFrame:
    """Per column: 1 less the difference of the sides' lag-1 correlations over their contexts laid end to end; 0.3 where undefined."""
    return chained_predictability(written(chained(points), "chain"))


def chained_predictability(chain: DataFrame) -> DataFrame:
    """``temporal_predictability`` of points that are chained."""
    r = by_side(steps_across(contexts(chain)).groupBy("variant", "column").agg(pearson(F.col("x"), F.col("y")).alias("r")), ["column"], "r")
    return r.select("column", F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("o") - F.col("s"))), F.lit(0.3)).alias("temporal_predictability"))


def scale_ratio() -> Column:
    return ratio(F.least("mean_o", "mean_s"), F.greatest("mean_o", "mean_s"))


def distributional_predictability() -> Column:
    """From two_sided columns: how well mean and spread agree; 0.5 for a constant original. Means over 1000 are compared by their ratio too."""
    level = ratio(F.abs(F.col("mean_o") - F.col("mean_s")), F.col("hi_o") - F.col("lo_o"))
    large = (F.col("mean_o") > 1000) | (F.col("mean_s") > 1000)
    level = F.when(large, F.greatest(level, 1 - scale_ratio())).otherwise(level)
    spread = ratio(F.abs(F.col("sd_o") - F.col("sd_s")), F.col("sd_o"))
    return F.when((F.col("hi_o") > F.col("lo_o")) & (F.col("sd_o") > 0), F.greatest(F.lit(0.0), 1 - (level + spread) / 2)).otherwise(0.5)


def histogram_overlap(values: DataFrame, edges: int = DEFAULT.overlap_edges) -> DataFrame:
    """Per column: shared mass of the two sides' histograms with edges - 1 bins on the common range."""
    ranges = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *(F.count(of(x, F.col("value"))).alias(f"size_{x}") for x in SIDES))
    # a row for each column
    counts = values.join(F.broadcast(ranges.where("size_o > 0 and size_s > 0")), "column").withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), edges - 1)).groupBy("column", "size_o", "size_s", "bin").agg(*(F.count(of(x, F.col("value"))).alias(f"n_{x}") for x in SIDES))
    return counts.groupBy("column").agg(F.sum(F.least(F.col("n_o") / F.col("size_o"), F.col("n_s") / F.col("size_s"))).alias("overlap"))


def discriminative_similarity(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per column: mean of quartile similarity, range similarity and histogram overlap (scaled down where large means differ by half)."""
    values = without(points).where(F.col("value").isNotNull())
    per = two_sided(values, ["column"], quartiles=True).where("n_o > 0 and n_s > 0").join(histogram_overlap(values, config.overlap_edges), "column")
    large = ((F.col("mean_o") > 1000) | (F.col("mean_s") > 1000)) & (scale_ratio() < 0.5)
    return per.select("column", mean_of([quartile_similarity(), range_similarity(), F.when(large, F.col("overlap") * scale_ratio()).otherwise(F.col("overlap"))], 0.3).alias("discriminative_similarity"))


def column_utility(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per column of either side: overall_utility_score, correlation_preservation (lag-1 or distributional predictability), distribution_similarity."""
    values = written(chained(without(points).where(F.col("value").isNotNull())), "known")
    per = two_sided(values, ["column"])
    held = contexts(values).groupBy("column").agg(*(F.count(of(x, F.lit(1))).alias(f"held_{x}") for x in SIDES))
    names = without(points).select("column").distinct()
    joined = names.join(per, "column", "left").join(held, "column", "left").join(chained_predictability(values), "column", "left").join(discriminative_similarity(values, config), "column", "left")
    both = (F.coalesce("n_o", F.lit(0)) > 0) & (F.coalesce("n_s", F.lit(0)) > 0)
    capability = F.when(~both, 0.0).when((F.col("n_o") < 10) | (F.col("n_s") < 10), 0.1).when((F.col("held_o") > 5) & (F.col("held_s") > 5), F.col("temporal_predictability")).otherwise(distributional_predictability())
    out = joined.select("column", capability.alias("correlation_preservation"), F.when(both, F.col("discriminative_similarity")).otherwise(0.0).alias("distribution_similarity"))
    return out.select("column", (0.6 * F.col("correlation_preservation") + 0.4 * F.col("distribution_similarity")).alias("overall_utility_score"), "correlation_preservation", "distribution_similarity")


def bounded(row: DataFrame) -> DataFrame:
    """Utility scores kept within [0, 1]: downstream scores outside become 0, others the nearer end; NULL, NaN and infinite values 0."""
    out = {}
    for name in row.columns:
        x = F.when(F.isnan(name) | F.abs(F.col(name)).eqNullSafe(F.lit(float("inf"))), None).otherwise(F.col(name))
        out[name] = F.coalesce(F.when(x.between(0.0, 1.0), x).otherwise(0.0) if name.startswith("dt_") else clipped(x), F.lit(0.0)) if name.endswith(("_score", "_preservation", "_similarity")) else F.col(name)
    return row.select(*(c.alias(n) for n, c in out.items()))
