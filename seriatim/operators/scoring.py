"""From measures to decisions: weighted scores, averages, rankings and recommendations.

scores: gen_type, variant, variant_type ('synthetic' or 'baseline'), dimension, value. It has a row for each variant and dimension,
so windows over all of it stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import clipped

DIMENSIONS = ("diversity", "fidelity", "privacy", "utility")
#: Limits below which a dimension's average draws a remark.
LIMITS = (("diversity", 0.5, "LOW DIVERSITY"), ("fidelity", 0.6, "LOW FIDELITY"), ("privacy", 0.4, "PRIVACY RISK"), ("utility", 0.5, "LIMITED UTILITY"))

#: The order of columns in tables.
COLUMN_ORDER = ("Open", "High", "Low", "Close", "Volume", "col1", "col2", "col3")


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def overall_scores(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per variant: the four dimensions and their weighted sum within [0, 1]; undefined scores count 0."""
    wide = scores.groupBy("gen_type", "variant", "variant_type").pivot("dimension", list(DIMENSIONS)).agg(F.max(finite(F.col("value"))))
    terms = [w * F.coalesce(d, F.lit(0.0)) for d, w in config.dimension_weights]
    return wide.withColumn("overall_score", clipped(sum(terms[1:], terms[0])))


def metric_averages(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per generation type: mean of each dimension and of the overall score over synthetic variants; 0 where none is defined."""
    o = overall_scores(scores, config).where("variant_type <> 'baseline'")
    return o.groupBy("gen_type").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in (*DIMENSIONS, "overall_score")))


def synthetic(x: Column) -> Column:
    return F.when(F.col("variant_type") != "baseline", x)


def best_first() -> Column:
    """Orders variants by overall score, the largest first, and by name among equals."""
    return F.struct(-F.col("overall_score"), F.col("variant"))


def best_variants(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per generation type: the synthetic variant with the largest overall score, the first by name among equals."""
    o = overall_scores(scores, config).where("variant_type <> 'baseline'")
    return o.groupBy("gen_type").agg(F.max("overall_score").alias("overall_score"), F.min_by("variant", best_first()).alias("best_variant"))


def best_baseline() -> Column:
    """The largest overall score of any baseline."""
    return F.max(F.when(F.col("variant_type") == "baseline", F.col("overall_score"))).over(Window.partitionBy(F.lit(1)))


def recommendations(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(gen_type, recommendation): a remark for each dimension below its limit, one on the overall score, one on falling short of the best baseline."""
    means = [F.coalesce(F.avg(synthetic(F.col(c))), F.lit(0.0)).alias(c) for c in (*DIMENSIONS, "overall_score")]
    averages = overall_scores(scores, config).withColumn("baseline", best_baseline()).groupBy("gen_type").agg(F.max("baseline").alias("baseline"), *means).where("overall_score > 0")
    remarks = [F.when(F.col(d) < limit, F.lit(text)) for d, limit, text in LIMITS]
    overall = F.when(F.col("overall_score") > 0.7, "EXCELLENT").when(F.col("overall_score") > 0.5, "MODERATE").otherwise("POOR")
    short = F.when(F.col("overall_score") < F.col("baseline"), "UNDERPERFORMING")
    return averages.select("gen_type", F.explode(F.array(*remarks, overall, short)).alias("recommendation")).where("recommendation is not null")


def ranked_against_baseline(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per variant: overall score, its class, and the gap to the best baseline."""
    level = F.when(F.col("overall_score") >= 0.7, "good").when(F.col("overall_score") >= 0.5, "medium").otherwise("poor")
    return overall_scores(scores, config).select("gen_type", "variant", "variant_type", "overall_score", level.alias("score_class"), (best_baseline() - F.col("overall_score")).alias("gap"))


def method() -> Column:
    """A variant's name with its kind: B, C or U."""
    mark = F.when(F.col("variant_type") == "baseline", "B").when(F.col("gen_type") == "conditional", "C").otherwise("U")
    return F.concat("variant", F.lit(" ("), mark, F.lit(")")).alias("method")


def overall_bars(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every synthetic variant and the first baseline by name, each with its overall score and place among them."""
    first = F.min(F.when(F.col("variant_type") == "baseline", F.col("variant"))).over(Window.partitionBy(F.lit(1)))
    shown = overall_scores(scores, config).withColumn("first", first).where("variant_type <> 'baseline' or variant = first")
    return shown.select(method(), "overall_score", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("overall_score"))).alias("rank"))


def radar(scores: DataFrame) -> DataFrame:
    """Per method and dimension: place of the axis, angle in radians and score, 0 where missing."""
    wide = scores.groupBy("gen_type", "variant", "variant_type").pivot("dimension", list(DIMENSIONS)).agg(F.max(finite(F.col("value"))))
    axes = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("axis"), F.lit(2 * math.pi * k / len(DIMENSIONS)).alias("angle"), F.coalesce(d, F.lit(0.0)).alias("value")) for k, d in enumerate(DIMENSIONS)))
    return wide.select(method(), F.inline(axes))


def business_figures(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The scores of the best conditional variant, or of the best unconditional one where there is none; undefined scores count 0."""
    o = overall_scores(scores, config).where("variant_type <> 'baseline'")
    best = o.agg(F.min_by(F.struct("gen_type", "variant", *DIMENSIONS, "overall_score"), F.struct("gen_type", best_first())).alias("best")).select("best.*")
    return best.select("gen_type", "variant", *(F.coalesce(d, F.lit(0.0)).alias(d) for d in DIMENSIONS), "overall_score").where("variant is not null")


def column_place(column: Column) -> Column:
    """Where a column stands in a table: those of the fixed orders first, others after them, none (the whole) last."""
    known = F.array(*(F.lit(c) for c in COLUMN_ORDER))
    return F.when(column.isNull(), len(COLUMN_ORDER) + 2).when(F.array_contains(known, column), F.array_position(known, column)).otherwise(len(COLUMN_ORDER) + 1)


def column_table(scores: DataFrame) -> DataFrame:
    """Per method and column the four scores, 0 where missing, with each method's OVERALL row last.

    scores has a column beside the usual ones: the name of a series' column, or NULL for the whole.
    """
    wide = scores.groupBy("gen_type", "variant", "variant_type", "column").pivot("dimension", list(DIMENSIONS)).agg(F.max(finite(F.col("value"))))
    return wide.select("gen_type", method(), column_place(F.col("column")).cast("long").alias("place"), F.coalesce("column", F.lit("OVERALL")).alias("column"), *(F.coalesce(d, F.lit(0.0)).alias(d) for d in DIMENSIONS))


def heatmap(scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per method, named with its kind (B, C or U): the five scores, baselines first."""
    return overall_scores(scores, config).select(method(), F.when(F.col("variant_type") == "baseline", 0).otherwise(1).alias("place"), *DIMENSIONS, "overall_score")


def breakdown(scores: DataFrame) -> DataFrame:
    """Per dimension and variant: score by generation type, 0 where missing."""
    kinds = ["conditional", "unconditional"]
    wide = scores.groupBy("dimension", "variant").pivot("gen_type", kinds).agg(F.max("value"))
    return wide.select("dimension", "variant", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in kinds))


def column_comparison(scores: DataFrame) -> DataFrame:
    """Per variant and dimension: score, rank within the generation type and share of the best."""
    within = Window.partitionBy("gen_type", "dimension")  # a row for each variant
    rank = F.rank().over(within.orderBy(F.desc("value")))
    return scores.select("gen_type", "dimension", "variant", "value", rank.alias("rank"), F.try_divide("value", F.nullif(F.max("value").over(within), F.lit(0.0))).alias("share_of_best"))
