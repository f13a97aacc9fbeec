"""The whole evaluation: every measure of a variant as rows of one metrics table, and the tables of a report.

metrics: gen_type, variant, variant_type, dimension, column (NULL for the whole), metric, value. Rows of the dimension ``metadata`` say how many series either side
has, and of a variant whose evaluation failed that it did (metric ``error``, the message as column).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import diversity, fidelity, models, privacy, scoring, shape, utility
from ..sources.store import discard, written

Metric = Callable[[DataFrame, Config], DataFrame]
#: One-row measures by dimension. ``register`` adds to them.
WHOLE: dict[str, dict[str, Metric]] = {
    "diversity": {"all": diversity.all_diversity},
    "fidelity": {"all": fidelity.all_fidelity},
    "utility": {"statistical": lambda p, c: utility.statistical_consistency(p)},
    "privacy": {"distance": lambda p, c: privacy.distance_to_closest_record(p)},
}
#: Measures with a row for each column.
BY_COLUMN: dict[str, Metric] = {
    "diversity": diversity.column_diversity,
    "fidelity": lambda p, c: fidelity.column_fidelity(p),
    "utility": utility.column_utility,
}
#: Those that learn a model.
LEARNED: dict[str, dict[str, Metric]] = {
    "utility": {"predictive": models.predictive_score, "contextual": models.contextual_fid, "downstream": lambda p, c: models.downstream_tasks(p)},
}
LEARNED_BY_COLUMN: dict[str, Metric] = {"privacy": models.column_privacy}
AT_ONCE = 4


def register(dimension: str, name: str, metric: Metric) -> None:
    """Adds a measure of one's own: a function from points and config to a one-row frame."""
    WHOLE.setdefault(dimension, {})[name] = metric


def tall(frame: DataFrame, dimension: str, by_column: bool = False) -> DataFrame:
    names = [c for c, t in frame.dtypes if t == "double"]
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))
    return frame.select(F.lit(dimension).alias("dimension"), (F.col("column") if by_column else F.lit(None).cast("string")).alias("column"), F.inline(cells))


def attacked(points: DataFrame, config: Config) -> DataFrame:
    """The attack serves both utility and privacy, and is fitted once."""
    row = written(models.attack(points, config), "attack")
    return tall(row.select("ds_accuracy", "ds_score"), "utility").unionByName(tall(row.select("mi_accuracy", "mi_auc", "mi_risk_score"), "privacy"))


def evaluate(points: DataFrame, config: Config = DEFAULT, learned: bool = True) -> DataFrame:
    """(dimension, column, metric, value) of every measure, or of those that learn no model, as a written table.

    Points, and the matrices that several measures take from them, are written once and read by all measures, of which AT_ONCE are under way together.
    """
    points = written(points, "points")
    tasks: list[Callable[[], DataFrame]] = []
    for whole, columns in ((WHOLE, BY_COLUMN), *([(LEARNED, LEARNED_BY_COLUMN)] if learned else [])):
        tasks += [lambda m=metric, d=dimension: tall(m(points, config), d) for dimension, metrics in whole.items() for metric in metrics.values()]
        tasks += [lambda m=metric, d=dimension: tall(m(points, config), d, True) for dimension, metric in columns.items()]
    if learned:
        tasks.append(lambda: attacked(points, config))
    with shape.shared(points), ThreadPoolExecutor(AT_ONCE) as pool:
        frames = list(pool.map(lambda task: written(task(), "measures"), tasks))
    out = reduce(DataFrame.unionByName, frames)
    out = written(with_overall(out) if learned else out, "metrics")
    discard(points, *frames)
    return out


def with_overall(metrics: DataFrame) -> DataFrame:
    """Adds overall_privacy_score and overall_utility_score from their parts: (distance + 1 - attack accuracy) / 2, and the mean of the five scores."""
    whole = metrics.where("column is null")

    def value(name: str):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    scores = ["ds_score", "ps_score", "cfid_score", "dt_overall_score", "statistical_score"]
    row = whole.agg(((value("dcr_mean") + F.greatest(F.lit(0.0), 1 - value("mi_accuracy"))) / 2).alias("overall_privacy_score"), F.avg(F.when(F.col("metric").isin(scores), scoring.finite(F.col("value")))).alias("overall_utility_score"))
    return metrics.unionByName(tall(row.select("overall_privacy_score"), "privacy")).unionByName(tall(row.select("overall_utility_score"), "utility"))


def empty(spark: SparkSession) -> DataFrame:
    """The rows of a variant that cannot be evaluated: every overall score is 0."""
    rows = [(d, None, f"overall_{d}_score", 0.0) for d in scoring.DIMENSIONS]
    return spark.createDataFrame(rows, "dimension string, column string, metric string, value double")


def failed(spark: SparkSession, message: str) -> DataFrame:
    """The rows of a variant that could not be evaluated: zeros and the reason."""
    first = (message.strip().splitlines() or [""])[0][:200]
    return empty(spark).unionByName(spark.createDataFrame([("metadata", first, "error", 1.0)], "dimension string, column string, metric string, value double"))


def evaluate_all(variants: dict[tuple[str, str], DataFrame], baselines: tuple[str, ...] = ("original_noise",), config: Config = DEFAULT, learned: bool = True) -> DataFrame:
    """metrics of several variants, given as points by (generation type, variant), as a written table.

    The variants are evaluated beside one another. One whose points or measures raise, or that has no rows on a side, has zeros and an error row, and
    does not keep the others from being evaluated.
    """
    spark = next(iter(variants.values())).sparkSession

    def one(entry: tuple[tuple[str, str], DataFrame]) -> DataFrame:
        (gen_type, variant), points = entry
        try:
            own = written(points, "variant")
            sizes = dict(own.groupBy("variant").agg(F.countDistinct("series")).collect())
            sides = [("metadata", None, name, float(sizes.get(side, 0))) for side, name in (("o", "original_samples"), ("s", "synthetic_samples"))]
            rows = evaluate(own, config, learned) if len(sizes) == 2 else failed(spark, "no rows on a side")
            rows = rows.unionByName(spark.createDataFrame(sides, "dimension string, column string, metric string, value double"))
        except Exception as error:  # whatever it is, it is this variant's
            rows = failed(spark, f"{type(error).__name__}: {error}")
        kind = "baseline" if variant in baselines else "synthetic"
        return rows.select(F.lit(gen_type).alias("gen_type"), F.lit(variant).alias("variant"), F.lit(kind).alias("variant_type"), "dimension", "column", "metric", "value")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        frames = list(pool.map(one, variants.items()))
    return written(reduce(DataFrame.unionByName, frames), "evaluation")


#: The score of a column in each dimension.
COLUMN_SCORES = {"diversity": "column_diversity_score", "fidelity": "column_fidelity_score", "privacy": "overall_privacy_score", "utility": "overall_utility_score"}


def column_scores(metrics: DataFrame) -> DataFrame:
    """The scores of each column, and of the whole where column is NULL, for ``scoring.column_table``."""
    name = F.when(F.col("column").isNull(), F.concat(F.lit("overall_"), "dimension", F.lit("_score")))
    for dimension, metric in COLUMN_SCORES.items():
        name = name.when(F.col("dimension") == dimension, metric)
    return metrics.where(F.col("metric") == name).select("gen_type", "variant", "variant_type", "column", "dimension", "value")


def scores(metrics: DataFrame) -> DataFrame:
    """The four dimension scores of each variant, for ``scoring``."""
    return metrics.where(F.col("column").isNull() & (F.col("metric") == F.concat(F.lit("overall_"), "dimension", F.lit("_score")))).select("gen_type", "variant", "variant_type", "dimension", "value")
