"""Measures by learned models. Forests and logistic fits are Spark ML's; least squares works on summed products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import ORIGINAL, SYNTHETIC, clipped, of
from ..sources.store import written
from . import forest
from .fidelity import reranked
from .privacy import column_distances, column_distributional_privacy
from .ranks import numbered, percentiles
from .shape import lagged, padded, padded_columns, vectors, without
from .utility import SIDES, gram

FOLDS = 3


def one_row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in values.values())], ", ".join(f"{k} double" for k in values))


def split(rows: DataFrame, config: Config = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows that an attack works on, with ``test``: each side (of each key) cut to the size of the smaller one, in order of ord, and a share of both sides drawn for the test.

    ``rows`` (keys, variant, series, ord) are a row for each series. The test side has ceil(share * n) of all n rows, half from each side, the odd one from the original: the first by the
    MD5 of key, variant, place and seed. A key with one side has no rows.
    """
    placed = numbered(rows.withColumnRenamed("ord", "before"), [*keys, "variant"], ["before", "series"], "ord")
    sizes = placed.groupBy(*keys, "variant").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sides")).where("sides = 2")
    sizes = sizes if keys else sizes.select(F.lit(1).alias("one"), "least")
    chosen = (placed if keys else placed.withColumn("one", F.lit(1))).join(sizes.select(*(keys or ["one"]), "least"), [*(keys or ["one"])]).where(F.col("ord") < F.col("least"))
    drawn = chosen.withColumn("draw", F.md5(F.concat_ws(":", *keys, "variant", F.col("ord").cast("string"), F.lit(str(config.seed)))))
    total = F.ceil(F.lit(2 * config.test_share) * F.col("least") - 1e-9)  # 0.3 has no exact binary form
    share = F.when(F.col("variant") == ORIGINAL, F.ceil(total / 2)).otherwise(F.floor(total / 2))
    ranked = numbered(drawn, [*keys, "variant"], ["draw", "ord"], "place")
    return ranked.withColumn("test", F.col("place") < share).drop("before", "draw", "place", "one")


def attack(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A forest that tells original from synthetic rows: ds_accuracy, ds_score, mi_accuracy, mi_auc, mi_risk_score in one row.

    Both measures rest on the same rows, split and model, so it is fitted once. Trees do not depend on scaling. Fewer than 10 rows: 0.5, 0, 0.5, 0.5, 0.
    """
    spark = points.sparkSession
    rows = written(split(vectors(padded(points)), config), "attacked")
    chosen = rows.select(array_to_vector("v").alias("features"), (F.col("variant") == ORIGINAL).cast("double").alias("label"), "test")
    if rows.count() < 10:
        return one_row(spark, ds_accuracy=0.5, ds_score=0, mi_accuracy=0.5, mi_auc=0.5, mi_risk_score=0)
    model = RandomForestClassifier(numTrees=config.trees, maxDepth=config.depth, seed=config.seed).fit(chosen.where("not test"))
    tested = model.transform(chosen.where("test")).select("label", "prediction", "probability", "rawPrediction").cache()
    accuracy = tested.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    auc = BinaryClassificationEvaluator().evaluate(tested) if accuracy is not None else 0.5
    tested.unpersist()
    accuracy = 0.5 if accuracy is None else accuracy
    return one_row(spark, ds_accuracy=accuracy, ds_score=abs(0.5 - accuracy), mi_accuracy=accuracy, mi_auc=auc, mi_risk_score=max(0.0, 2 * (accuracy - 0.5)))


def attack_split(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """variant, ord, test of the rows of ``attack``."""
    return split(vectors(padded(points)), config).select("variant", "ord", "test")


def discriminative_score(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return attack(points, config).select("ds_accuracy", "ds_score")


def membership_inference(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return attack(points, config).select("mi_accuracy", "mi_auc", "mi_risk_score")


def predictive_score(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A forest that predicts the next value from the ones before, learned on the synthetic and tested on the original side."""
    known = lagged(points, config.horizon).where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull())).select("variant", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    n = known.agg(*(F.count(of(x, F.lit(1))) for x in SIDES)).first()
    if min(n) < 10:
        return one_row(points.sparkSession, ps_mae=1, ps_mse_ratio=1, ps_r2_diff=1, ps_score=0)
    model = RandomForestRegressor(numTrees=config.trees, maxDepth=config.depth, seed=config.seed).fit(known.where(F.col("variant") == SYNTHETIC))
    off = F.col("label") - F.col("prediction")
    row = model.transform(known.where(F.col("variant") == ORIGINAL)).agg(F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.var_pop("label").alias("var"))
    return row.select(F.col("mae").alias("ps_mae"), (F.col("mse") / (F.col("var") + 1e-10)).alias("ps_mse_ratio"), F.coalesce(F.greatest(F.lit(0.0), F.try_divide("mse", F.nullif("var", F.lit(0.0)))), F.lit(1.0)).alias("ps_r2_diff"), (1 / (1 + F.col("mae"))).alias("ps_score"))


def covariances(rows: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, sample covariance) of the vectors v of each side, from products summed up task by task; k x k numbers come to the driver."""
    out = []
    sums = gram(rows, ["variant"]).collect()  # k + 1 squared for each side
    for side in SIDES:
        m = np.zeros((k + 1, k + 1))
        for variant, i, j, xy in sums:
            if variant == side:
                m[i, j] = m[j, i] = xy
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        out.append((mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)))
    return out


def frechet(original: tuple[np.ndarray, np.ndarray], synthetic: tuple[np.ndarray, np.ndarray]) -> float:
    """Squared distance of the means and trace of a + b - 2 * root(a b); the root's trace is that of the symmetric root(root(a) b root(a))."""
    (x, a), (y, b) = original, synthetic
    values, vectors_ = np.linalg.eigh(a)
    root = (vectors_ * np.sqrt(np.maximum(values, 0))) @ vectors_.T
    shared = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum()
    return float(((x - y) ** 2).sum() + max(0.0, np.trace(a) + np.trace(b) - 2 * shared))


def contextual_fid(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Frechet-like distance of the two sides in the principal components of their union, within [0.1, 10].

    The spread is compared by the traces of the covariances, or with ``full_covariance`` by the root of their product, as the Frechet distance has it.
    """
    rows = vectors(padded(points)).where(F.forall("v", lambda x: x.isNotNull())).select("variant", array_to_vector("v").alias("features"), F.size("v").alias("size"))
    n, size, sides = rows.agg(F.count(F.lit(1)), F.min("size"), F.countDistinct("variant")).first()
    if n < 4 or sides < 2 or not size:
        return one_row(points.sparkSession, cfid_distance=2.0, cfid_score=0.33)
    k = min(config.components, size, n - 1)
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    if config.full_covariance:
        d = float(np.clip(frechet(*covariances(model.transform(rows).select("variant", vector_to_array("p").alias("v")), k)), 0.1, 10.0))
        return one_row(points.sparkSession, cfid_distance=d, cfid_score=1 / (1 + d))
    parts = model.transform(rows).select("variant", F.posexplode(vector_to_array("p")).alias("c", "x"))
    per = parts.groupBy("c").agg(*(agg(of(s, F.col("x"))).alias(f"{name}_{s}") for s in SIDES for name, agg in (("mean", F.avg), ("var", F.var_samp))))
    row = per.agg(F.sum(F.pow(F.col("mean_o") - F.col("mean_s"), 2)).alias("means"), *(F.sum(f"var_{s}").alias(f"trace_{s}") for s in SIDES))
    distance = F.col("means") + F.greatest(F.lit(0.0), F.col("trace_o") + F.col("trace_s") - 2 * F.sqrt(F.col("trace_o") * F.col("trace_s")))
    d = F.coalesce(clipped(distance, 0.1, 10.0), F.lit(2.0))
    return row.select(d.alias("cfid_distance"), F.when(distance.isNull(), 0.33).otherwise(1 / (1 + d)).alias("cfid_score"))


def folded(rows: DataFrame) -> DataFrame:
    """Contiguous folds of each side in order of ord."""
    n = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    # a row for each side
    return rows.join(F.broadcast(n), "variant").withColumn("fold", F.floor(F.col("ord") * FOLDS / F.col("n")).cast("int"))


def regression_similarity(rows: DataFrame) -> float:
    """Least squares for the last feature from the others (the shortest solution where it is not unique), R2 over folds on each side, compared."""
    sums = gram(rows, ["variant", "fold"]).toPandas()  # a matrix of features for each side and fold
    fits = {}
    for variant, part in sums.groupby("variant"):
        size = int(part["j"].max()) + 1
        by_fold = {}
        for fold, cells in part.groupby("fold"):
            m = np.zeros((size, size))
            m[cells["i"], cells["j"]] = cells["xy"]
            by_fold[fold] = m + np.triu(m, 1).T
        scores = []
        for fold, test in by_fold.items():
            train = sum(m for k, m in by_fold.items() if k != fold)
            if np.ndim(train) == 0 or train[0, 0] < 2 or test[0, 0] < 2:
                return 0.0
            mean = train[0, 1:] / train[0, 0]
            centred = train[1:, 1:] - np.outer(mean, mean) * train[0, 0]
            w = np.linalg.pinv(centred[:-1, :-1], rcond=1e-10, hermitian=True) @ centred[:-1, -1]
            b = np.concatenate([[mean[-1] - w @ mean[:-1]], w, [-1.0]])  # prediction less target
            residual = b @ test @ b
            total = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
            scores.append(1 - residual / total if total > 0 else 0.0)
        fits[variant] = float(np.mean(scores))
    if len(fits) < 2:
        return 0.0
    a, b = fits[ORIGINAL], fits[SYNTHETIC]
    if a < 0 and b < 0:
        return max(0.0, 1 - abs(a - b) / max(abs(a), abs(b), 1.0))
    return max(0.0, 1 - abs(a - b)) if a >= 0 and b >= 0 else 0.0


NEWTON_STEPS = 12


def logistic_step(data: DataFrame, weights: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """For each model (side, fold left out): the sums (gradient beside Hessian) of a Newton step over its training rows, added up task by task."""
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(w), len(w) + 1)) for k, w in shared.value.items()}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            variant, fold, y = (np.array(batch.column(c).to_pylist()) for c in ("variant", "fold", "label"))
            for (side, out), w in shared.value.items():
                rows = (variant == side) & (fold != out)
                p = 1 / (1 + np.exp(-np.clip(x[rows] @ w, -30, 30)))
                sums[side, out][:, 0] += x[rows].T @ (p - y[rows])
                sums[side, out][:, 1:] += (x[rows] * (p * (1 - p))[:, None]).T @ x[rows]
        for (side, out), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([side] * total.size), pa.array(np.full(total.size, out, np.int32)), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["side", "out", "at", "x"])

    got = data.mapInArrow(run, "side string, out int, at int, x double").groupBy("side", "out", "at").agg(F.sum("x").alias("x")).toPandas()
    out = {k: np.zeros(len(w) * (len(w) + 1)) for k, w in weights.items()}
    for (side, fold), part in got.groupby(["side", "out"]):
        out[side, fold][part["at"]] = part["x"]
    return {k: v.reshape(len(weights[k]), -1) for k, v in out.items()}


def classification_similarity(rows: DataFrame, features: int) -> float:
    """Logistic regression (L2, weight 1) for 'last feature above its median' from the others, accuracy over folds on each side, compared."""
    last = F.element_at("v", -1)
    median = percentiles(rows.select("variant", last.alias("value")), ["variant"], [0.5]).select("variant", F.col("q")[0].alias("median"))
    # a row for each side
    labelled = rows.join(F.broadcast(median), "variant").withColumn("label", (last > F.col("median")).cast("int"))
    labelled = numbered(labelled, ["variant", "label"], ["ord"], "place")  # folds keep the share of the classes
    data = labelled.select("variant", "label", (F.col("place") % FOLDS).cast("int").alias("fold"), F.slice("v", F.lit(1), F.size("v") - 1).alias("x")).cache()
    classes = data.groupBy("variant").agg(F.countDistinct("label").alias("k")).collect()
    if len(classes) < 2 or any(r["k"] < 2 for r in classes):
        data.unpersist()
        return 0.0
    weights = {(side, fold): np.zeros(features) for side in SIDES for fold in range(FOLDS)}
    ridge = np.diag([0.0, *[1.0] * (features - 1)])
    for _ in range(NEWTON_STEPS):
        moved = 0.0
        for k, sums in logistic_step(data, weights).items():
            step = np.linalg.solve(sums[:, 1:] + ridge + 1e-9 * np.eye(features), sums[:, 0] + ridge @ weights[k])
            weights[k] = weights[k] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    models = F.create_map(*(x for k, w in weights.items() for x in (F.lit(f"{k[0]}{k[1]}"), F.array(*(F.lit(float(v)) for v in w)))))
    w = F.element_at(models, F.concat("variant", F.col("fold").cast("string")))
    linear = F.element_at(w, 1) + F.aggregate(F.zip_with("x", F.slice(w, 2, features - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    right = data.groupBy("variant", "fold").agg(F.avg(((linear > 0).cast("int") == F.col("label")).cast("double")).alias("hit")).groupBy("variant").agg(F.avg("hit").alias("hit")).collect()
    data.unpersist()
    return 1 - abs(right[0]["hit"] - right[1]["hit"])


def downstream_tasks(points: DataFrame) -> DataFrame:
    rows = folded(vectors(reranked(padded(points)))).cache()
    size = rows.agg(F.min(F.size("v"))).first()[0] or 0
    a, b = (classification_similarity(rows, size), regression_similarity(rows)) if size >= 2 else (0.0, 0.0)
    rows.unpersist()
    return one_row(points.sparkSession, dt_classification_score=a, dt_regression_score=b, dt_overall_score=(a + b) / 2)


def column_attacks(matrices: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(key, mir_accuracy) of the matrices of columns: an attack on each column alone, all of them fitted together. Fewer than 10 rows: 0.5."""
    rows = written(split(vectors(matrices, ("key",)), config, ("key",)), "attacked")
    few = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n < 10")
    chosen = rows.join(few, "key", "left_anti").select("key", F.xxhash64("variant", "ord").alias("id"), (F.col("variant") == ORIGINAL).cast("int").alias("label"), "test", "v")
    hit = ((F.col("p") > 0.5).cast("int") == F.col("label")).cast("double")
    tried = forest.predicted(chosen, config.trees, config.depth, config.seed).groupBy("key").agg(F.avg(hit).alias("mir_accuracy"))
    return tried.unionByName(few.select("key", F.lit(0.5).alias("mir_accuracy")))


def column_privacy(points: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per column of either side: overall_privacy_score, dcr_mean, mir_accuracy, mir_score. One forest job serves all columns, with a pass for each level.

    A column that one side lacks has the figures of the distributional form.
    """
    own = written(without(points).where(F.col("value").isNotNull()), "known")
    matrices = written(padded_columns(own), "matrices")
    both = column_distances(matrices).join(column_attacks(matrices, config), "key").withColumnRenamed("key", "column")
    mir = F.greatest(F.lit(0.0), 1 - F.col("mir_accuracy"))
    found = written(both.select("column", ((F.col("dcr_mean") + mir) / 2).alias("overall_privacy_score"), "dcr_mean", "mir_accuracy", mir.alias("mir_score")), "column_privacy")
    return found.unionByName(column_distributional_privacy(own).join(found, "column", "left_anti"))
