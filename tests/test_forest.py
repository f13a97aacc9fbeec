"""Forests of many keys, the drawn split and column privacy, by invariants."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriatim.config import Config
from seriatim.operators import forest, models

POINTS = "variant string, series long, ord int, t int, column string, col_ord int, value double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for key, p in (("apart", 12), ("same", 30), ("xor", 4)):
        for i in range(300):
            x, y = rng.normal(size=p), int(i % 2)
            x[3] += 6 * y * (key == "apart")
            if key == "xor":
                y = int((x[0] > 0) != (x[1] > 0))
            out.append((key, i, y, bool(rng.random() < 0.3), [float(v) for v in x]))
    return out


def test_forests_learn_what_can_be_learned_and_do_not_depend_on_dealing(spark, rows):
    df = spark.createDataFrame(rows, "key string, id long, label int, test boolean, v array<double>")
    got = [forest.predicted(df.repartition(n), trees=20, depth=6).toPandas() for n in (1, 5)]
    assert np.allclose(*(np.sort(x["p"]) for x in got)) and len(got[0]) == sum(r[3] for r in rows)
    hit = got[0].assign(hit=(got[0]["p"] > 0.5) == (got[0]["label"] == 1)).groupby("key")["hit"].mean()
    assert hit["apart"] == 1 and hit["xor"] > 0.85 and 0.3 < hit["same"] < 0.7


def test_the_first_cut_is_the_best_of_all(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.integers(0, 2, 60)
    monkeypatch.setattr(forest, "weights", lambda ids, trees, seed: np.ones((len(ids), trees), int))
    df = spark.createDataFrame([("k", i, int(y[i]), False, [float(x[i])]) for i in range(60)], "key string, id long, label int, test boolean, v array<double>")
    _, forests = forest.fitted(df, 1, 1, 0)
    bins = np.clip((x - x.min()) * (forest.BINS / (x.max() - x.min())), 0, forest.BINS - 1).astype(int)

    def left(cut):
        parts = y[bins <= cut], y[bins > cut]
        return sum(p.sum() * (len(p) - p.sum()) / len(p) for p in parts if len(p))

    cut = forests["k"].cut[0, 0]
    assert forests["k"].feature[0, 0] == 0 and math.isclose(left(cut), min(map(left, range(forest.BINS - 1))))
    assert np.isclose(forests["k"].leaf[0, 1], y[bins <= cut].mean()) and np.isclose(forests["k"].leaf[0, 2], y[bins > cut].mean())


def table(spark, o, s):
    return spark.createDataFrame([(v, i, i, t, c, k, float(x[i, t, k])) for v, x in (("o", o), ("s", s)) for i in range(x.shape[0]) for t in range(x.shape[1]) for k, c in enumerate("abcd"[: x.shape[2]])], POINTS)


@pytest.mark.parametrize("n, m", [(20, 27), (11, 11), (7, 5)])
def test_test_side_is_a_share_of_both_sides(spark, n, m):
    rng = np.random.default_rng(2)
    got = models.attack_split(table(spark, rng.normal(size=(n, 6, 1)), rng.normal(size=(m, 6, 1)))).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("test").cast("int")).alias("test"))
    least = min(n, m)
    total = math.ceil(round(0.6 * least, 9))
    assert {(r["variant"], r["n"], r["test"]) for r in got.collect()} == {("o", least, -(-total // 2)), ("s", least, total // 2)}


def test_column_privacy_of_equal_shifted_and_missing_columns(spark):
    rng = np.random.default_rng(3)
    o, s = rng.normal(size=(40, 10, 3)), rng.normal(size=(40, 10, 3))
    s[:, :, 1] = np.sort(s[:, :, 1], axis=1)  # always rising: easy to tell
    p = table(spark, o, s).where("not (column = 'c' and variant = 's')")
    got = {r["column"]: r for r in models.column_privacy(p, Config(trees=20, depth=5)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["b"]["mir_accuracy"] > 0.9 and abs(got["a"]["mir_accuracy"] - 0.5) < 0.3
    for c in "ab":
        r = got[c]
        assert math.isclose(r["mir_score"], 1 - r["mir_accuracy"]) and math.isclose(r["overall_privacy_score"], (r["dcr_mean"] + r["mir_score"]) / 2) and 0 < r["dcr_mean"] <= 1
    assert (got["c"]["overall_privacy_score"], got["c"]["mir_accuracy"]) == (0.1, 0.9)
    same = models.column_privacy(table(spark, o[:, :, :1], o[:, :, :1]), Config(trees=5, depth=3)).first()
    assert same["dcr_mean"] == 0
    few = models.column_privacy(table(spark, o[:4, :, :1], s[:4, :, :1])).first()
    assert few["mir_accuracy"] == 0.5


def test_parts_are_gathered_over_batches(monkeypatch):
    """Rows of many keys in small batches leave a part for each key, not for each batch; a part has ROWS rows at most."""
    monkeypatch.setattr(forest, "ROWS", 50)
    names = ["key", "id", "label", "bins"]
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 5), pa.array(range(10 * i, 10 * i + 10)), pa.array([0, 1] * 5, pa.int32()), pa.array([bytes([i, j]) for j in range(10)])], names=names) for i in range(24)]
    got = list(forest.parts(iter(batches)))
    assert sorted((key, len(ids)) for key, ids, _, _ in got) == sorted([("a", 50), ("a", 50), ("a", 20), ("b", 50), ("b", 50), ("b", 20)])
    rows = {int(i): (key, int(label), tuple(x)) for key, ids, labels, bins in got for i, label, x in zip(ids, labels, bins)}
    assert rows == {10 * i + j: ("ab"[j % 2], j % 2, (i, j)) for i in range(24) for j in range(10)}
