"""Hard negatives against all pairs."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriatim.llm import hard_negatives
from seriatim.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, k=5):
    """Rows (anchor, positive, rank, negative, scores) with multiplicity."""
    ok = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in ok:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            near = [(t, n) for t, n, m in scored if m != label and -80 * s <= -100 * t <= -100 * s][:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(near)]
    return collections.Counter(out)


def taken(df):
    return collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 24))
    real = [(i, int(rng.integers(0, 4)), [float(x) for x in (centres[i % 6] + 0.4 * rng.normal(size=24)).astype(np.float32)]) for i in range(400)]
    copies = [(1000 + i, i % 3, real[0][2]) for i in range(150)]  # many copies, so ties
    odd = [(2000, 1, None), (2010, None, real[1][2]), (None, 1, real[2][2]), (2020, 1, [float("nan")] * 24), (2030, 1, [None] + real[3][2][1:]), (2040, 1, [0.0] * 24), (2050, 0, real[5][2]), (2050, 0, real[5][2]), (2060, 1, [1.0, 2.0]), (2070, 2, [1.0, 1.5]), (2080, 1, [1.0, 1.75]), (2090, 1, []), (2091, 2, [])]
    return real + copies + odd


@pytest.mark.parametrize("group", [16, 64, 4096])
def test_pairs_are_those_of_all_scores(spark, rows, group, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", x string, row int").repartition(3)
    got = taken(hard_negatives.mine(df, F.col("vec_id") % 10 == 0))
    assert got == plain(rows, lambda i: i % 10 == 0) and sum(got.values()) > 100


def test_query_is_that_of_all_scores(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert taken(op13_hard_negatives(spark, sf)) == plain(rows, lambda i: i % 100 == 0)


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(3)
    a, x = (np.floor(256 * rng.normal(size=(n, 19))) for n in (7, 300))
    for s in hard_negatives.levels(19):
        (size, m, d), (_, mean, deviation) = hard_negatives.summaries(a, s), hard_negatives.summaries(x, s)
        assert (np.abs(a @ x.T - (m * size) @ mean.T) <= d @ deviation.T + 1e-6).all()
    many = [hard_negatives.Rows(np.arange(len(v)), np.arange(len(v)) + off, np.zeros(len(v)), v) for v, off in ((a, 1000), (x, 0))]
    columns, _ = hard_negatives.surviving(*many, {s: hard_negatives.summaries(x, s) for s in hard_negatives.levels(19)}, np.ones((7, 300), bool), np.full((7, 1), int((a @ x.T).max())), np.full((7, 1), hard_negatives.MOST))
    assert int((a @ x.T).max(axis=0).argmax()) in columns and len(columns) < 300


def test_anchors_go_only_where_a_bound_lets_them(spark):
    rng = np.random.default_rng(4)
    centres = 20 * np.eye(8, 16)
    rows = [(i, 0, [float(v) for v in centres[i % 8] + 0.1 * rng.normal(size=16)]) for i in range(800)]
    hard_negatives_group, hard_negatives.GROUP = hard_negatives.GROUP, 100
    try:
        groups = hard_negatives.grouped(hard_negatives.prepared(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, "vec_id", "label", "embedding"))
        own = hard_negatives.own_search(groups, 5)
        anchors = own.where("kind = 1").select("d", "row", "id", "label", "q", F.array("bound").alias("least"), F.array(F.lit(hard_negatives.MOST)).alias("most"))
        assert anchors.count() == 80 and hard_negatives.sent(anchors, own).count() < 80 * groups.count() / 2
    finally:
        hard_negatives.GROUP = hard_negatives_group


def test_large_components_and_empty_tables(spark):
    rows = [(0, 1, [1e18, 1.0]), (1, 1, [1.0, 1e18]), (2, 2, [0.9, 2.0]), (3, 2, [1e30, 1e30]), (4, 1, [3e6, 3e6]), (5, 2, [2.9e6, 3e6]), (100, 1, [3.1e6, 2.9e6])]
    got = taken(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    assert (100, 4, 1, 5) in {x[:4] for x in got}
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_anchors_beside_every_group_are_not_broadcast(spark, rows):
    """Tables are small here, so any join that the optimizer is left alone with is a broadcast."""
    table = spark.createDataFrame(rows, SCHEMA)
    groups = hard_negatives.grouped(hard_negatives.prepared(table, F.col("vec_id") % 10 == 0, "vec_id", "label", "embedding"))
    own = hard_negatives.own_search(groups, 5)
    anchors = own.where("kind = 1").select("d", "row", "id", "label", "q", F.array("bound").alias("least"), F.array(F.lit(hard_negatives.MOST)).alias("most"))
    got = hard_negatives.found(anchors, own, groups, True, 5)
    assert got.count() > 0 and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
