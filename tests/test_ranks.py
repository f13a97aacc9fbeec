"""Exact percentiles, numbering and pruned nearest rows against numpy."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriatim.operators import nearest, ranks

AT = [0, 0.01, 0.25, 0.5, 0.75, 0.95, 1]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    rows = [("normal", float(x)) for x in rng.normal(size=3001)] + [("wide", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 1500)]
    rows += [("constant", 7.0)] * 1000 + [("few", float(x)) for x in rng.integers(0, 3, 1000)] + [("heavy", 5.0)] * 2000
    return rows + [("heavy", x) for x in (1.0, 2.0, 4.0, 5.5, 6.0, 7.0)] + [("one", 1.5), ("none", None)]


@pytest.mark.parametrize("limit", [ranks.LIMIT, 50, 3])
def test_percentiles_are_exact_however_ranges_are_narrowed(spark, values, limit):
    df = spark.createDataFrame(values, "k string, value double").repartition(3)
    got = {r["k"]: r["q"] for r in ranks.percentiles(df, ["k"], AT, limit).collect()}
    assert set(got) == {"normal", "wide", "constant", "few", "heavy", "one"}
    for k, q in got.items():
        assert np.allclose(q, np.percentile([v for kk, v in values if kk == k], [100 * x for x in AT]), rtol=1e-12), k


def test_percentiles_without_keys_or_values(spark, values):
    df = spark.createDataFrame(values, "k string, value double")
    (row,) = ranks.percentiles(df, [], [0.5], 100).collect()
    assert np.isclose(row["q"][0], np.percentile([v for _, v in values if v is not None], 50))
    assert ranks.percentiles(df.limit(0), ["k"], AT).count() == 0 and ranks.percentiles(df.where("value is null"), [], AT).count() == 0


def test_numbers_run_within_each_side(spark):
    rows = [("o" if i % 3 else "s", f"id{i:05d}", i) for i in range(2000)] + [("p", "only", 0)]
    ids = spark.createDataFrame(rows, "variant string, series string, other int").repartition(7)
    got = ranks.numbered(ids, ["variant"], ["series"]).toPandas().sort_values("series")
    assert (got["ord"] == got.groupby("variant").cumcount()).all() and len(got) == len(rows)
    assert ranks.numbered(ids.limit(0), ["variant"], ["series"]).count() == 0


def clustered(n, clusters, seed, width=6):
    rng = np.random.default_rng(seed)
    centres = 30 * np.random.default_rng(1).normal(size=(clusters, width))
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "series long, v array<double>")


@pytest.mark.parametrize("k, size", [(1, 16), (3, 16), (3, 4096), (40, 8)])
def test_pruned_nearest_rows_are_those_of_all_pairs(spark, k, size):
    x, y = clustered(120, 12, 2), np.concatenate([clustered(160, 12, 3), clustered(10, 12, 2)])  # some equal rows
    got = nearest.nearest(frame(spark, x), frame(spark, y), k, size).collect()
    want = np.sort(np.sqrt(((x[:, None] - y) ** 2).sum(axis=2)), axis=1)[:, :k]
    assert len(got) == want.size and all(abs(r["distance"] - want[r["series"], r["rank"] - 1]) < 1e-9 for r in got)


def test_fewer_others_than_wanted_and_unknown_cells(spark):
    x = frame(spark, clustered(5, 2, 2))
    odd = x.unionByName(spark.createDataFrame([(99, [None] * 6)], x.schema))
    got = nearest.nearest(odd, odd.where("series in (0, 1, 99)"), 4).groupBy("series").count().collect()
    assert {(r["series"], r["count"]) for r in got} == {(i, 2) for i in range(5)}
    assert nearest.nearest(x, x.limit(0)).count() == 0 and nearest.nearest(x.limit(0), x).count() == 0


def brute(x, y, k):
    return np.sort(np.sqrt(((x[:, None] - y) ** 2).sum(axis=2)), axis=1)[:, :k]


def test_unrelated_rows_are_compared_without_copies_for_every_block(spark, monkeypatch):
    """Where nothing can be excluded each row would be sent to all of over 20 blocks."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 30)), rng.normal(size=(200, 30))
    copies, searched = [], nearest.searched
    monkeypatch.setattr(nearest, "searched", lambda cells, *rest: copies.append(cells.count()) or searched(cells, *rest))
    got = nearest.nearest(frame(spark, x), frame(spark, y), 3, 8).collect()
    assert len(got) == 450 and all(abs(r["distance"] - brute(x, y, 3)[r["series"], r["rank"] - 1]) < 1e-9 for r in got)
    assert sum(copies) <= 4 * len(x)


@pytest.mark.parametrize("size", [8, 4096])
def test_rows_of_several_keys_meet_their_own_in_one_search(spark, size):
    rng = np.random.default_rng(5)
    sides = {"a": (clustered(60, 12, 2), clustered(90, 12, 3)), "b": (rng.normal(size=(50, 9)), rng.normal(size=(70, 9))), "lone": (rng.normal(size=(5, 2)), np.zeros((0, 2)))}
    x, y = (reduce(lambda a, b: a.unionByName(b), [frame(spark, side[i]).withColumn("key", F.lit(key)) for key, side in sides.items() if len(side[i])]) for i in (0, 1))
    got = nearest.nearest(x, y, 2, size).collect()
    want = {key: brute(*side, 2) for key, side in sides.items() if len(side[1])}
    assert len(got) == 2 * (60 + 50) and all(abs(r["distance"] - want[r["key"]][r["series"], r["rank"] - 1]) < 1e-9 for r in got)


def cells(spark, n):
    """How many (row, block) cells are searched, and how many there are."""
    x, blocks = frame(spark, clustered(n, 16, 5)), nearest.Blocks(frame(spark, clustered(n, 16, 6)), 25)
    home = nearest.searched(nearest.sent(x, blocks, True), blocks, 1, n)
    reach = home.groupBy("series").agg(F.max("distance").alias("reach"))
    return n + nearest.sent(x.join(reach, "series"), blocks, False).count(), n * blocks.ranges.num_rows


def test_cells_grow_below_the_product_of_the_sides(spark):
    (few, of_few), (many, of_many) = cells(spark, 400), cells(spark, 1200)
    assert few < of_few / 2 and many < of_many / 2 and many / few < 0.7 * of_many / of_few
