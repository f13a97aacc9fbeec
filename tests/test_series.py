"""Measures on small frames against numpy, and their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriatim.config import Config
from seriatim.operators import diversity, ecdf, fidelity, models, nearest, privacy, shape, utility, warping

SCHEMA = "variant string, series long, ord int, t int, column string, col_ord int, value double"


def points(spark, original, synthetic, names=("a", "b")):
    """Lists of arrays (rows x columns), one for each series."""
    rows = []
    for variant, side in (("o", original), ("s", synthetic)):
        for k, x in enumerate(side):
            x = np.asarray(x, float).reshape(len(x), -1)
            for t in range(x.shape[0]):
                for c in range(x.shape[1]):
                    rows.append((variant, k + (1000 if variant == "s" else 0), k, t, names[c], c, None if np.isnan(x[t, c]) else float(x[t, c])))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(1)
    o = [rng.normal(size=(n, 2)) for n in (12, 14, 15, 13)]
    s = [rng.normal(0.3, 1.2, size=(n, 2)) for n in (13, 12, 11, 16)]
    return o, s, points(spark, o, s).cache()


def matrices(o, s):
    size = min(x.size for x in o)
    return [np.array([x.ravel()[:size] for x in side if x.size >= size]) for side in (o, s)]


def test_overlap_drops_short_and_cuts_long(pair):
    o, s, p = pair
    a, b = matrices(o, s)
    got = shape.vectors(shape.overlap(p)).orderBy("variant", "ord").collect()
    assert np.allclose([r["v"] for r in got if r["variant"] == "o"], a)
    assert np.allclose([r["v"] for r in got if r["variant"] == "s"], b)


def test_padded_standardises_and_repeats_the_last_cell(spark):
    p = points(spark, [[[1.0], [3.0]], [[5.0], [5.0], [5.0], [5.0]]], [[[1.0], [2.0], [3.0]]], names=("a",))
    got = {(r["variant"], r["ord"]): r["v"] for r in shape.vectors(shape.padded(p)).collect()}
    assert got["o", 0] == [-1.0, 1.0, 1.0]
    assert got["o", 1] == [5.0, 5.0, 5.0]
    assert np.allclose(got["s", 0], [-1.224744871, 0, 1.224744871])


def test_histogram_distance_is_numpys(pair):
    o, s, p = pair
    a, b = matrices(o, s)
    want = []
    for x, y in zip(a.T, b.T):
        edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 51)
        want.append(np.abs(np.histogram(x, edges)[0] / len(x) - np.histogram(y, edges)[0] / len(y)).sum())
    row = fidelity.marginal_distribution_difference(p).first()
    assert np.allclose([row["mdd_mean"], row["mdd_std"], row["mdd_max"]], [np.mean(want), np.std(want), np.max(want)])


def test_dtw_is_the_dynamic_programme(pair):
    o, s, p = pair

    def dtw(x, y):
        d = np.full((len(x) + 1, len(y) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(x)):
            for j in range(len(y)):
                d[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return np.sqrt(d[-1, -1]) / max(len(x), len(y))

    want = sorted(dtw(x[:, c], y[:, c]) for x, y in zip(o, s) for c in (0, 1))
    assert np.allclose(sorted(r["score"] for r in fidelity.dtw_distances(p).collect()), want)


def test_dtw_takes_every_pair(spark):
    o = [[[0.0], [0.0]]] * 25
    p = points(spark, o, [*o[:24], [[3.0], [3.0]]], names=("a",))
    assert fidelity.dtw_distances(p).count() == 25
    assert np.isclose(fidelity.dynamic_time_warping(p).first()["dtw_mean"], np.sqrt(18) / 2 / 25)
    assert fidelity.dtw_distances(p, 20).count() == 20


def test_distances_and_patterns_of_every_row(spark):
    rng = np.random.default_rng(7)
    o, s = ([rng.normal(size=(6, 1)) for _ in range(n)] for n in (30, 130))
    s[120] = np.ones((6, 1))
    p = points(spark, o, s, names=("a",))
    every = Config(distance_rows=None, pattern_rows=None)
    rows = shape.vectors(shape.padded(p)).orderBy("variant", "ord").collect()
    a, b = (np.array([r["v"] for r in rows if r["variant"] == x]) for x in "os")
    r = [abs(np.corrcoef(b[i], b[j])[0, 1]) for i in range(130) for j in range(i) if 120 not in (i, j)]
    got = privacy.pattern_uniqueness(p, every).first()["pattern_diversity"]
    assert np.isclose(got, 1 - np.mean(r)) and np.isclose(got, privacy.pattern_uniqueness(p).first()["pattern_diversity"])
    assert not np.isclose(got, privacy.pattern_uniqueness(p, Config(pattern_rows=50)).first()["pattern_diversity"])
    x, y = ((v - a.mean(axis=0)) / a.std(axis=0) for v in (a, b))
    d = np.sqrt(((y[:, None] - x) ** 2).sum(axis=2)).min(axis=1)
    want = 0.2 + 0.7 / (1 + np.exp(-2 * (d.mean() / (np.percentile(d, 75) + 1e-6) - 0.5)))
    assert np.isclose(privacy.distance_privacy(p, every).first()[0], want)


def test_correlations_skip_unknown_and_constant_cells():
    x = np.array([[1.0, 2, np.nan, 4, 7], [5, 5, 5, 5, 5], [np.nan, 3, 3, 3, 9], [2, 1, 8, 0, np.nan]])
    got = nearest.absolute_correlations(x, x)
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            a, b = x[i, both], x[j, both]
            assert np.isnan(got[i, j]) if np.ptp(a) == 0 or np.ptp(b) == 0 else np.isclose(got[i, j], abs(np.corrcoef(a, b)[0, 1]))


def test_autocorrelations_of_many_series_at_once(spark):
    """A pass over arrays, without a window of lags and a correlation of columns for each."""
    rng = np.random.default_rng(5)
    values = {(k, c): [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=int(rng.integers(11, 40))).cumsum()] for k in range(40) for c in ("a", "b")}
    values |= {(40, "a"): [0.1] * 30, (41, "a"): [0.1] * 29 + [0.2], (42, "a"): [None] * 30, (43, "a"): [1.0] * 10}
    p = spark.createDataFrame([("o", k, k, t, c, 0, x) for (k, c), xs in values.items() for t, x in enumerate(xs)], "variant string, series long, ord int, t int, column string, col_ord int, value double")
    frame = fidelity.autocorrelations(p, 10)
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {(r["series"], r["column"], r["lag"]): r["acf"] for r in frame.collect()}
    assert len(got) == 10 * len(values)
    for (k, c), xs in values.items():
        for lag in range(1, 11):
            both = [(x, y) for x, y in zip(xs[lag:], xs[:-lag]) if x is not None and y is not None]
            x, y = np.array(both).T if both and len(xs) > 10 else (np.zeros(1), np.zeros(1))
            wanted = 0.0 if np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]
            assert np.isclose(got[k, c, lag], wanted, atol=1e-9), (k, c, lag)


def test_autocorrelation_of_constants_and_short_series_is_zero(spark):
    p = points(spark, [np.ones((20, 1)), np.arange(5).reshape(-1, 1)], [np.arange(20).reshape(-1, 1)], names=("a",))
    got = fidelity.autocorrelations(p).groupBy("variant", "ord").agg(F.min("acf").alias("lo"), F.max("acf").alias("hi")).collect()
    assert {(r["variant"], r["ord"]): (round(r["lo"], 9), round(r["hi"], 9)) for r in got} == {("o", 0): (0, 0), ("o", 1): (0, 0), ("s", 0): (1, 1)}


def test_ecdf_measures_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.5, 2, size=200), 1)
    df = spark.createDataFrame([("o", "k", float(v)) for v in x] + [("s", "k", float(v)) for v in y], "variant string, key string, value double")
    grid = np.unique(np.concatenate([x, y]))
    cx, cy = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (x, y))
    assert np.isclose(ecdf.wasserstein(df, ["key"]).first()["w1"], (np.abs(cx - cy)[:-1] * np.diff(grid)).sum())
    assert np.isclose(ecdf.kolmogorov(df, ["key"]).first()["ks"], np.abs(cx - cy).max())


def test_identical_sides_are_perfect(spark):
    rng = np.random.default_rng(3)
    o = [rng.normal(size=(15, 2)) for _ in range(6)]
    p = points(spark, o, o)
    assert fidelity.marginal_distribution_difference(p).first()["mdd_max"] == 0
    assert fidelity.wasserstein_distance(p).first()["wasserstein_mean"] == 0
    assert diversity.coverage_ratio(p).first()[0] == 1
    assert privacy.distance_to_closest_record(p).first()["raw_min"] == 0
    assert all(abs(r["column_fidelity_score"] - 1) < 1e-9 for r in fidelity.column_fidelity(p).collect())
    assert abs(utility.correlation_preservation(p).first()[0] - 1) < 1e-9


def test_uniqueness_counts_close_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 2))
    s = [base, base, base + 1e-9, rng.normal(size=(4, 2)), rng.normal(size=(4, 2))]
    p = points(spark, [rng.normal(size=(4, 2))], s)
    assert np.isclose(diversity.uniqueness_score(p).first()[0], 1 - 3 / 10)


def test_empty_synthetic_side_gives_documented_values(spark):
    p = points(spark, [np.random.default_rng(5).normal(size=(12, 2))], [])
    assert tuple(fidelity.marginal_distribution_difference(p).first()) == (1, 0, 1)
    assert tuple(fidelity.autocorrelation_difference(p).first()) == (1, 0, 1)
    assert tuple(fidelity.euclidean_distance(p).first()) == (1, 0, 1)
    assert tuple(fidelity.wasserstein_distance(p).first()) == (1, 0, 1)
    assert all(tuple(r)[1:] == (0, 1, 0) for r in fidelity.column_fidelity(p).collect())
    assert models.contextual_fid(p).first()["cfid_distance"] == 2.0
    assert models.attack(p).first()["ds_accuracy"] == 0.5


def test_constant_column_and_nulls(spark):
    o = [np.column_stack([np.ones(12), np.arange(12.0)]) for _ in range(3)]
    s = [np.column_stack([np.ones(12), np.where(np.arange(12) % 4 == 0, np.nan, np.arange(12.0))]) for _ in range(3)]
    p = points(spark, o, s)
    rows = {r["column"]: r for r in diversity.column_diversity(p).collect()}
    assert rows["a"]["variance_ratio"] == 1 and rows["a"]["coverage"] == 1
    assert fidelity.column_fidelity(p).count() == 2
    assert utility.column_utility(p).count() == 2


def test_length_rules(spark):
    p = points(spark, [[[1.0], [2.0], [3.0]], [[4.0]]], [[[5.0], [6.0]]], names=("a",))
    assert shape.truncated(p).count() == 3
    padded = shape.extended(p).orderBy("variant", "ord", "t").collect()
    assert [r["value"] for r in padded] == [1, 2, 3, 4, 4, 4, 5, 6, 6]
    assert [(r["x"], r["y"]) for r in shape.lagged(p, 2).collect()] == [([1.0, 2.0], 3.0)]


def test_attack_tells_shifted_data_apart(spark):
    rng = np.random.default_rng(6)
    p = points(spark, [rng.normal(size=(6, 2)).cumsum(axis=0) for _ in range(40)], [np.sin(np.arange(6))[:, None] + rng.normal(0, 0.01, size=(6, 2)) for _ in range(40)])
    row = models.attack(p, Config(trees=10)).first()
    assert row["mi_accuracy"] > 0.9 and row["mi_auc"] > 0.9


def test_warping_of_unequal_lengths_in_batches(monkeypatch):
    monkeypatch.setattr(warping, "CELLS", 40)
    rng = np.random.default_rng(9)
    pairs = [(rng.normal(size=n), rng.normal(size=m)) for n, m in [(1, 1), (1, 7), (30, 2), (5, 5), (12, 9), (9, 12), (64, 80)]]
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    flat = [np.concatenate([p[k] for p in pairs]) for k in (0, 1)]
    got = np.zeros(len(pairs))
    for some in warping.batches_of(n, m):
        sides = [warping.padded(flat[k], (np.cumsum(x) - x)[some], x[some]) for k, x in ((0, n), (1, m))]
        got[some] = warping.warped(*sides, n[some], m[some])
    for (x, y), d in zip(pairs, got):
        table = np.full((len(x) + 1, len(y) + 1), np.inf)
        table[0, 0] = 0
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(table[i, j], table[i, j + 1], table[i + 1, j])
        assert np.isclose(d, np.sqrt(table[-1, -1]))


def close(spark, x, t):
    df = spark.createDataFrame([([float(c) for c in row], 1) for row in x], "v array<double>, n long")
    return diversity.close_pairs(df, t).count()


@pytest.mark.parametrize("t", [1e-6, 0.05, 3.0])
def test_close_pairs_are_those_of_all_pairs(spark, t, monkeypatch):
    monkeypatch.setattr(diversity, "SALT", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    x = np.concatenate([x, x[:40] + rng.uniform(-0.5, 0.5, size=(40, 5)) * min(t, 1), x[:1] + 0.01 * t * rng.normal(size=(60, 5))])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    assert close(spark, x, t) == (d[np.triu_indices(len(x), 1)] <= t).sum()


def test_many_centred_rows_do_not_meet_in_one_group(spark):
    t, n = 1e-6, 100_000
    rows = spark.range(n).select(F.array(*(F.rand(k) for k in range(4))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    centred = rows.select(F.concat("v", F.array(-total)).alias("v"))  # every row sums up to 0
    twins = centred.limit(7).select(F.transform("v", lambda x: x + 1e-8).alias("v"))
    assert diversity.close_pairs(centred.unionByName(twins).withColumn("n", F.lit(1).cast("long")), t).count() == 7


def test_frechet_distance_is_that_of_the_covariances(spark):
    rng = np.random.default_rng(8)
    o, s = rng.normal(size=(40, 1, 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.1]), rng.normal(size=(35, 1, 6)) + 0.3
    frame = spark.createDataFrame([(v, [float(c) for c in row[0]]) for v, x in (("o", o), ("s", s)) for row in x], "variant string, v array<double>")
    (x, a), (y, b) = got = models.covariances(frame, 6)
    assert np.allclose(x, o[:, 0].mean(axis=0)) and np.allclose(b, np.cov(s[:, 0].T))
    product = np.linalg.eigvals(a @ b)
    want = ((x - y) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.maximum(product.real, 0)).sum()
    assert np.isclose(models.frechet(*got), want) and models.frechet(got[0], got[0]) < 1e-9
    p = points(spark, list(o), list(s), names=tuple("abcdef"))
    plain, full = models.contextual_fid(p).first(), models.contextual_fid(p, Config(full_covariance=True)).first()
    assert full["cfid_distance"] >= plain["cfid_distance"] - 1e-9  # traces bound the root's trace from above


def test_predictability_of_short_and_large_columns(spark):
    def both(o, s):
        p = points(spark, [np.array([[x] for x in o])], [np.array([[x] for x in s])], names=("a",))
        return utility.two_sided(p, ["column"]).select(utility.distributional_predictability().alias("x")).first()["x"]

    assert np.isclose(both([0, 10, 5], [0, 10, 5]), 1) and both([3, 3, 3], [1, 2, 3]) == 0.5
    o, s = [2000, 2010, 2020], [1000, 1010, 1020]
    assert np.isclose(both(o, s), max(0, 1 - (1000 / 20) / 2)) and np.isclose(both([0, 10], [0, 5]), 1 - (2.5 / 10 + 2.5 / 5) / 2)


@pytest.mark.parametrize("cells", [utility.CELLS, 40, 1])
def test_products_are_summed_in_stripes(spark, cells):
    x = np.random.default_rng(6).normal(size=(30, 9))
    frame = spark.createDataFrame([("os"[i % 2], i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "variant string, fold int, v array<double>").repartition(3)
    got = {(r["variant"], r["fold"], r["i"], r["j"]): r["xy"] for r in utility.gram(frame, ["variant", "fold"], cells=cells).collect()}
    assert len(got) == 6 * 55
    for (variant, fold, i, j), xy in got.items():
        own = np.array([[1.0, *row] for k, row in enumerate(x) if ("os"[k % 2], k % 3) == (variant, fold)])
        assert i <= j and np.isclose(xy, own[:, i] @ own[:, j])


def test_values_on_an_edge_of_a_normalised_bin_count_above_it(spark):
    """The third value is the middle of its range, but once it is less a mean and over a deviation, a plain floor puts it below the middle."""
    side = [np.array([[54.96], [61.46], [58.21], [58.54]])]
    normalized = shape.normalized_columns(points(spark, side, side, ("a",)))
    got = {r["variant"]: r["entropy"] for r in diversity.entropies(normalized, ["column"], 10, diversity.SLACK).collect()}
    assert got == pytest.approx(dict.fromkeys("os", 1.5 * np.log(2)), abs=1e-6)


def test_column_measures_read_each_point_once_for_a_pass(spark):
    """Distinct counts would copy every point for each of them, and sides without a shared series need no join of the points."""
    rng = np.random.default_rng(4)
    p = points(spark, [rng.normal(size=(9, 2)) for _ in range(3)], [rng.normal(size=(8, 2)) for _ in range(3)])
    assert "Expand" not in diversity.column_diversity(p)._jdf.queryExecution().toString()
    assert "Join" not in fidelity.pooled(p)._jdf.queryExecution().toString()
    chain = shape.chained(p.where("column = 'a' and series = 0")).orderBy("t").collect()
    assert [r["before"] for r in chain] == [None, *(r["value"] for r in chain[:-1])] and [r["first"] for r in chain] == [True] + [False] * 8 and [r["last"] for r in chain] == [False] * 8 + [True]


def test_pairs_of_a_block_are_summed_in_strips(monkeypatch):
    x = np.random.default_rng(6).normal(size=(23, 5))
    x[3] = 1.0
    with np.errstate(invalid="ignore"):
        r = np.abs(np.corrcoef(x))
    upper = r[np.triu_indices(len(x), 1)]
    monkeypatch.setattr(nearest, "CELLS", 60)
    total, n = nearest.pair_sums(x, x, True)
    assert n == np.isfinite(upper).sum() == 22 * 21 / 2 and np.isclose(total, np.nansum(upper))
    monkeypatch.setattr(nearest, "absolute_correlations", lambda a, b: np.zeros((len(a), len(b))) if len(a) <= 3 else pytest.fail("a strip has more cells than CELLS"))
    assert nearest.pair_sums(x, x[:20], False)[1] == 23 * 20


def test_number_of_blocks_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(7).normal(size=(1200, 3)))], "series long, v array<double>")
    assert nearest.Blocks(rows).ranges.num_rows <= 4 * nearest.PIVOTS < 1200 / 4


def test_small_trees_are_written_by_many_tasks(spark, tmp_path):
    """The part of a file's name is the number of its task; a gathered write has one."""
    from seriatim.sources import tree

    side = [np.array([[1.0], [2.0]]) for _ in range(12)]
    tree.write_series(points(spark, side, side[:1], ("a",)).where("variant = 'o'"), f"file://{tmp_path}/tree")
    files = [f.name for f in (tmp_path / "tree").glob("series=*/*.csv")]
    assert len(files) == 12 and len({name.split("-")[1] for name in files}) > 3
