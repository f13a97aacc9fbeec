"""Sources, scoring and the report on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriatim.config import Config
from seriatim.operators import diversity, privacy, scoring, shape
from seriatim.plans import evaluate, report
from seriatim.sources import tree

ROWS = [
    ("conditional", "x", "synthetic", 0.4, 0.7, 0.2, 0.6),
    ("conditional", "y", "synthetic", 0.6, 0.7, 0.9, 0.4),
    ("conditional", "noise", "baseline", 0.9, 0.9, 0.5, 0.9),
    ("unconditional", "x", "synthetic", 0.1, 0.1, 0.5, float("nan")),
]


@pytest.fixture(scope="module")
def scores(spark):
    flat = [(g, v, k, d, x) for g, v, k, *xs in ROWS for d, x in zip(scoring.DIMENSIONS, xs)]
    return spark.createDataFrame(flat, "gen_type string, variant string, variant_type string, dimension string, value double")


def test_overall_weights_and_undefined_scores(scores):
    got = {(r["gen_type"], r["variant"]): r["overall_score"] for r in scoring.overall_scores(scores).collect()}
    assert got["conditional", "x"] == pytest.approx(0.25 * 0.4 + 0.35 * 0.7 + 0.15 * 0.2 + 0.25 * 0.6)
    assert got["unconditional", "x"] == pytest.approx(0.25 * 0.1 + 0.35 * 0.1 + 0.15 * 0.5)


def test_best_and_recommendations(scores):
    assert {(r["gen_type"], r["best_variant"]) for r in scoring.best_variants(scores).collect()} == {("conditional", "y"), ("unconditional", "x")}
    said = {(r[0], r[1]) for r in scoring.recommendations(scores).collect()}
    assert ("conditional", "UNDERPERFORMING") in said and ("unconditional", "POOR") in said
    assert ("conditional", "LOW FIDELITY") not in said


def test_report_has_every_method(scores):
    page = report.html(scores)
    assert all(m in page for m in ("x (C)", "y (C)", "noise (B)", "x (U)"))
    assert "best y" in report.summary(scores)


def test_heatmap_and_breakdown_are_drawn(scores):
    heat = report.heatmap_svg(scoring.heatmap(scores))
    assert heat.count("<rect") == 4 * 5 and heat.index("noise (B)") < heat.index("x (C)") and f'fill="{report.shade(0.7)}"' in heat and ">0.700<" in heat
    assert (report.shade(0), report.shade(0.5), report.shade(1)) == ("rgb(255,0,90)", "rgb(255,255,90)", "rgb(0,255,90)")
    panels = report.breakdown_svg(scoring.breakdown(scores))
    assert panels.count("<rect") == 4 * 3 * 2 and panels.count("<line") == 12 and all(f">{d}<" in panels for d in scoring.DIMENSIONS)
    assert report.breakdown_svg(scoring.breakdown(scores.where("false"))).count("<rect") == 0


def test_frames_of_a_report(spark, scores):
    best = scoring.business_figures(scores).first()
    assert (best["gen_type"], best["variant"], best["privacy"]) == ("conditional", "y", 0.9)
    assert scoring.business_figures(scores.where("gen_type = 'none'")).count() == 0
    bars = scoring.overall_bars(scores.unionByName(scores.where("variant = 'noise'").withColumn("variant", F.lit("other noise"))))
    assert {r["method"] for r in bars.collect()} == {"x (C)", "y (C)", "noise (B)", "x (U)"}
    axes = {(r["method"], r["dimension"]): (r["axis"], r["value"]) for r in scoring.radar(scores).collect()}
    assert axes["x (U)", "utility"] == (3, 0.0) and axes["y (C)", "privacy"] == (2, 0.9) and len(axes) == 16


def test_column_table_has_fixed_order_and_a_whole_row(spark):
    rows = [("unconditional", "x", "synthetic", c, "fidelity", v) for c, v in ((None, 0.5), ("Volume", 0.1), ("extra", 0.2), ("Open", 0.3))]
    metrics = spark.createDataFrame([(g, v, k, d, c, "overall_fidelity_score" if c is None else "column_fidelity_score", x) for g, v, k, c, d, x in rows], "gen_type string, variant string, variant_type string, dimension string, column string, metric string, value double")
    table = scoring.column_table(evaluate.column_scores(metrics))
    assert [(r["column"], r["fidelity"], r["privacy"]) for r in table.orderBy("place").collect()] == [("Open", 0.3, 0.0), ("Volume", 0.1, 0.0), ("extra", 0.2, 0.0), ("OVERALL", 0.5, 0.0)]
    page = report.html(evaluate.scores(metrics), columns=evaluate.column_scores(metrics))
    assert "OVERALL" in page and "<polygon" in page


def points(spark, rows):
    return spark.createDataFrame(rows, "variant string, series long, ord int, t int, column string, col_ord int, value double")


def test_overlay_takes_a_common_series_else_the_first(spark):
    rows = [(v, s, 0, t, "Open", 0, float(t)) for v, s, n in (("o", 1, 2), ("o", 5, 4), ("s", 5, 3), ("s", 2, 9)) for t in range(n)]
    rows += [("o", 5, 0, 0, "OpenInt", 1, 0.0)]
    drawn = shape.overlay(points(spark, rows))
    assert {(r["variant"], r["series"], r["overlap_end"]) for r in drawn.collect()} == {("o", 5, 2), ("s", 5, 2)}
    assert drawn.where("not within").count() == 1
    apart = shape.overlay(points(spark, [r for r in rows if r[:2] != ("s", 5)]))
    assert {(r["variant"], r["series"]) for r in apart.collect()} == {("o", 1), ("s", 2)}
    assert report.overlay_svg(drawn, "Open").count("<polyline") == 2 and report.overlay_svg(drawn, "none") == "<svg></svg>"


def series(rng, n, length, shift=0.0, columns=("a", "b")):
    return [(i, t, c, k, float(rng.normal(loc=shift + k))) for i in range(n) for t in range(length) for k, c in enumerate(columns)]


def sides(spark, o, s):
    return points(spark, [(v, i, i, t, c, k, x) for v, rows in (("o", o), ("s", s)) for i, t, c, k, x in rows])


def test_variants_without_rows_on_a_side_have_zeros(spark):
    one_side = points(spark, [("o", 1, 0, 0, "a", 0, 1.0)])
    metrics = evaluate.evaluate_all({("conditional", "x"): one_side})
    rows = metrics.collect()
    assert {(r["dimension"], r["value"]) for r in rows if r["dimension"] != "metadata"} == {(d, 0.0) for d in scoring.DIMENSIONS}
    assert {(r["metric"], r["column"], r["value"]) for r in rows if r["dimension"] == "metadata"} == {("error", "no rows on a side", 1.0), ("original_samples", None, 1.0), ("synthetic_samples", None, 0.0)}
    assert privacy.minimal_privacy(spark, 0.25).first()["overall_privacy_score"] == 0.25


def test_whole_evaluation_of_two_sides_and_a_variant_that_raises(spark, monkeypatch):
    rng = np.random.default_rng(1)
    config = Config(trees=5, depth=3)
    good = sides(spark, series(rng, 12, 14), series(rng, 12, 14))
    bad = good.withColumn("value", F.raise_error(F.lit("cannot be read")).cast("double"))
    monkeypatch.setitem(evaluate.WHOLE["fidelity"], "mine", lambda p, c: p.agg(F.max("value").alias("largest")))  # a measure of one's own
    metrics = evaluate.evaluate_all({("conditional", "good"): good, ("conditional", "original_noise"): bad}, config=config)
    rows = {(r["variant"], r["dimension"], r["column"], r["metric"]): r["value"] for r in metrics.collect()}
    for name in ("overall_diversity_score", "overall_fidelity_score", "overall_privacy_score", "overall_utility_score"):
        dimension = name.split("_")[1]
        assert 0 <= rows["good", dimension, None, name] <= 1 and rows["original_noise", dimension, None, name] == 0
    assert np.isclose(rows["good", "fidelity", None, "largest"], good.agg(F.max("value")).first()[0])
    assert np.isclose(rows["good", "privacy", None, "overall_privacy_score"], (rows["good", "privacy", None, "dcr_mean"] + 1 - rows["good", "privacy", None, "mi_accuracy"]) / 2)
    assert {k[2] for k in rows if k[0] == "good" and k[1] == "privacy" and k[3] == "overall_privacy_score"} == {None, "a", "b"}
    assert rows["good", "metadata", None, "original_samples"] == 12 and not any(k[3] == "error" for k in rows if k[0] == "good")
    assert any("cannot be read" in k[2] for k in rows if k[0] == "original_noise" and k[3] == "error")
    assert scoring.overall_scores(evaluate.scores(metrics)).count() == 2


def test_matrices_are_computed_once_for_all_measures(spark, monkeypatch):
    made, write = [], shape.written
    monkeypatch.setattr(shape, "written", lambda df, name: made.append(name) or write(df, name))
    rng = np.random.default_rng(3)
    p = sides(spark, series(rng, 6, 8), series(rng, 6, 8))
    alone = {r["metric"]: r["value"] for r in evaluate.tall(evaluate.fidelity.all_fidelity(p), "fidelity").collect()}
    made.clear()
    rows = evaluate.evaluate(p, Config(), learned=False).where("column is null and dimension = 'fidelity'").collect()
    assert sorted(made) == ["overlap", "padded"] and not shape.SHARED
    assert {r["metric"]: round(r["value"], 9) for r in rows} == {name: round(x, 9) for name, x in alone.items()}


def test_sides_without_a_common_column_have_the_whole_matrix_form(spark):
    rng = np.random.default_rng(2)
    p = sides(spark, series(rng, 6, 8, columns=("a",)), series(rng, 5, 8, columns=("b",)))
    whole, legacy = diversity.all_diversity(p).first().asDict(), diversity.legacy_diversity(p).first().asDict()
    assert whole == legacy and "trend_diversity" in whole


def test_own_measures_join_the_registry(monkeypatch):
    monkeypatch.setattr(evaluate, "WHOLE", {})
    evaluate.register("fidelity", "mine", lambda p, c: p)
    assert list(evaluate.WHOLE["fidelity"]) == ["mine"]


def test_text_of_a_summary_is_written(spark, scores, tmp_path):
    text = report.summary(scores)
    assert "baseline noise" in text and "UNDERPERFORMING" in text
    report.write_text(spark, text, f"{tmp_path}/summary")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/summary").collect()] == text.split("\n")


def test_data_summary(spark, tmp_path):
    for name in ("conditional generation/original/time_series/series_001.csv", "conditional generation/original/static.csv", "unconditional generation/tsv2/ts/7.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a\n1\n")
    assert {tuple(r) for r in tree.data_summary(spark, str(tmp_path)).collect()} == {("conditional", "original", 1, True), ("unconditional", "tsv2", 1, False)}


def test_tree_reader(spark, tmp_path):
    for variant, folder in (("original", "original/time_series"), ("tsv2", "tsv2/ts")):
        (tmp_path / folder).mkdir(parents=True)
        for k in (3, 12):
            (tmp_path / folder / f"series_{k:03d}.csv").write_text("col1,name,col2\n1.5,a,2\n,b,4\n3.5,c,\n")
    p = tree.load_pair(spark, f"{tmp_path}/original", f"{tmp_path}/tsv2")
    assert {r[0] for r in p.select("column").distinct().collect()} == {"col1", "col2"}
    assert p.where("variant = 'o' and series = 12 and t = 1 and column = 'col2'").first()["value"] == 4.0
    assert p.where("value is null").count() == 8
    assert [tuple(r) for r in tree.variants(spark, str(tmp_path)).collect()] == [("original", 2), ("tsv2", 2)]
    assert {tuple(r) for r in tree.structure(p).collect()} == {("o", 2, 3.0), ("s", 2, 3.0)}


def test_tree_reader_takes_the_documented_layout(spark, tmp_path):
    for folder in ("conditional/original/time_series", "conditional/tsv1/time_series", "unconditional/original", "unconditional/tsv2/ts"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "conditional/original/static.csv").write_text(".id,kind\n3,a\n4.0,b\n")
    (tmp_path / "conditional/original/time_series/series_003.csv").write_text('"a,b",c\n1.0,"2"\nNaN,4e1\n')
    (tmp_path / "conditional/tsv1/time_series/sample_3.csv").write_text('"a,b",c,d\n1.5,NA,x\n2.5,,y\n')
    (tmp_path / "unconditional/original/ibm us.csv").write_text("Open\n1\n2\n")
    (tmp_path / "unconditional/tsv2/ts/7.csv").write_text("Open\n3\n")
    p = tree.load_pair(spark, f"{tmp_path}/conditional/original", f"{tmp_path}/conditional/tsv1")
    got = {(r["variant"], r["series"], r["t"], r["column"]): r["value"] for r in p.collect()}
    assert got == {("o", 3, 0, "a,b"): 1.0, ("o", 3, 1, "a,b"): None, ("o", 3, 0, "c"): 2.0, ("o", 3, 1, "c"): 40.0, ("s", 3, 0, "a,b"): 1.5, ("s", 3, 1, "a,b"): 2.5, ("s", 3, 0, "c"): None, ("s", 3, 1, "c"): None}
    static = tree.read_static(spark, f"{tmp_path}/conditional/original/static.csv")
    assert [r["series"] for r in tree.missing_series(static, p).collect()] == [4]
    words = tree.load_pair(spark, f"{tmp_path}/unconditional/original", f"{tmp_path}/unconditional/tsv2", stems=True)
    assert {(r["variant"], r["series"], r["value"]) for r in words.collect()} == {("o", "ibm us", 1.0), ("o", "ibm us", 2.0), ("s", "7", 3.0)}
    assert {tuple(r) for r in tree.summary(words).collect()} == {("o", 1, 2, 2, 2.0, 2, 1), ("s", 1, 1, 1, 1.0, 1, 1)}
    assert [tuple(r) for r in tree.variants(spark, f"{tmp_path}/conditional").collect()] == [("original", 1), ("tsv1", 1)]


def test_header_alone_sets_the_number_of_columns(spark, tmp_path):
    (tmp_path / "original").mkdir()
    # a record over two lines, names and texts with commas and quotes; none of them makes the table wider or narrower
    (tmp_path / "original/series_1.csv").write_text('"a\n,b",note,c,d\n1,"x\n' + "," * 500 + '",2,3\n4,"say ""hi"", twice\n",5,6\n')
    got = {(r["t"], r["col_ord"]): r["value"] for r in tree.read_series(spark, f"{tmp_path}/original").collect()}
    assert got == {(0, 0): 1.0, (0, 2): 2.0, (0, 3): 3.0, (1, 0): 4.0, (1, 2): 5.0, (1, 3): 6.0}


def test_series_are_written_as_they_are_read(spark, tmp_path):
    rows = [("o", name, 0, t, column, k, value) for name in ("a/b c", "x=1%") for t in range(3) for k, (column, value) in enumerate((("p,q", float(t)), ("series", None if t == 1 else 0.1), ("P,q", float("inf"))))]
    points = spark.createDataFrame(rows, "variant string, series string, ord long, t int, column string, col_ord int, value double")
    tree.write_series(points, f"{tmp_path}/original")
    back = tree.read_series(spark, f"{tmp_path}/original", stems=True).select("series", "t", "column", "value")
    names = {"P,q": "P,q.1", "series": "series.1"}
    assert {tuple(r) for r in back.collect()} == {(s, t, names.get(c, c), v) for _, s, _, t, c, _, v in rows}


def test_files_of_a_tree_are_no_business_of_the_driver(spark, tmp_path):
    """Spark's sources keep every file's path and state on the driver, and look into a folder by a task each."""
    points = spark.range(300).selectExpr("'o' as variant", "id as series", "0L as ord", "0 as t", "'a' as column", "0 as col_ord", "double(id) as value")
    tree.write_series(points, f"{tmp_path}/conditional/original")
    assert len(tree.folders(str(tmp_path))) <= 3 + tree.tasks(spark)  # not one for each series
    back = tree.read_series(spark, f"{tmp_path}/conditional/original")
    assert {(r["series"], r["value"]) for r in back.collect()} == {(k, float(k)) for k in range(300)}
    found = tree.variants(spark, f"{tmp_path}/conditional")
    assert [tuple(r) for r in found.collect()] == [("original", 300)]
    assert not any(f.inputFiles() for f in (back, found, tree.data_summary(spark, str(tmp_path))))
    with pytest.raises(FileExistsError):
        tree.write_series(points, f"{tmp_path}/conditional/original")


def test_other_file_systems_are_left_to_spark(spark, tmp_path, monkeypatch):
    rows = [("o", name, 0, t, "p,q", 0, float(t)) for name in ("a/b c", "x=1%") for t in range(3)]
    points = spark.createDataFrame(rows, "variant string, series string, ord long, t int, column string, col_ord int, value double")
    tree.write_series(points, f"{tmp_path}/conditional/original/ts")
    monkeypatch.setattr(tree, "local", lambda spark, path: None)
    tree.write_series(points, f"{tmp_path}/conditional/tsv 2/ts")
    for folder in ("original", "tsv 2"):
        back = tree.read_series(spark, f"{tmp_path}/conditional/{folder}", stems=True).select("series", "t", "column", "value")
        assert {tuple(r) for r in back.collect()} == {(s, t, c, v) for _, s, _, t, c, _, v in rows}
    assert [tuple(r) for r in tree.variants(spark, f"{tmp_path}/conditional").collect()] == [("original", 2), ("tsv 2", 2)]
    assert {tuple(r) for r in tree.data_summary(spark, str(tmp_path)).collect()} == {("conditional", "original", 2, False), ("conditional", "tsv 2", 2, False)}


def test_newest_results_come_last(spark, tmp_path):
    for name in ("results_20240101", "results_20240301", "results_20240201"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.json").write_text("{}")
    assert tree.newest(spark, str(tmp_path)).endswith("results_20240301")


def test_results_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("conditional", "x", "synthetic", "fidelity", None, "overall_fidelity_score", 0.5)], "gen_type string, variant string, variant_type string, dimension string, column string, metric string, value double")
    tree.save_results(metrics, f"{tmp_path}/results_20240101")
    back = tree.load_results(spark, f"{tmp_path}/results_20240101")
    assert back.collect() == metrics.collect()
    assert evaluate.scores(back).select(F.sum("value")).first()[0] == 0.5
