"""Registered queries of the engine and the SQL that checks them.

Every query reads the warehouse tables through a series view and returns doubles rounded to 6 digits, so that engines that add up in
another order agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as sql
from .config import Config
from .operators import diversity, ecdf, fidelity, models, privacy, scoring, shape, utility
from .plans import evaluate
from .sources import tree, views
from .sources.store import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
POINTS = {"ev": views.event_points, "types": views.event_type_points, "bars": views.bar_points, "emb": views.embedding_points, "halves": views.half_points}
WIDE = Config(coverage_threshold=9.0)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def stored_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view that is computed once for all branches of a query."""
    return written(POINTS[view](spark, sf_dir), "view")


def register(name: str, view: str, make: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(stored_view(spark, sf_dir, view)))
    if oracle is not None:
        ORACLE_SQL[name] = oracle


def cells(matrix: DataFrame) -> DataFrame:
    return matrix.select("variant", "series", "f", "value")


# sources and reshaping
register("scan_variant_summary", "ev", lambda p: p.groupBy("variant", "series").agg((F.max("t") + 1).alias("rows")).groupBy("variant").agg(F.count(F.lit(1)).alias("n_series"), F.avg("rows").alias("avg_length")),
         sql.query("ev", select="select variant, count(*) as n_series, round(avg(rows), 6) as avg_length from (select variant, series, max(t) + 1 as rows from points group by all) group by variant"))
register("overlap_matrix", "ev", lambda p: cells(shape.overlap(p)), sql.query("ev", sql.M1, select="select variant, series, f, round(value, 6) as value from m"))
register("padded_zscore_matrix", "ev", lambda p: cells(shape.padded(p)), sql.query("ev", sql.M2, select="select variant, series, f, round(value, 6) as value from m"))
register("column_matrices", "bars", lambda p: shape.column_matrices(p).select("variant", "series", "t", "column", "value"), sql.query("bars", sql.COLS, select='select variant, series, t, "column", round(value, 6) as value from cm'))
register("normalized_columns", "bars", lambda p: shape.normalized_columns(p).select("variant", "series", "t", "column", "value"), sql.query("bars", sql.COLS, select='select variant, series, t, "column", round(value, 6) as value from nc'))
register("column_stats", "bars", lambda p: shape.column_stats(shape.column_matrices(p)), sql.query("bars", sql.COLS, select=f"""select {sql.rounded('mean', 'sd', 'lo', 'hi', 'range', keys='"column", n_series')} from cs"""))
register("truncate_length", "ev", lambda p: shape.truncated(p).select("variant", "series", "t", "column", "value"),
         sql.query("ev", select='select variant, series, t, "column", round(value, 6) as value from points where t < (select min(r) from (select max(t) + 1 as r from points group by variant, series))'))
register("pad_length", "ev", lambda p: shape.extended(p).select("variant", "series", "t", "column", "value"),
         sql.query("ev", select="""select variant, series, t, "column", round(value, 6) as value from points union all
           select variant, series, unnest(range(last + 1, (select max(t) + 1 from points))) as t, "column", round(value, 6) as value from (select variant, series, "column", max(t) as last, arg_max(value, t) as value from points group by all)"""))  # fmt: skip
register("lagged_pairs", "ev", lambda p: shape.lagged(p, 2).select("variant", "series", "column", "t", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "y"),
         sql.query("ev", select="""select variant, series, "column", t, round(x0, 6) as x0, round(x1, 6) as x1, round(value, 6) as y from (
           select *, lag(value, 2) over w as x0, lag(value, 1) over w as x1 from points window w as (partition by variant, series, "column" order by t)) where t >= 2"""))  # fmt: skip
register("scaled_matrix", "ev", lambda p: cells(shape.standardized(shape.overlap(p))), sql.query("ev", sql.M1, sql.SCALED, select="select variant, series, f, round(value, 6) as value from scaled"))

register("union_scaled_matrix", "ev", lambda p: cells(shape.standardized(shape.overlap(p), F.lit(True))), sql.query("ev", sql.M1,
         select="select variant, series, f, round((value - avg(value) over w) / case when stddev_pop(value) over w = 0 then 1 else stddev_pop(value) over w end, 6) as value from m window w as (partition by f)"))
for view in ("ev", "halves"):
    suffix = "" if view == "ev" else "_shared"
    register(f"series_overlay{suffix}", view, shape.overlay, sql.query(view, "lengths as (select variant, series, max(t) + 1 as rows from points group by all)",
             "picked as (select variant, coalesce((select min(series) from (select series from lengths group by series having count(*) = (select count(distinct variant) from lengths))), min(series)) as series from lengths group by variant)",
             "drawn as (select min(rows) - 1 as overlap_end from lengths join picked using (variant, series))",
             select='select variant, series, "column", t, round(value, 6) as value, overlap_end, t <= overlap_end as within from points join picked using (variant, series), drawn where lower("column") <> \'openint\''))


def ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.monthly_bars(spark, sf_dir).drop("OpenInt"))


def static_series_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as static conditions beside the length and first value of their order series."""
    static = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), "c_mktsegment", "c_acctbal")
    orders = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series")).agg(F.count(F.lit(1)).alias("n"), F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("first_value"))
    return rounded(static.join(orders, "series"))


def static_missing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a series of events: their ids are what a load warns about."""
    static = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), "c_mktsegment")
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("series"))
    return static.join(events, "series", "left_anti")


QUERIES |= {"ohlcv_bars": ohlcv_bars, "static_series_join": static_series_join, "static_missing_series": static_missing_series}
ORACLE_SQL |= {
    "ohlcv_bars": "with " + sql.BARS_WIDE + ' select variant, series, t, round("Open", 6) as "Open", round("High", 6) as "High", round("Low", 6) as "Low", round("Close", 6) as "Close", round("Volume", 6) as "Volume" from bars',
    "static_series_join": """select c_custkey as series, c_mktsegment, round(c_acctbal, 6) as c_acctbal, n, round(first_value, 6) as first_value from customer
      join (select o_custkey, count(*) as n, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as first_value from orders group by o_custkey) on c_custkey = o_custkey""",
    "static_missing_series": "select c_custkey as series, c_mktsegment from customer where c_custkey not in (select user_id from events)",
}


# trees of files: written in the documented layout, then read back
FOLDERS = {"o": "original/time_series", "s": "tsv1/time_series"}


def tree_of(spark: SparkSession, sf_dir: str, view: str, prefix: str = "", gen_type: str = "conditional") -> str:
    """The folder of a view's sides as trees of CSV files; series are named by their id after ``prefix``."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex[:12]}"
    points = stored_view(spark, sf_dir, view).withColumn("series", F.concat(F.lit(prefix), F.col("series").cast("string")))
    for side, folder in FOLDERS.items():
        tree.write_series(points.where(F.col("variant") == side), f"{root}/{gen_type} generation/{folder}")
    return root


def loaded(spark: SparkSession, root: str, gen_type: str = "conditional", stems: bool = False) -> DataFrame:
    return tree.load_pair(spark, *(f"{root}/{gen_type} generation/{folder}" for folder in FOLDERS.values()), stems=stems)


def tree_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of series known by number, as loaded from files."""
    return rounded(loaded(spark, tree_of(spark, sf_dir, "ev", "series_00")).select("variant", "series", "ord", "t", "column", "col_ord", "value"))


def tree_unconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of series known by name, as loaded from files."""
    root = tree_of(spark, sf_dir, "bars", "supplier no: ", "unconditional")
    return rounded(loaded(spark, root, "unconditional", stems=True).select("variant", "series", "ord", "t", "column", "col_ord", "value"))


def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series, rows, columns and lengths of either side, as loaded from files of ragged columns."""
    return rounded(tree.summary(loaded(spark, tree_of(spark, sf_dir, "types"))))


def tree_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation types and variants found below a root, one of them with static conditions beside it."""
    root = tree_of(spark, sf_dir, "ev")
    tree.write_static(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), "c_mktsegment"), f"{root}/conditional generation/original")
    counted = tree.variants(spark, f"{root}/conditional generation").withColumnRenamed("files", "series_files")
    return tree.data_summary(spark, root).join(counted, "variant")


def tree_missing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static conditions, as read from a file, that have no series of events among the files."""
    root = tree_of(spark, sf_dir, "ev")
    folder = f"{root}/conditional generation/original"
    tree.write_static(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), "c_mktsegment"), folder)
    series = [tree.read_series(spark, f"{root}/conditional generation/{side}").select("series") for side in FOLDERS.values()]
    return tree.missing_series(tree.read_static(spark, f"{folder}/{tree.STATIC}"), series[0].unionByName(series[1]))


def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of results saved under two times, those saved last."""
    lengths = tree.structure(stored_view(spark, sf_dir, "ev")).selectExpr("variant", "inline(array(struct('series' as metric, double(time_series_files) as value), struct('avg_length' as metric, avg_ts_length as value)))")
    rows = lengths.select(F.lit("conditional").alias("gen_type"), "variant", F.lit("synthetic").alias("variant_type"), F.lit("metadata").alias("dimension"), F.lit(None).cast("string").alias("column"), "metric", "value")
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex[:12]}"
    tree.save_results(rows.withColumn("value", -F.col("value")), f"{root}/results_20240101_120000")
    tree.save_results(rows, f"{root}/results_20240301_120000")
    return rounded(tree.load_results(spark, tree.newest(spark, root)))


QUERIES |= {f.__name__: f for f in (tree_conditional, tree_unconditional, tree_summary, tree_variants, tree_missing_series, newest_results)}
ORACLE_SQL |= {
    "tree_conditional": sql.query("ev", select='select variant, series, ord, t, "column", col_ord, round(value, 6) as value from points'),
    "tree_unconditional": sql.query("bars", select="""select variant, 'supplier no: ' || series as series, dense_rank() over (partition by variant order by 'supplier no: ' || series) - 1 as ord, t, "column", col_ord, round(value, 6) as value from points"""),
    "tree_summary": sql.query("types", select="""select variant, count(*) as series, sum(rows)::bigint as rows, min(rows) as min_length, round(avg(rows), 6) as avg_length, max(rows) as max_length, max(columns) as columns
      from (select variant, series, max(t) + 1 as rows from points group by all) join (select variant, count(distinct "column") as columns from points group by variant) using (variant) group by variant"""),
    "tree_variants": """select 'conditional' as gen_type, v as variant, count(distinct user_id) filter (where user_id % 2 = side) as files, v = 'original' as has_static, count(distinct user_id) filter (where user_id % 2 = side) as series_files
      from events, (values (0, 'original'), (1, 'tsv1')) s(side, v) group by v""",
    "tree_missing_series": "select c_custkey as series, c_mktsegment from customer where c_custkey not in (select user_id from events)",
    "newest_results": sql.query("ev", "lengths as (select variant, count(*)::double as n, avg(rows) as mean from (select variant, series, max(t) + 1 as rows from points group by all) group by variant)",
      select="""select 'conditional' as gen_type, variant, 'synthetic' as variant_type, 'metadata' as dimension, null::varchar as "column", metric, round(case metric when 'series' then n else mean end, 6) as value from lengths, (values ('series'), ('avg_length')) m(metric)"""),
}

# fidelity
register("column_fidelity_shared", "halves", fidelity.column_fidelity, sql.query("halves", sql.COLFID, select='select "column", round(0.6 * mdd + 0.4 * moment_similarity, 6) as column_fidelity_score, round(mdd, 6) as mdd, round(moment_similarity, 6) as moment_similarity from cf'))
for view in ("ev", "bars"):
    suffix = "" if view == "ev" else "_bars"
    register(f"mdd{suffix}", view, fidelity.marginal_distribution_difference, sql.query(view, sql.M1, sql.MDD, select=sql.summary("mdd")))
    register(f"acd{suffix}", view, fidelity.autocorrelation_difference, sql.query(view, sql.ACF, sql.ACD, select=sql.summary("acd")))
    register(f"moments_diff{suffix}", view, fidelity.statistical_moments_difference, sql.query(view, sql.M1, sql.moments("m", "f"), select="""select round(s, 6) as skewness_diff, round(k, 6) as kurtosis_diff, round(greatest(0.0, 1 - (s + k) / 2), 6) as moment_score from (
      select coalesce(avg(abs(skew_o - skew_s)), 1.0) as s, coalesce(avg(abs(kurt_o - kurt_s)), 1.0) as k from mo where n_o > 3 and n_s > 3)"""))
    register(f"euclidean{suffix}", view, fidelity.euclidean_distance, sql.query(view, sql.M1, sql.EUCLID, select=sql.summary("euclidean", "min")))
    register(f"wasserstein{suffix}", view, fidelity.wasserstein_distance, sql.query(view, sql.M1, sql.W1, select=sql.summary("wasserstein", "min")))
    register(f"column_fidelity{suffix}", view, fidelity.column_fidelity, sql.query(view, sql.COLFID, select='select "column", round(0.6 * mdd + 0.4 * moment_similarity, 6) as column_fidelity_score, round(mdd, 6) as mdd, round(moment_similarity, 6) as moment_similarity from cf'))
register("acf", "ev", lambda p: fidelity.autocorrelations(p).select("variant", "series", "column", "lag", "acf"), sql.query("ev", sql.ACF, select='select variant, series, "column", lag, round(acf, 6) as acf from acfs'))
register("ks_by_column", "types", lambda p: ecdf.kolmogorov(p, ["column"]), sql.query("types", sql.ecdf("points", '"column"'), select='select "column", round(max(abs(cdf_o - cdf_s)), 6) as ks from st group by "column"'))
register("dtw", "ev", fidelity.dynamic_time_warping, sql.query("ev", sql.DTW, select=sql.summary("dtw", "min")))
register("fidelity_overall", "ev", fidelity.all_fidelity, sql.query("ev", sql.FIDELITY, select=f"select {sql.rounded(*sql.FIDELITY_NAMES)} from fid"))

# diversity
register("coverage", "emb", diversity.coverage_ratio, sql.query("emb", sql.M1, sql.SCALED, sql.dist("scaled"), select="select round(avg(case when d <= 0.5 then 1.0 else 0.0 end), 6) as coverage_ratio from (select other, min(d) as d from dd group by other)"))
register("coverage_wide", "emb", lambda p: diversity.coverage_ratio(p, WIDE), sql.query("emb", sql.M1, sql.SCALED, sql.dist("scaled"), select="select round(avg(case when d <= 9 then 1.0 else 0.0 end), 6) as coverage_ratio from (select other, min(d) as d from dd group by other)"))
register("uniqueness", "emb", diversity.uniqueness_score, sql.query("emb", sql.M1, "vec as (select series, list(value order by f) as v from m where variant = 's' group by series)", select="""select round(avg(case when sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))) > 1e-6 then 1.0 else 0.0 end), 6) as uniqueness_score from vec a join vec b on a.series < b.series"""))
register("statistical_diversity", "ev", diversity.statistical_diversity, sql.query("ev", sql.M1, sql.STATDIV, select=f"select {sql.rounded('variance_ratio', 'range_ratio', 'entropy_ratio')} from statdiv"))
register("trend_features", "ev", lambda p: diversity.trend_features(p).select("variant", "series", "column", "slope", "curvature"), sql.query("ev", sql.TREND, select=f"""select {sql.rounded('slope', 'curvature', keys='variant, series, "column"')} from tr"""))
register("temporal_diversity", "ev", diversity.temporal_pattern_diversity, sql.query("ev", sql.TEMPDIV, select=f"select {sql.rounded('autocorr_diversity', 'trend_diversity')} from ad, td"))
register("column_entropy", "bars", lambda p: diversity.entropies(p, ["column"]), sql.query("bars", sql.entropy("points", '"column"'), select='select "column", variant, round(entropy, 6) as entropy from en'))
for view in ("bars", "types"):
    suffix = "" if view == "bars" else "_types"
    register(f"column_diversity{suffix}", view, diversity.column_diversity, sql.query(view, sql.COLDIV, select=f"""select {sql.rounded(*sql.COLDIV_NAMES, 'column_diversity_score', keys='"column"')} from cd"""))
    register(f"column_ranking{suffix}", view, lambda p: diversity.column_ranking(diversity.column_diversity(p)), sql.query(view, sql.COLDIV, select="""select row_number() over (order by column_diversity_score desc, "column") as rank, "column", round(column_diversity_score, 6) as column_diversity_score, round(gap, 6) as gap, gap < 0.2 as uniform
      from (select *, max(column_diversity_score) over () - min(column_diversity_score) over () as gap from cd)"""))
register("weighted_diversity", "bars", lambda p: diversity.weighted_diversity(diversity.column_diversity(p)), sql.query("bars", sql.COLDIV,
         ", ".join(["w as (select *, case when \"column\" = 'Volume' then 0.3 else 0.7 / 4 end as w from cd)", "a as (select " + ", ".join(f"sum(w * {c}) / sum(w) as {c}" for c in sql.COLDIV_NAMES) + " from w)"]),
         select=f"select {sql.rounded(*sql.COLDIV_NAMES)}, round(({' + '.join(sql.COLDIV_NAMES)}) / 7, 6) as overall_diversity_score, round(({' + '.join(sql.COLDIV_NAMES)}) / 5, 6) as mean_diversity_score from a"))
register("performance_summary", "bars", lambda p: diversity.performance_summary(diversity.column_diversity(p)), sql.query("bars", sql.COLDIV, sql.WEIGHTED, select="""select arg_min("column", (-s, "column")) as best_column, round(max(s), 6) as best_score, arg_max("column", (-s, "column")) as worst_column, round(min(s), 6) as worst_score,
  round(max(s) - min(s), 6) as performance_gap, max(s) - min(s) < 0.2 as uniform_performance, round(max(o) - max(s), 6) as overall_vs_best, round(max(o) - min(s), 6) as overall_vs_worst from (select "column", column_diversity_score as s, (select total / 7 from wt) as o from cd)"""))
register("all_diversity", "bars", diversity.all_diversity, sql.query("bars", sql.COLDIV, sql.WEIGHTED, sql.M1, sql.SCALED, sql.dist("scaled"), sql.UNIQUE, "cov as (select avg(case when d <= 0.5 then 1.0 else 0.0 end) as coverage_ratio from (select other, min(d) as d from dd group by other))",
         select=f"select {sql.rounded(*sql.COLDIV_NAMES, 'coverage_ratio', 'uniqueness_score')}, round(total / 7, 6) as overall_diversity_score, round(total / 5, 6) as mean_diversity_score from wt, cov, uq"))
register("legacy_diversity", "ev", diversity.legacy_diversity, sql.query("ev", sql.M1, sql.SCALED, sql.dist("scaled"), sql.UNIQUE, "cov as (select avg(case when d <= 0.5 then 1.0 else 0.0 end) as coverage_ratio from (select other, min(d) as d from dd group by other))", sql.STATDIV, sql.TEMPDIV,
         select=f"select {sql.rounded(*sql.LEGACY_NAMES)}, round(({' + '.join(sql.LEGACY_NAMES)}) / 7, 6) as overall_diversity_score from cov, uq, statdiv, ad, td"))

# privacy
register("dcr", "emb", privacy.distance_to_closest_record, sql.query("emb", sql.M2, sql.SCALED, sql.dist("scaled"), "nd as (select series, min(d) as d from dd group by series)", "x as (select d, least(d / (select case when quantile_cont(d, 0.95) = 0 then 1 else quantile_cont(d, 0.95) end from nd), 1.0) as x from nd)",
         select="select round(avg(x), 6) as dcr_mean, round(stddev_pop(x), 6) as dcr_std, round(min(x), 6) as dcr_min, round(avg(d), 6) as raw_mean, round(min(d), 6) as raw_min from x"))
register("legacy_privacy", "emb", privacy.legacy_privacy, sql.query("emb", sql.M2, sql.SCALED, sql.dist("scaled"), "nd as (select series, min(d) as d from dd group by series)", "x as (select d, least(d / (select case when quantile_cont(d, 0.95) = 0 then 1 else quantile_cont(d, 0.95) end from nd), 1.0) as x from nd)",
         select="select round(avg(x), 6) as dcr_mean, round(stddev_pop(x), 6) as dcr_std, round(min(x), 6) as dcr_min, " + ", ".join(f"{x}::double as {name}" for name, x in privacy.LEGACY.items()) + " from x"))
register("attribute_disclosure", "ev", lambda p: privacy.attribute_disclosure(p, raw=True), sql.query("ev", sql.M1, f"c as (select f, value, {sql.both('count', 'n')} from m group by f, value)",
         "r as (select f, coalesce(avg(case when n_s > 0 then 1.0 else 0.0 end) filter (where n_o > 0 and n_o / size <= 0.1), 0) as risk from (select *, sum(n_o) over (partition by f) as size from c) group by f)",
         select="select round(avg(risk), 6) as adr_mean, round(max(risk), 6) as adr_max, round(avg(risk), 6) as adr_risk_score from r"))
register("attribute_disclosure_standardized", "ev", privacy.attribute_disclosure, sql.query("ev", sql.M2, f"c as (select f, value, {sql.both('count', 'n')} from m group by f, value)",
         "r as (select f, coalesce(avg(case when n_s > 0 then 1.0 else 0.0 end) filter (where n_o > 0 and n_o / size <= 0.1), 0) as risk from (select *, sum(n_o) over (partition by f) as size from c) group by f)",
         select="select round(avg(risk), 6) as adr_mean, round(max(risk), 6) as adr_max, round(avg(risk), 6) as adr_risk_score from r"))
register("reidentification", "emb", privacy.re_identification, sql.query("emb", sql.M2, sql.SCALED, sql.dist("scaled"), "k as (select series, d from (select *, row_number() over (partition by series order by d) as r from dd) where r <= 5)",
         select="select 1.0::double as reidentification_risk, round(avg(case when n >= 5 then 1.0 else 0.0 end), 6) as k_anonymity_score from (select series, count(distinct round(d, 4)) as n from k group by series)"))
register("dp_epsilon", "ev", privacy.differential_privacy, sql.query("ev", sql.M2, sql.STATS2, select="""select round(coalesce(least(e, 100.0), 100.0), 6) as dp_epsilon_estimate, round(coalesce(1 / (1 + e), 0.0), 6) as dp_privacy_score from (
  select case when max(abs(mean_o - mean_s)) = 0 then 0.1 else max(abs(mean_o - mean_s)) / nullif(stddev_pop(sd_o - sd_s), 0) end as e from s2)"""))
# over every synthetic row; the names with _all stay for those who used them beside capped versions
for name in ("distance_privacy", "distance_privacy_all"):
    register(name, "emb", privacy.distance_privacy, sql.query("emb", sql.M2, sql.SCALED, sql.dist("scaled"), "nd as (select series, min(d) as d from dd group by series)",
             select="select round(greatest(0.2, least(0.9, 0.2 + 0.7 / (1 + exp(-2 * (avg(d) / (quantile_cont(d, 0.75) + 1e-6) - 0.5))))), 6) as distance_privacy from nd"))
for name in ("pattern_uniqueness", "pattern_uniqueness_all"):
    register(name, "emb", privacy.pattern_uniqueness, sql.query("emb", sql.M2, f"pv as (select {sql.side('stddev_pop', 'o', 'v')} as o, {sql.side('stddev_pop', 's', 'v')} as s from (select variant, series, var_pop(value) as v from m group by variant, series))",
             f"pr as (select a.ord as a, b.ord as b, {sql.corr('a.value', 'b.value')} as r from m a join m b on a.f = b.f and a.variant = 's' and b.variant = 's' and a.ord < b.ord group by a.ord, b.ord)",
             select="select round(pd, 6) as pattern_diversity, round(greatest(0.2, least(0.9, 0.2 + 0.7 * tanh(0.4 * least(s / (o + 1e-6), 2.0) + 0.6 * pd))), 6) as pattern_uniqueness from pv, (select coalesce(greatest(0.1, 1 - avg(abs(r))), 0.5) as pd from pr)"))
register("kl_privacy", "ev", privacy.kl_privacy, sql.query("ev", sql.M2, sql.KL, select=f"select {sql.rounded('mean_kl', 'kl_privacy')} from klp"))
register("moment_privacy", "ev", privacy.moment_privacy, sql.query("ev", sql.M2, sql.MOMP, select=f"select {sql.rounded('moment_privacy')} from mp"))
register("distributional_privacy", "ev", lambda p: privacy.distributional_privacy(p).select("distributional_privacy"), sql.query("ev", sql.M2, sql.KL, sql.MOMP, select="select round(greatest(0.2, least(0.9, 0.6 * kl_privacy + 0.4 * moment_privacy)), 6) as distributional_privacy from klp, mp"))
register("column_distributional_privacy", "bars", privacy.column_distributional_privacy, sql.query("bars", sql.KNOWN, sql.per_column("known"), sql.COLPRIV,
         select='select "column", round(overall_privacy_score, 6) as overall_privacy_score, round(overall_privacy_score, 6) as dcr_mean, round(mir_accuracy, 6) as mir_accuracy, round(1 - mir_accuracy, 6) as mir_score from cp'))
register("fallback_privacy", "ev", privacy.fallback_privacy, sql.query("ev", "known as (select variant, 'all' as \"column\", value from points)", sql.per_column("known"), sql.COLPRIV,
         select="select round(overall_privacy_score, 6) as overall_privacy_score, round(overall_privacy_score, 6) as dcr_mean, round(mir_accuracy, 6) as mir_accuracy, round(1 - mir_accuracy, 6) as mir_score from cp"))

# utility
register("simple_distance", "ev", utility.simple_distance, sql.query("ev", sql.M2, sql.STATS2, select="""select round(d, 6) as cfid_distance, round(1 / (1 + d), 6) as cfid_score from (
  select greatest(0.5, least(3.0, (sqrt(avg(pow(mean_o - mean_s, 2))) + sqrt(avg(pow(var_o - var_s, 2)))) / 2)) as d from s2)"""))
register("column_similarity", "bars", utility.column_similarity, sql.query("bars", "known as (select * from points where \"column\" <> 'OpenInt')", sql.per_column("known"), select=f"""select "column", round(list_avg(list_filter([
  case when sd_o > 0 then 1 - least(1.0, abs(mean_o - mean_s) / (3 * sd_o)) end, case when sd_o > 0 then 1 - least(1.0, abs(sd_o - sd_s) / sd_o) end, {sql.QSIM}, {sql.RSIM}], lambda x: x is not null)), 6) as similarity from pc"""))
register("distributional_similarity", "bars", utility.distributional_similarity, sql.query("bars", "known as (select * from points where \"column\" <> 'OpenInt')", sql.per_column("known"), select=f"""select round(greatest(0.1, 3 * (1 - avg(s))), 6) as cfid_distance, round(1 / (1 + greatest(0.1, 3 * (1 - avg(s)))), 6) as cfid_score from (select list_avg(list_filter([
  case when sd_o > 0 then 1 - least(1.0, abs(mean_o - mean_s) / (3 * sd_o)) end, case when sd_o > 0 then 1 - least(1.0, abs(sd_o - sd_s) / sd_o) end, {sql.QSIM}, {sql.RSIM}], lambda x: x is not null)) as s from pc)"""))
register("distribution_similarity", "ev", utility.distribution_similarity, sql.query("ev", sql.M2, sql.DISTSIM, select=f"select {sql.rounded('distribution_similarity')} from dsim"))
register("correlation_preservation", "emb", utility.correlation_preservation, sql.query("emb", sql.M2, sql.CORRP, select=f"select {sql.rounded('correlation_preservation')} from fp"))
register("statistical_consistency", "ev", utility.statistical_consistency, sql.query("ev", sql.M2, sql.CORRP, sql.DISTSIM, select="select round(correlation_preservation, 6) as correlation_preservation, round(distribution_similarity, 6) as distribution_similarity, round((correlation_preservation + distribution_similarity) / 2, 6) as statistical_score from fp, dsim"))
register("temporal_predictability", "bars", lambda p: utility.temporal_predictability(shape.without(p)), sql.query("bars", sql.KNOWN, sql.TPRED, select='select "column", round(temporal_predictability, 6) as temporal_predictability from tp'))
for view in ("bars", "types"):
    register("distributional_predictability" if view == "bars" else "distributional_predictability_types", view, lambda p: utility.two_sided(shape.without(p), ["column"]).select("column", utility.distributional_predictability().alias("distributional_predictability")),
             sql.query(view, sql.KNOWN, sql.per_column("known"), select=f"""select "column", round({sql.DPRED}, 6) as distributional_predictability from pc"""))
register("discriminative_similarity", "bars", utility.discriminative_similarity, sql.query("bars", sql.KNOWN, sql.per_column("known"), sql.DSIM, select='select "column", round(discriminative_similarity, 6) as discriminative_similarity from ds'))
register("column_utility", "bars", utility.column_utility, sql.query("bars", sql.KNOWN, sql.per_column("known"), sql.COLUTIL, select=f"""select {sql.rounded('overall_utility_score', 'correlation_preservation', 'distribution_similarity', keys='"column"')} from cu"""))
register("utility_bounds", "ev", lambda p: utility.bounded(utility.distribution_similarity(p).withColumns({"dt_overall_score": F.col("distribution_similarity") + 1, "ps_score": F.col("distribution_similarity") * 3, "cfid_score": -F.col("distribution_similarity")})),
         sql.query("ev", sql.M2, sql.DISTSIM, select="select round(distribution_similarity, 6) as distribution_similarity, 0.0::double as dt_overall_score, round(least(1.0, distribution_similarity * 3), 6) as ps_score, 0.0::double as cfid_score from dsim"))

# models
register("attack_models", "emb", models.attack)
for view in ("emb", "bars"):
    register("attack_split" if view == "emb" else "attack_split_bars", view, models.attack_split, sql.query(view, sql.M2, sql.SPLIT, select="select variant, ord, place < case when variant = 'o' then ceil(total / 2) else floor(total / 2) end as test from drawn"))
for view in ("ev", "bars"):
    register("column_privacy" if view == "ev" else "column_privacy_bars", view, models.column_privacy)
register("predictive_score", "ev", models.predictive_score)
register("contextual_fid", "emb", models.contextual_fid)
register("contextual_fid_covariance", "emb", lambda p: models.contextual_fid(p, Config(full_covariance=True)))
register("downstream_tasks", "emb", models.downstream_tasks)


# scoring, on the columns of two views as variants
def dimension_frames(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(column, dimension, value) of each column of a view."""
    p = stored_view(spark, sf_dir, view)
    frames = {
        "diversity": diversity.column_diversity(p).select("column", F.col("column_diversity_score").alias("value")),
        "fidelity": fidelity.column_fidelity(p).select("column", F.col("column_fidelity_score").alias("value")),
        "privacy": privacy.column_distributional_privacy(p).select("column", F.col("overall_privacy_score").alias("value")),
        "utility": utility.column_utility(p).select("column", F.col("overall_utility_score").alias("value")),
    }
    return reduce(DataFrame.unionByName, (frame.select("column", F.lit(dimension).alias("dimension"), "value") for dimension, frame in frames.items()))


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table that scoring works on: a row for each column and dimension. The first conditional variant is taken as the baseline."""
    kinds = {"conditional": "types", "unconditional": "bars"}
    rows = reduce(DataFrame.unionByName, (dimension_frames(spark, sf_dir, view).select(F.lit(kind).alias("gen_type"), F.col("column").alias("variant"), "dimension", "value") for kind, view in kinds.items()))
    first = F.min("variant").over(Window.partitionBy("gen_type"))
    return rows.withColumn("variant_type", F.when((F.col("gen_type") == "conditional") & (F.col("variant") == first), "baseline").otherwise("synthetic"))


def column_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores by method and column, for three views as methods; the mean of a method's columns is its score as a whole."""
    methods = (("conditional", "types", "baseline"), ("conditional", "halves", "synthetic"), ("unconditional", "bars", "synthetic"))
    rows = reduce(DataFrame.unionByName, (dimension_frames(spark, sf_dir, view).select(F.lit(kind).alias("gen_type"), F.lit(view).alias("variant"), F.lit(role).alias("variant_type"), "column", "dimension", "value") for kind, view, role in methods))
    whole = rows.groupingSets([["gen_type", "variant", "variant_type", "dimension", "column"], ["gen_type", "variant", "variant_type", "dimension"]], "gen_type", "variant", "variant_type", "dimension", "column")
    return rounded(scoring.column_table(whole.agg(F.avg("value").alias("value"))))


QUERIES["column_table"] = column_table
ORACLE_SQL["column_table"] = sql.BY_METHOD + f"""select {sql.rounded(*sql.DIMS[:4], keys='gen_type, method, "column", place::bigint as place')} from ct"""


def scored(name: str, make: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(variant_scores(spark, sf_dir)))
    ORACLE_SQL[name] = sql.SCORES + oracle


scored("overall_score", scoring.overall_scores, f"select {sql.rounded(*sql.DIMS, keys='gen_type, variant, variant_type')} from wide")
scored("metric_averages", scoring.metric_averages, f"select {sql.rounded(*sql.DIMS, keys='gen_type')} from averages")
scored("best_variant", scoring.best_variants, "select gen_type, round(max(overall_score), 6) as overall_score, arg_max(variant, overall_score) as best_variant from wide where variant_type <> 'baseline' group by gen_type")
scored("recommendations", scoring.recommendations, """select gen_type, r as recommendation from (select gen_type, unnest([case when diversity < 0.5 then 'LOW DIVERSITY' end, case when fidelity < 0.6 then 'LOW FIDELITY' end, case when privacy < 0.4 then 'PRIVACY RISK' end, case when utility < 0.5 then 'LIMITED UTILITY' end,
  case when overall_score > 0.7 then 'EXCELLENT' when overall_score > 0.5 then 'MODERATE' else 'POOR' end, case when overall_score < (select max(overall_score) from wide where variant_type = 'baseline') then 'UNDERPERFORMING' end]) as r from averages) where r is not null""")
scored("baseline_gaps", scoring.ranked_against_baseline, """select gen_type, variant, variant_type, round(overall_score, 6) as overall_score, case when overall_score >= 0.7 then 'good' when overall_score >= 0.5 then 'medium' else 'poor' end as score_class,
  round((select max(overall_score) from wide where variant_type = 'baseline') - overall_score, 6) as gap from wide""")
scored("heatmap_pivot", scoring.heatmap, f"select variant || ' (' || case when variant_type = 'baseline' then 'B' when gen_type = 'conditional' then 'C' else 'U' end || ')' as method, case when variant_type = 'baseline' then 0 else 1 end::bigint as place, {sql.rounded(*sql.DIMS)} from wide")
scored("breakdown", scoring.breakdown, "select dimension, variant, round(coalesce(max(value) filter (where gen_type = 'conditional'), 0), 6) as conditional, round(coalesce(max(value) filter (where gen_type = 'unconditional'), 0), 6) as unconditional from tall group by dimension, variant")
scored("column_comparison", scoring.column_comparison, "select gen_type, dimension, variant, round(value, 6) as value, rank() over (partition by gen_type, dimension order by value desc) as rank, round(value / nullif(max(value) over (partition by gen_type, dimension), 0), 6) as share_of_best from tall")
scored("overall_bars", scoring.overall_bars, "select method, round(overall_score, 6) as overall_score, rank() over (order by overall_score desc) as rank from named")
scored("radar", scoring.radar, """select method, dimension, axis::bigint as axis, round(axis * pi() / 2, 6) as angle, round(value, 6) as value from (
  select *, list_position(['diversity', 'fidelity', 'privacy', 'utility'], dimension) - 1 as axis from (unpivot named on diversity, fidelity, privacy, utility into name dimension value value))""")
scored("business_figures", scoring.business_figures, f"select {sql.rounded(*sql.DIMS, keys='gen_type, variant')} from wide where variant_type <> 'baseline' order by gen_type, wide.overall_score desc, variant limit 1")


def evaluation(learned: bool, names: tuple[str, ...]) -> Query:
    """The whole evaluation of three views as variants."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        metrics = evaluate.evaluate_all({("view", view): POINTS[view](spark, sf_dir) for view in names}, learned=learned)
        return rounded(metrics.where("value is not null"))

    return run


QUERIES |= {"evaluation_measures": evaluation(False, sql.EVALUATED_VIEWS), "evaluate_all": evaluation(True, ("ev", "types", "halves"))}
ORACLE_SQL["evaluation_measures"] = sql.EVALUATED
