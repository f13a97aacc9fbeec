"""SQL that states what the registered queries return, for an independent engine."""

from __future__ import annotations

EV = """points as (
  select case when user_id % 2 = 0 then 'o' else 's' end as variant, user_id as series, dense_rank() over (partition by user_id % 2 order by user_id) - 1 as ord, t, c."column", c.col_ord, c.value
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events) e,
  lateral (select 'value' as "column", 0 as col_ord, e.value as value union all select 'k', 1, cast(json_extract_string(e.props, '$.k') as double)) c)"""
TYPES = """points as (
  select case when user_id % 2 = 0 then 'o' else 's' end as variant, user_id as series, dense_rank() over (partition by user_id % 2 order by user_id) - 1 as ord,
    row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as t, event_type as "column", 0 as col_ord, value from events)"""
BARS_WIDE = """bars as (
  select case when l_suppkey % 2 = 1 then 'o' else 's' end as variant, l_suppkey as series, dense_rank() over (partition by l_suppkey % 2 order by l_suppkey) - 1 as ord,
    row_number() over (partition by l_suppkey order by date_trunc('month', l_shipdate)) - 1 as t,
    arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as "Open", max(l_extendedprice) as "High", min(l_extendedprice) as "Low",
    arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as "Close", sum(l_quantity) as "Volume", 0.0::double as "OpenInt"
  from lineitem group by l_suppkey, date_trunc('month', l_shipdate))"""
BARS = BARS_WIDE + """, points as (
  select b.variant, b.series, b.ord, b.t, c."column", c.col_ord, c.value from bars b, lateral (
    select 'Open' as "column", 0 as col_ord, b."Open" as value union all select 'High', 1, b."High" union all select 'Low', 2, b."Low"
    union all select 'Close', 3, b."Close" union all select 'Volume', 4, b."Volume" union all select 'OpenInt', 5, b."OpenInt") c)"""
EMB = """points as (
  select case when label % 2 = 0 then 'o' else 's' end as variant, vec_id as series, dense_rank() over (partition by label % 2 order by vec_id) - 1 as ord, 0 as t,
    format('d{:02d}', i - 1) as "column", i - 1 as col_ord, embedding[i]::double as value
  from embeddings, lateral (select unnest(range(1, len(embedding) + 1)) as i))"""
HALVES = TYPES.replace("user_id % 2", "event_id % 2").replace("partition by user_id, event_type", "partition by user_id, event_id % 2, event_type")
VIEWS = {"ev": EV, "types": TYPES, "bars": BARS, "emb": EMB, "halves": HALVES}

CELLS = """cells as (select *, row_number() over (partition by variant, series order by t, col_ord, "column") - 1 as f, count(*) over (partition by variant, series) as n from points)"""
M1 = CELLS + """, m as (select variant, series, ord, f, value from cells, (select min(n) as l from cells where variant = 'o') where n >= l and f < l)"""
M2 = """zs as (select variant, series, ord, row_number() over (partition by variant, series order by t, col_ord, "column") - 1 as f, case when sd > 0 then (value - mean) / sd else value end as value, count(*) over (partition by variant, series) as n
    from (select *, avg(value) over w as mean, stddev_pop(value) over w as sd from points where "column" <> 'OpenInt' window w as (partition by variant, series, "column"))),
  size as (select cast(floor(quantile_cont(n, 0.75)) as integer) as l from zs where variant = 'o' and f = 0),
  m as (select variant, series, ord, f, value from zs, size where n >= l // 2 and f < l
    union all select variant, series, ord, unnest(range(n, l)) as f, value from (select variant, series, ord, n, arg_max(value, f) as value from zs group by all), size where n >= l // 2 and n < l)"""
SCALED = """scaled as (select variant, series, ord, f, (value - mean) / case when sd = 0 then 1 else sd end as value from m join (select f, avg(value) as mean, stddev_pop(value) as sd from m where variant = 'o' group by f) using (f))"""
COLS = """cm as (select p.* from points p join (select variant, min(last) + 1 as rows from (select variant, series, max(t) as last from points group by all) group by variant) using (variant) where t < rows and lower("column") <> 'openint'),
  cs as (select "column", avg(value) as mean, stddev_samp(value) as sd, min(value) as lo, max(value) as hi, max(value) - min(value) as range, count(distinct series) as n_series from cm where variant = 'o' group by "column"),
  nc as (select variant, series, ord, t, "column", col_ord, (value - mean) / case when sd > 1e-8 then sd else 1 end as value from cm join cs using ("column") where "column" in (select "column" from cm where variant = 's'))"""


def corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop(case when {x} is not null then {y} end) * stddev_pop(case when {y} is not null then {x} end), 0))"


def bin_(lo: str, hi: str, n: int, v: str = "value") -> str:
    return f"(case when {lo} = {hi} then 0 else least(floor(({v} - {lo}) / (({hi} - {lo}) / {n})), {n - 1}) end)"


def sym(o: str, s: str) -> str:
    return f"(case when {o} = 0 then case when {s} = 0 then 1.0 else 0.0 end when {s} = 0 then 0.0 else least({s} / {o}, {o} / {s}) end)"


def cap(o: str, s: str) -> str:
    return f"(case when {o} = 0 then case when {s} = 0 then 1.0 else 0.0 end else least({s} / {o}, 1.0) end)"


def side(agg: str, x: str, v: str = "value") -> str:
    return f"{agg}({v}) filter (where variant = '{x}')"


def both(agg: str, name: str, v: str = "value") -> str:
    return f"{side(agg, 'o', v)} as {name}_o, {side(agg, 's', v)} as {name}_s"


def query(view: str, *ctes: str, select: str) -> str:
    return "with " + ", ".join([VIEWS[view], *ctes]) + " " + select


def rounded(*names: str, keys: str = "") -> str:
    return (keys + ", " if keys else "") + ", ".join(f"round({n}::double, 6) as {n}" for n in names)


def summary(prefix: str, extreme: str = "max") -> str:
    return f"select round(coalesce(avg(score), 1.0), 6) as {prefix}_mean, round(coalesce(stddev_pop(score), 0.0), 6) as {prefix}_std, round(coalesce({extreme}(score), 1.0), 6) as {prefix}_{extreme} from scores"


MDD = f"""sz as (select f, min(value) as lo, max(value) as hi, {both('count', 'size')} from m group by f),
  scores as (select f, sum(case when lo = hi then 0.0 else abs(n_o / size_o - n_s / size_s) end) as score from (
    select f, lo, hi, size_o, size_s, {bin_('lo', 'hi', 50)} as b, {both('count', 'n')} from m join sz using (f) where size_o > 0 and size_s > 0 group by f, lo, hi, size_o, size_s, b) group by f)"""
ACF = f"""acfs as (select variant, series, ord, "column", lag, case when n > 10 then coalesce(r, 0.0) else 0.0 end as acf from (
    select a.variant, a.series, a.ord, a."column", l.lag, any_value(a.n) as n, {corr('a.value', 'b.value')} as r
    from (select *, count(*) over (partition by variant, series, "column") as n from points) a cross join (select unnest(range(1, 11)) as lag) l
    left join points b on a.variant = b.variant and a.series = b.series and a."column" = b."column" and b.t = a.t - l.lag group by a.variant, a.series, a.ord, a."column", l.lag))"""
ACD = """scores as (select ord, avg(abs(o.acf - s.acf)) as score from (select * from acfs where variant = 'o') o join (select * from acfs where variant = 's') s using (ord, "column", lag) group by ord)"""


def skew(x: str) -> str:
    return f"(avg(case when variant = '{x}' then pow(value - mean_{x}, 3) end) / nullif(pow(stddev_pop(case when variant = '{x}' then value end), 3), 0))"


def moments(source: str, key: str) -> str:
    return f"""mo as (select {key}, {both('count', 'n')}, {both('avg', 'mean')}, {both('stddev_pop', 'sd')}, {skew('o')} as skew_o, {skew('s')} as skew_s, {both('kurtosis_pop', 'kurt')} from (
      select *, avg(case when variant = 'o' then value end) over (partition by {key}) as mean_o, avg(case when variant = 's' then value end) over (partition by {key}) as mean_s from {source}) group by {key})"""


RANKED = """rk as (select variant, f, value, dense_rank() over (partition by variant order by ord) - 1 as ord from {m})"""
EUCLID = RANKED.format(m="m") + """, scores as (select ord, sqrt(avg(pow(o.value - s.value, 2))) as score from (select * from rk where variant = 'o') o join (select * from rk where variant = 's') s using (ord, f) group by ord)"""


def ecdf(source: str, key: str) -> str:
    return f"""st as (select {key}, value, sum(n_o) over w / sum(n_o) over (partition by {key}) as cdf_o, sum(n_s) over w / sum(n_s) over (partition by {key}) as cdf_s, lead(value) over w - value as gap
      from (select {key}, value, {both('count', 'n')} from {source} group by {key}, value) window w as (partition by {key} order by value))"""


W1 = SCALED + ", " + ecdf("scaled", "f") + ", scores as (select f, coalesce(sum(abs(cdf_o - cdf_s) * gap), 0) as score from st group by f)"
# a row of the table follows from the one above: with running sums c of its own squares, d[j] = c[j] + min over k <= j of (min(above[k - 1], above[k]) - c[k - 1])
DTW = """vs as (select ord, "column", list(value order by t) filter (where variant = 'o') as a, list(value order by t) filter (where variant = 's') as b from points group by ord, "column"),
  pairs as (select * from vs where len(a) > 1 and len(b) > 1),
  warp as (with recursive w(ord, "column", a, b, i, d) as (
      select ord, "column", a, b, 0, list_concat([0.0::double], list_transform(b, lambda x: 'inf'::double)) from pairs
      union all select ord, "column", a, b, i + 1, list_concat(['inf'::double], list_transform(range(1, len(b) + 1), lambda j: c[j] + list_min(m[1:j]))) from (
        select *, list_transform(range(1, len(b) + 1), lambda k: least(d[k], d[k + 1]) - (c[k] - s[k])) as m from (
          select *, list_transform(range(1, len(b) + 1), lambda k: list_sum(s[1:k])) as c from (select *, list_transform(b, lambda y: pow(a[i + 1] - y, 2)) as s from w where i < len(a)))))
    select ord, "column", sqrt(d[len(d)]) / greatest(len(a), len(b)) as score from w where i = len(a)),
  scores as (select score from warp)"""


def plain_summary(prefix: str, extreme: str) -> str:
    return f"select coalesce(avg(score), 1.0) as {prefix}_mean, coalesce(stddev_pop(score), 0.0) as {prefix}_std, coalesce({extreme}(score), 1.0) as {prefix}_{extreme} from scores"


POOLED = """ids as (select series, count(distinct variant) as sides from points group by series), pooled as (
    select p.* from points p join (select series, "column", count(distinct variant) as sides from points where value is not null group by series, "column") s using (series, "column")
    where lower("column") <> 'openint' and value is not null and ((select max(sides) from ids) < 2 or sides = 2))"""
COLFID = POOLED + ", " + ecdf("pooled", '"column"') + ", " + moments("pooled", '"column"') + """, cf as (select "column", greatest(0.0, 1 - ks) as mdd,
    coalesce(greatest(0.0, 1 - (abs(mean_o - mean_s) / (abs(mean_o) + 1e-10) + abs(sd_o - sd_s) / (abs(sd_o) + 1e-10) + abs(skew_o - skew_s) / (abs(skew_o) + 1e-10) + abs(kurt_o - kurt_s) / (abs(kurt_o) + 1e-10)) / 4), 0) as moment_similarity
    from mo join (select "column", max(abs(cdf_o - cdf_s)) as ks from st group by "column") using ("column"))"""


# every fidelity measure of a view as one row
FIDELITY_NAMES = tuple(f"{p}_{x}" for p, e in (("mdd", "max"), ("acd", "max"), ("dtw", "min"), ("euclidean", "min"), ("wasserstein", "min")) for x in ("mean", "std", e)) + ("skewness_diff", "kurtosis_diff", "moment_score", "overall_fidelity_score")
FIDELITY = f"""f1 as (with {M1}, {MDD} {plain_summary('mdd', 'max')}), f2 as (with {ACF}, {ACD} {plain_summary('acd', 'max')}), f3 as (with {DTW} {plain_summary('dtw', 'min')}),
  f4 as (with {M1}, {EUCLID} {plain_summary('euclidean', 'min')}), f5 as (with {M1}, {W1} {plain_summary('wasserstein', 'min')}),
  f6 as (with {M1}, {moments('m', 'f')} select *, greatest(0.0, 1 - (skewness_diff + kurtosis_diff) / 2) as moment_score from (select coalesce(avg(abs(skew_o - skew_s)), 1.0) as skewness_diff, coalesce(avg(abs(kurt_o - kurt_s)), 1.0) as kurtosis_diff from mo where n_o > 3 and n_s > 3)),
  fid as (select *, greatest(0.0, 1 - (mdd_mean + acd_mean + 1 - moment_score + least(dtw_mean, 1.0) + least(euclidean_mean, 1.0) + least(wasserstein_mean, 1.0)) / 6) as overall_fidelity_score from f1, f2, f3, f4, f5, f6)"""


def entropy(source: str, key: str) -> str:
    return f"""er as (select {key}, variant, n, case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi from (select {key}, variant, min(value) as lo, max(value) as hi, count(*) as n from {source} group by {key}, variant)),
    en as (select {key}, variant, -sum(p * ln(p)) - (10 - count(*)) * any_value(e * ln(e)) as entropy from (
      select {key}, variant, (c / (n * w) + 1e-10) / (1 / w + 1e-9) as p, 1e-10 / (1 / w + 1e-9) as e from (
        select {key}, variant, n, (hi - lo) / 10 as w, {bin_('lo', 'hi', 10)} as b, count(*) as c from {source} join er using ({key}, variant) group by {key}, variant, n, lo, hi, b)) group by {key}, variant),
    ep as (select {key}, max(entropy) filter (where variant = 'o') as e_o, max(entropy) filter (where variant = 's') as e_s from en group by {key})"""


STATDIV = entropy("m", "f") + f""", sd as (select f, {both('var_pop', 'var')}, {both('max', 'hi')}, {both('min', 'lo')} from m group by f),
  statdiv as (select avg({sym('var_o', 'var_s')}) as variance_ratio, avg({sym('(hi_o - lo_o)', '(hi_s - lo_s)')}) as range_ratio, avg({sym('e_o', 'e_s')}) as entropy_ratio from sd join ep using (f))"""
TREND = """tr as (select variant, series, ord, "column", coalesce(regr_slope(value, t), 0) as slope, coalesce(avg(second), 0) as curvature from (
    select *, value - 2 * lag(value, 1) over w + lag(value, 2) over w as second from points window w as (partition by variant, series, "column" order by t)) group by variant, series, ord, "column")"""
TEMPDIV = ACF + ", " + TREND + f""", ad as (select avg({sym('o', 's')}) as autocorr_diversity from (select {side('var_pop', 'o', 'acf')} as o, {side('var_pop', 's', 'acf')} as s from acfs group by "column", lag)),
  td as (select avg({sym('o', 's')}) as trend_diversity from (select {side('var_pop', 'o', 'x')} as o, {side('var_pop', 's', 'x')} as s from (
    select variant, "column", 'slope' as what, slope as x from tr union all select variant, "column", 'curvature', curvature from tr) group by "column", what))"""


def across(source: str, name: str = "sx") -> str:
    return f"""{name} as (select variant, "column", lag(value) over w as x, value as y from {source} window w as (partition by variant, "column" order by ord, t))"""


COLDIV = COLS + ", " + entropy("nc", '"column"') + ", " + across("nc") + f""", r1 as (select variant, "column", avg(r) as r from (select variant, "column", stddev_pop(value) as sd, {corr('before', 'value')} as r
      from (select *, lag(value) over (partition by variant, series, "column" order by t) as before from nc) group by variant, series, "column") where sd > 1e-8 group by variant, "column"),
  r2 as (select variant, "column", {corr('x', 'y')} as r from sx group by variant, "column"),
  rr as (select "column", coalesce(greatest(0.0, 1 - case when o1 is null or s1 is null then abs(o2 - s2) else abs(o1 - s1) end), 0) as autocorr_diversity from (
    select "column", {side('max', 'o', 'r')} as o2, {side('max', 's', 'r')} as s2 from r2 group by "column") left join (select "column", {side('max', 'o', 'r')} as o1, {side('max', 's', 'r')} as s1 from r1 group by "column") using ("column")),
  sp as (select "column", {both('var_samp', 'v')}, {both('min', 'lo')}, {both('max', 'hi')} from nc group by "column"),
  cd as (select *, (variance_ratio + range_ratio + entropy_ratio + autocorr_diversity + coverage) / 5 as column_diversity_score from (
    select "column", {cap('v_o', 'v_s')} as variance_ratio, {cap('(hi_o - lo_o)', '(hi_s - lo_s)')} as range_ratio, {cap('e_o', 'e_s')} as entropy_ratio, autocorr_diversity,
      case when hi_o = lo_o then case when hi_s = lo_s then 1.0 else 0.0 end when least(hi_o, hi_s) <= greatest(lo_o, lo_s) then 0.0 else least((least(hi_o, hi_s) - greatest(lo_o, lo_s)) / (hi_o - lo_o), 1.0) end as coverage
    from sp join ep using ("column") join rr using ("column")))"""
COLDIV_NAMES = ("variance_ratio", "range_ratio", "entropy_ratio", "autocorr_diversity", "coverage")


WEIGHTED = ", ".join(["w as (select *, case when \"column\" = 'Volume' then 0.3 else 0.7 / 4 end as w from cd)", "wa as (select " + ", ".join(f"sum(w * {c}) / sum(w) as {c}" for c in COLDIV_NAMES) + " from w)", f"wt as (select *, {' + '.join(COLDIV_NAMES)} as total from wa)"])
LEGACY_NAMES = ("coverage_ratio", "uniqueness_score", "variance_ratio", "range_ratio", "entropy_ratio", "autocorr_diversity", "trend_diversity")
UNIQUE = """syn as (select series, list(value order by f) as v from m where variant = 's' group by series),
  uq as (select avg(case when sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))) > 1e-6 then 1.0 else 0.0 end) as uniqueness_score from syn a join syn b on a.series < b.series)"""


SPLIT = """own as (select distinct variant, ord as before from m), placed as (select variant, row_number() over (partition by variant order by before) - 1 as ord, count(*) over (partition by variant) as n from own),
  cut as (select variant, ord, least, ceil(0.6 * least) as total from placed, (select min(n) as least from placed) where ord < least),
  drawn as (select *, row_number() over (partition by variant order by md5(concat_ws(':', variant, ord, 42)), ord) - 1 as place from cut)"""


def dist(m: str) -> str:
    """Distances from synthetic (b) to original (a) rows of a matrix."""
    return f"""vec as (select variant, series, ord, list(value order by f) as v from {m} group by variant, series, ord),
      dd as (select b.series, a.series as other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))) as d from vec a join vec b on a.variant = 'o' and b.variant = 's')"""


STATS2 = f"""s2 as (select f, {both('count', 'n')}, {both('avg', 'mean')}, {both('stddev_pop', 'sd')}, {both('min', 'lo')}, {both('max', 'hi')}, {both('var_pop', 'var')} from m group by f)"""
KL = f"""kr as (select f, min(value) as lo, max(value) as hi, {both('count', 'size')} from m group by f having {side('count', 'o')} > 10 and {side('count', 's')} > 10 and max(value) > min(value)),
  kl as (select avg(k) as kl from (select f, sum(p * ln(p / q)) as k from (
    select f, (n_s / (size_s * w) + 1e-8) / (1 / w + 19e-8) as p, (n_o / (size_o * w) + 1e-8) / (1 / w + 19e-8) as q from (
      select f, (hi - lo) / 19 as w, size_o, size_s, {bin_('lo', 'hi', 19)} as b, {both('count', 'n')} from m join kr using (f) group by f, lo, hi, size_o, size_s, b)) group by f)),
  klp as (select kl as mean_kl, case when kl is null then 0.5 else greatest(0.2, least(0.9, case when kl < 0.05 then 0.3 when kl > 2 then 0.4 else 0.5 + 0.4 * (kl - 0.05) / 1.95 end)) end as kl_privacy from kl)"""
MOMP = STATS2 + """, mp as (select coalesce(greatest(0.2, least(0.9, 0.3 + 0.6 * tanh(2 * avg(x)))), 0.5) as moment_privacy from (
    select abs(mean_o - mean_s) / (hi_o - lo_o) as x from s2 where n_o > 5 and n_s > 5 and hi_o > lo_o union all select least(abs(sd_o - sd_s) / sd_o, 1.0) from s2 where n_o > 5 and n_s > 5 and sd_o > 0))"""


def per_column(source: str) -> str:
    return f"""pc as (select "column", {both('count', 'n')}, {both('avg', 'mean')}, {both('stddev_pop', 'sd')}, {both('min', 'lo')}, {both('max', 'hi')},
      {side('quantile_cont', 'o').replace('(value)', '(value, [0.25, 0.5, 0.75])')} as q_o, {side('quantile_cont', 's').replace('(value)', '(value, [0.25, 0.5, 0.75])')} as q_s from {source} group by "column")"""


QSIM = "(case when q_o[3] > q_o[1] then greatest(0.0, 1 - (abs(q_o[1] - q_s[1]) + abs(q_o[2] - q_s[2]) + abs(q_o[3] - q_s[3])) / 3 / (q_o[3] - q_o[1])) end)"
RSIM = "(case when hi_o > lo_o then 1 - least(1.0, abs((hi_o - lo_o) - (hi_s - lo_s)) / (hi_o - lo_o)) end)"
KNOWN = """known as (select * from points where lower("column") <> 'openint' and value is not null)"""
COLPRIV = """cp as (select "column", case when n_o > 0 and n_s > 0 then p else 0.1 end as overall_privacy_score, case when n_o > 0 and n_s > 0 then greatest(0.5, 1 - p) else 0.9 end as mir_accuracy from (
    select "column", n_o, n_s, (coalesce(least(1.0, abs(mean_o - mean_s) / nullif(hi_o - lo_o, 0)), 0) + case when hi_o > lo_o then coalesce(least(1.0, abs(sd_o - sd_s) / nullif(sd_o, 0)), 0) else 0 end) / 2 as p from pc))"""
DSIM = f"""ov as (select "column", sum(least(n_o / size_o, n_s / size_s)) as overlap from (
    select "column", size_o, size_s, {bin_('lo', 'hi', 19)} as b, {both('count', 'n')} from known join (select "column", min(value) as lo, max(value) as hi, {both('count', 'size')} from known group by "column") using ("column") group by "column", lo, hi, size_o, size_s, b) group by "column"),
  ds as (select "column", list_avg(list_filter([{QSIM}, {RSIM}, case when (mean_o > 1000 or mean_s > 1000) and least(mean_o, mean_s) / greatest(mean_o, mean_s) < 0.5 then overlap * least(mean_o, mean_s) / greatest(mean_o, mean_s) else overlap end], lambda x: x is not null)) as discriminative_similarity from pc join ov using ("column"))"""
TPRED = """cx as (select * from known where (variant, series, "column", t) not in (select variant, series, "column", max(t) from known group by all)), """ + across("cx", "cy") + f""",
  tp as (select "column", coalesce(greatest(0.0, 1 - abs(o - s)), 0.3) as temporal_predictability from (select "column", {side('max', 'o', 'r')} as o, {side('max', 's', 'r')} as s from (
    select variant, "column", {corr('x', 'y')} as r from cy group by variant, "column") group by "column"))"""
DPRED = """case when hi_o > lo_o and sd_o > 0 then greatest(0.0, 1 - (case when mean_o > 1000 or mean_s > 1000 then greatest(abs(mean_o - mean_s) / (hi_o - lo_o), 1 - least(mean_o, mean_s) / greatest(mean_o, mean_s)) else abs(mean_o - mean_s) / (hi_o - lo_o) end + abs(sd_o - sd_s) / sd_o) / 2) else 0.5 end"""
COLUTIL = TPRED + ", " + DSIM + f""", cu as (select "column", 0.6 * c + 0.4 * d as overall_utility_score, c as correlation_preservation, d as distribution_similarity from (
    select "column", discriminative_similarity as d, case when n_o < 10 or n_s < 10 then 0.1 when held_o > 5 and held_s > 5 then temporal_predictability
      when hi_o > lo_o and sd_o > 0 then greatest(0.0, 1 - (case when mean_o > 1000 or mean_s > 1000 then greatest(abs(mean_o - mean_s) / (hi_o - lo_o), 1 - least(mean_o, mean_s) / greatest(mean_o, mean_s)) else abs(mean_o - mean_s) / (hi_o - lo_o) end + abs(sd_o - sd_s) / sd_o) / 2) else 0.5 end as c
    from pc join ds using ("column") join tp using ("column") join (select "column", {both('count', 'held', 't')} from cx group by "column") using ("column")))"""
CORRP = f"""fc as (select a.variant, a.f as i, b.f as j, {corr('a.value', 'b.value')} as r from m a join m b on a.variant = b.variant and a.series = b.series and a.f < b.f group by a.variant, a.f, b.f),
  fp as (select case when count(*) = 0 then 1.0 else coalesce(abs({corr('o', 's')}), 0) end as correlation_preservation from (select i, j, {side('max', 'o', 'r')} as o, {side('max', 's', 'r')} as s from fc group by i, j) where o is not null and s is not null)"""
DISTSIM = STATS2 + """, dsim as (select coalesce(avg(1 / (1 + abs(mean_o - mean_s) / (abs(mean_o) + 1e-10) + abs(sd_o - sd_s) / (sd_o + 1e-10))), 0) as distribution_similarity from s2 where n_o > 0 and n_s > 0)"""


def dimensions(view: str, kind: str, tag: str) -> str:
    """The four dimension scores of each column of a view."""
    parts = ", ".join([VIEWS[view], COLDIV, COLFID, KNOWN, per_column("known"), COLPRIV, COLUTIL])
    return f"""{tag} as (with {parts} select '{kind}' as gen_type, "column" as variant, column_diversity_score as diversity, 0.6 * mdd + 0.4 * moment_similarity as fidelity, overall_privacy_score as privacy, overall_utility_score as utility
      from cd join cf using ("column") join cp using ("column") join cu using ("column"))"""


DIMS = ("diversity", "fidelity", "privacy", "utility", "overall_score")
SCORES = "with " + dimensions("types", "conditional", "sa") + ", " + dimensions("bars", "unconditional", "sb") + """, wide as (
  select *, case when gen_type = 'conditional' and variant = (select min(variant) from sa) then 'baseline' else 'synthetic' end as variant_type,
    greatest(0.0, least(1.0, 0.25 * diversity + 0.35 * fidelity + 0.15 * privacy + 0.25 * utility)) as overall_score from (select * from sa union all select * from sb)),
  named as (select *, variant || ' (' || case when variant_type = 'baseline' then 'B' when gen_type = 'conditional' then 'C' else 'U' end || ')' as method from wide),
  averages as (select gen_type, avg(diversity) as diversity, avg(fidelity) as fidelity, avg(privacy) as privacy, avg(utility) as utility, avg(overall_score) as overall_score from wide where variant_type <> 'baseline' group by gen_type),
  tall as (unpivot wide on diversity, fidelity, privacy, utility into name dimension value value) """
# a view is a method here: event types by user (the baseline), event types by halves of a user's events, bars
BY_METHOD = "with " + ", ".join(dimensions(*x) for x in (("types", "conditional", "sa"), ("halves", "conditional", "sb"), ("bars", "unconditional", "sc"))) + """, cs as (
  select 'types (B)' as method, * from sa union all select 'halves (C)', * from sb union all select 'bars (U)', * from sc), ct as (
  select gen_type, method, variant as "column", case variant when 'Open' then 1 when 'High' then 2 when 'Low' then 3 when 'Close' then 4 when 'Volume' then 5 else 9 end as place, diversity, fidelity, privacy, utility from cs
  union all select gen_type, method, 'OVERALL', 10, avg(diversity), avg(fidelity), avg(privacy), avg(utility) from cs group by gen_type, method) """


def long_form(table: str, dimension: str, names: tuple[str, ...], by_column: bool = False) -> str:
    column = '"column"' if by_column else "null::varchar"
    return f"""select '{dimension}' as dimension, {column} as "column", metric, value from (unpivot {table} on {', '.join(f'{n}::double as {n}' for n in names)} into name metric value value)"""


def evaluated(view: str, tag: str) -> str:
    """All measures of a view that learn no model, as rows; its columns have equal weights, but for bars."""
    near = SCALED + ", " + dist("scaled")
    dcr = "nd as (select series, min(d) as d from dd group by series), x as (select d, least(d / (select case when quantile_cont(d, 0.95) = 0 then 1 else quantile_cont(d, 0.95) end from nd), 1.0) as x from nd)"
    equal = ", ".join(f"avg({n}) as {n}" for n in COLDIV_NAMES)
    whole = f"with {COLDIV}, {WEIGHTED} select {', '.join(COLDIV_NAMES)} from wa" if view == "bars" else f"with {COLDIV} select {equal} from cd"
    tables = f"""{VIEWS[view]}, {FIDELITY},
      v1 as ({whole}),
      v2 as (with {M1}, {near} select avg(case when d <= 0.5 then 1.0 else 0.0 end) as coverage_ratio from (select other, min(d) as d from dd group by other)),
      v3 as (with {M1}, {UNIQUE} select uniqueness_score from uq),
      div as (select *, ({' + '.join(COLDIV_NAMES)}) / 7 as overall_diversity_score, ({' + '.join(COLDIV_NAMES)}) / 5 as mean_diversity_score from v1, v2, v3),
      st as (with {M2}, {CORRP}, {DISTSIM} select *, (correlation_preservation + distribution_similarity) / 2 as statistical_score from fp, dsim),
      pr as (with {M2}, {near}, {dcr} select avg(x) as dcr_mean, stddev_pop(x) as dcr_std, min(x) as dcr_min, avg(d) as raw_mean, min(d) as raw_min from x),
      c1 as (with {COLDIV} select "column", {', '.join(COLDIV_NAMES)}, column_diversity_score from cd),
      c2 as (with {COLFID} select "column", 0.6 * mdd + 0.4 * moment_similarity as column_fidelity_score, mdd, moment_similarity from cf),
      c3 as (with {KNOWN}, {per_column("known")}, {COLUTIL} select "column", overall_utility_score, correlation_preservation, distribution_similarity from cu),
      md as (select (count(distinct series) filter (where variant = 'o')) as original_samples, (count(distinct series) filter (where variant = 's')) as synthetic_samples from points)"""
    rows = [
        long_form("div", "diversity", (*COLDIV_NAMES, "coverage_ratio", "uniqueness_score", "overall_diversity_score", "mean_diversity_score")),
        long_form("fid", "fidelity", FIDELITY_NAMES),
        long_form("st", "utility", ("correlation_preservation", "distribution_similarity", "statistical_score")),
        long_form("pr", "privacy", ("dcr_mean", "dcr_std", "dcr_min", "raw_mean", "raw_min")),
        long_form("c1", "diversity", (*COLDIV_NAMES, "column_diversity_score"), True),
        long_form("c2", "fidelity", ("column_fidelity_score", "mdd", "moment_similarity"), True),
        long_form("c3", "utility", ("overall_utility_score", "correlation_preservation", "distribution_similarity"), True),
        long_form("md", "metadata", ("original_samples", "synthetic_samples")),
    ]
    return f"""{tag} as (with {tables} select '{view}' as variant, * from ({' union all '.join(rows)}))"""


EVALUATED_VIEWS = ("ev", "types", "bars")
EVALUATED = "with " + ", ".join(evaluated(v, f"e{i}") for i, v in enumerate(EVALUATED_VIEWS)) + """ select 'view' as gen_type, variant, 'synthetic' as variant_type, dimension, "column", metric, round(value, 6) as value from (
  """ + " union all ".join(f"select * from e{i}" for i in range(len(EVALUATED_VIEWS))) + ")"
