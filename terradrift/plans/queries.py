"""Registered queries of the point model, and the SQL that must give the same rows.

SQL is left out where it cannot express the operator: seasonal fits and jumps (a least-squares kernel),
mixture models, buffered hulls, projections, and files with footers. Those are tested against closed forms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.functions import scalars
from terradrift.operators import classify as C
from terradrift.operators import clusters, ingest, mixture, series, views
from terradrift.operators.dbscan import dbscan
from terradrift.operators.kernels import kernel_features
from terradrift.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- SQL of the adapters --------------------------------------------------------------------------

POINTS = """pts as (select 'customer' as source_file, cast(c_custkey as varchar) as pid, 44 + (c_custkey * 104729 % 3000)::double / 1000 as latitude,
    6 + (c_custkey * 7919 % 8000)::double / 1000 as longitude, case when c_custkey % 50 = 0 then null else (c_custkey * 37 % 720 - 180)::double end as track_angle,
    (c_custkey * 31 % 1000)::double / 1000 as temporal_coherence, (c_acctbal - 4500) / 500 as mean_velocity, case when c_custkey % 7 = 0 then null else c_mktsegment end as class_1 from customer),
    op as (select *, case when track_angle is null then 'U' when ((track_angle % 360) + 360) % 360 > 90 and ((track_angle % 360) + 360) % 360 < 270 then 'D' else 'A' end as orbit from pts)"""


def _series_sql(kind: str) -> str:
    if kind == "user":
        rows = "select cast(user_id as varchar) as pid, cast(ts as date) as acq_date, sum(value) as disp from events group by 1, 2"
    else:
        key = "l_suppkey" if kind == "supplier" else "l_partkey"
        rows = f"select cast({key} as varchar) as pid, cast(date_trunc('month', l_shipdate) as date) as acq_date, avg(l_extendedprice) / 1000 as disp from lineitem group by 1, 2"
    return f"""raw as ({rows}), ser as (select '{kind}' as source_file, g.pid, g.acq_date, r.disp from (select * from (select distinct pid from raw) cross join (select distinct acq_date from raw)) g
        left join raw r on r.pid = g.pid and r.acq_date = g.acq_date)"""


_YEAR = "(year({0}) + date_diff('day', date_trunc('year', {0})::date, {0})::double / date_diff('day', date_trunc('year', {0})::date, (date_trunc('year', {0}) + interval 1 year)::date))"
_AXIS = f"""ax as (select source_file, acq_date, row_number() over (partition by source_file order by acq_date) - 1 as pos, count(*) over (partition by source_file) as n_dates, {_YEAR.format("acq_date")} as t_year
        from (select distinct source_file, acq_date from ser)), axis as (select *, t_year - avg(t_year) over (partition by source_file) as t from ax),
        onax as (select ser.*, pos, n_dates, t, disp as y from ser join axis using (source_file, acq_date))"""


# --- viewer ---------------------------------------------------------------------------------------

VIEW = dict(min_lat=44.2, max_lat=46.5, min_lon=6.5, max_lon=13.0, thresh=2.5, min_coh=0.2, asc=True, desc=True, zoom=5)


@query(f"""with {POINTS}, f as (select * from op where latitude between 44.2 and 46.5 and longitude between 6.5 and 13.0 and abs(mean_velocity) >= 2.5 and temporal_coherence >= 0.2 and orbit in ('A', 'D')),
    r as (select *, row_number() over (partition by floor(latitude / 0.12::double), floor(longitude / 0.12::double) order by temporal_coherence desc, pid) as rn from f)
    select pid, latitude, longitude, round(mean_velocity, 2) as mean_velocity, round(temporal_coherence, 3) as temporal_coherence, orbit, 0 as max_gap_days,
    coalesce(class_1, 'unclassified') as class_1, 'unclassified' as class_2, 0.0::double as class_prob_1, false as periodic, false as jumpy, false as variable_flag, false as noisy_trend,
    (select count(*) from f) as total_count from r where rn = 1""")
def points_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.points_in_view(A.with_orbit(A.points(spark, sf_dir)), **VIEW)


@query(ORACLE["points_in_view"].replace("orbit in ('A', 'D')", "false"))
def no_orbit_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.points_in_view(A.with_orbit(A.points(spark, sf_dir)), **(VIEW | {"asc": False, "desc": False}))


@query(f"with {POINTS} select orbit, count(*) as n from op group by orbit")
def orbit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.orbit_counts(A.with_orbit(A.points(spark, sf_dir)))


@query(f"""with {POINTS} select count(*) as total_points, count(*) filter (orbit = 'A') as orbit_a, count(*) filter (orbit = 'D') as orbit_d, count(*) filter (orbit = 'U') as orbit_u,
    round(min(mean_velocity), 2) as vel_min, round(max(mean_velocity), 2) as vel_max, round(avg(mean_velocity), 2) as vel_mean, round(stddev_samp(mean_velocity), 2) as vel_stddev,
    round(min(temporal_coherence), 3) as coh_min, round(max(temporal_coherence), 3) as coh_max, round(min(longitude), 4) as min_lon, round(max(longitude), 4) as max_lon,
    round(min(latitude), 4) as min_lat, round(max(latitude), 4) as max_lat from op""")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dataset_info(A.with_orbit(A.points(spark, sf_dir)))


@query("select 'ok' as status, count(*) as points from customer")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.health(A.points(spark, sf_dir))


@query(f"""with {_series_sql("supplier")} select source_file, pid, list(strftime(acq_date, '%Y-%m-%d') order by acq_date) as dates, list(round(disp, 2) order by acq_date) as values from ser where pid = '7' group by source_file, pid""")
def timeseries_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.timeseries(A.long_series(spark, sf_dir), "7")


@query(f"with {POINTS} select '{{\"pid\":\"' || pid || '\",\"orbit\":\"' || orbit || '\"}}' as record from op")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.sources.sinks import records

    return records(A.with_orbit(A.points(spark, sf_dir)).select("pid", "orbit"))


# --- ingest ---------------------------------------------------------------------------------------


@query(f"""with {POINTS} select count(*) filter (coalesce(temporal_coherence >= 0.4 and abs(mean_velocity) <= 6, false)) as n_points,
    count(*) filter (not coalesce(temporal_coherence >= 0.4 and abs(mean_velocity) <= 6, false)) as n_filtered from pts where latitude between 44.5 and 46 and longitude between 7 and 12""")
def box_and_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected(ingest.in_box(A.points(spark, sf_dir), (7, 44.5, 12, 46)), 0.4, 6)


@query("""select l_orderkey, l_linenumber, try_cast(case when regexp_full_match(trim(c), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then trim(c) end as double) as x,
    case when l_partkey % 4 = 0 then l_linenumber end as i from (select *, case l_partkey % 5 when 0 then 'n/a' when 1 then '' when 2 then ' ' || cast(l_linenumber as varchar) || '.5 ' when 3 then '1_000' else '-2e1' end as c from lineitem)""")
def type_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    text = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(".5 "))).when(k % 5 == 3, "1_000").otherwise("-2e1")
    whole = F.when(k % 4 == 0, F.col("l_linenumber").cast("string")).otherwise("x")
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.number(text, "double").alias("x"), scalars.number(whole, "int").alias("i"))


@query(f"""with {_series_sql("part")}, d as (select source_file, acq_date, date_diff('day', lag(acq_date) over (partition by source_file order by acq_date), acq_date) as gap from (select distinct source_file, acq_date from ser))
    select source_file, coalesce(max(gap), 0)::smallint as max_gap_days, count(*)::smallint as n_acquisitions from d group by source_file""")
def gap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.gap_metrics(A.long_series(spark, sf_dir, "part").select("source_file", "acq_date").distinct())


@query(f"select distinct o_orderdate::date as day, round({_YEAR.format('o_orderdate::date')}, 9) as year from orders")
def decimal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.round(scalars.decimal_year(F.col("day")), 9).alias("year"))


@query(f"""with {POINTS}, s as (select source_file, pid from pts where cast(pid as bigint) % 10 <> 3 union all select source_file, 'x' || pid from pts where cast(pid as bigint) % 100 = 1)
    select count(*) as n_points, count(orbit) as n_orbit, min(mean_velocity) as vel_min, max(mean_velocity) as vel_max, avg(mean_velocity) as vel_mean, min(temporal_coherence) as coh_min, max(temporal_coherence) as coh_max,
    (select count(*) from pts where pid not in (select pid from s)) as only_meta, (select count(*) from s where pid not in (select pid from pts)) as only_series, 0 as n_duplicates, false as same_keys from op""")
def verify_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.with_orbit(A.points(spark, sf_dir))
    k = F.col("pid").cast("long")
    s = p.where(k % 10 != 3).select("source_file", "pid").unionByName(p.where(k % 100 == 1).select("source_file", F.concat(F.lit("x"), "pid").alias("pid")))
    return ingest.verify_pair(p, s)


@query(f"""with {POINTS} select pid, latitude, longitude, temporal_coherence from (select *, row_number() over (partition by floor(latitude / 0.25::double), floor(longitude / 0.25::double) order by temporal_coherence desc nulls last, pid) as rn from pts) where rn = 1""")
def best_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.best_per_cell(A.points(spark, sf_dir), 0.25).select("pid", "latitude", "longitude", "temporal_coherence")


@query("""with s as (select s_suppkey, s_acctbal from supplier) select format('CL_{:04d}', s_suppkey) as cluster_id, format('CL_{:04d}', s_suppkey) || '_SUB_' || lpad(cast(s_suppkey % 7 as varchar), 3, '0') as subcluster_id,
    case s_suppkey % 3 when 0 then '#e74c3c' when 1 then '#ffffff' else '#cccccc' end as color from s""")
def id_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cid = scalars.cluster_id(k)
    name = F.when(k % 3 == 0, "accel").when(k % 3 == 1, "mixed").otherwise("nothing")
    return A.table(spark, sf_dir, "supplier").select(cid.alias("cluster_id"), scalars.subcluster_id(cid, k % 7).alias("subcluster_id"), scalars.class_color(name).alias("color"))


# --- series ---------------------------------------------------------------------------------------


def _features_sql(kind: str) -> str:
    slope = lambda f: f"regr_slope(y, t) filter (where {f})"
    return f"""with {_series_sql(kind)}, {_AXIS},
    m as (select source_file, pid, count(y) as n, max(n_dates) as n_dates, avg(y) as my, regr_slope(y, t) as b, regr_intercept(y, t) as a, {slope("pos < n_dates // 2")} as h1, {slope("pos >= n_dates // 2")} as h2,
        count(y) filter (where pos < n_dates // 2) as n1, count(y) filter (where pos >= n_dates // 2) as n2, max(y) - min(y) as span, avg(t) filter (where y is not null) as mt, avg(t * t) filter (where y is not null) as mtt,
        regr_slope(t * t, t) filter (where y is not null) as p, regr_intercept(t * t, t) filter (where y is not null) as p0 from onax group by source_file, pid),
    r as (select o.*, y - a - b * t as r, t * t - p0 - p * t as w, n, my from onax o join m using (source_file, pid) where y is not null),
    q as (select source_file, pid, case when sum(w * w) > 1e-12 then sum(w * r) / sum(w * w) end as q, sum(r * r) as ssr, sum((y - my) * (y - my)) as sst, sum(w * w) as sww, sum(w * r) as swr from r group by source_file, pid),
    z as (select r.*, lag(r) over k as r0, abs(y - lag(y) over k) as dy, sum(r / nullif(sqrt(ssr / n), 0)) over (k rows unbounded preceding) as walk, ssr from r join q using (source_file, pid) window k as (partition by source_file, pid order by pos)),
    e as (select source_file, pid, sum(r * r0) / nullif(max(ssr), 0) as acf, (max(walk) - min(walk)) / sqrt(count(*)) as cusum, percentile_cont(0.9) within group (order by dy) as p90 from z group by source_file, pid)
    select source_file, pid, n as n_valid, round(case when n >= 10 then b end, 6) as v_robust, round(case when n >= 10 and n1 >= 5 and n2 >= 5 then h1 end, 6) as v_first_half, round(case when n >= 10 and n1 >= 5 and n2 >= 5 then h2 end, 6) as v_second_half,
    round(case when n >= 10 and n1 >= 5 and n2 >= 5 then h2 - h1 end, 6) as v_diff, round(case when n >= 10 then sqrt(ssr / n) end, 6) as rmse_detrended, round(case when n >= 10 then q end, 6) as quad_coeff,
    round(case when n >= 10 then swr * swr / sww / sst end, 6) as quad_r2, round(n::double / n_dates, 6) as n_valid_frac, round(case when n >= 10 then acf end, 6) as acf_lag1, round(case when n >= 10 then cusum end, 6) as cusum_score,
    round(case when n >= 10 then 1 - ssr / sst end, 6) as velocity_r2, round(case when n >= 10 then span end, 10) as range_mm, round(case when n >= 10 then p90 end, 10) as noise_p90 from m left join q using (source_file, pid) left join e using (source_file, pid)"""


@query(_features_sql("supplier"))
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sql_features(series.on_axis(A.long_series(spark, sf_dir)), digits=6)


@query(_features_sql("part").replace(", 6) as ", ", 5) as "))
def series_features_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sql_features(series.on_axis(A.long_series(spark, sf_dir, "part")), digits=5)


@query()
def kernel_features_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_features(series.to_arrays(A.long_series(spark, sf_dir, "user")))


@query(_features_sql("supplier"))
def kernel_features_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's values for the features that SQL has."""
    out = kernel_features(series.to_arrays(A.long_series(spark, sf_dir)))
    names = [c for c in series.sql_features(series.on_axis(A.long_series(spark, sf_dir))).columns if c not in ("source_file", "pid", "n_valid")]
    return out.select("source_file", "pid", "n_valid", *[F.round(n, 10 if n in ("range_mm", "noise_p90") else 6).alias(n) for n in names])


@query(f"with {_series_sql('user')} select source_file, pid, acq_date, round(disp, 6) as disp from ser")
def long_to_wide_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = A.long_series(spark, sf_dir, "user")
    dates = [r[0].strftime("%Y%m%d") for r in long.select("acq_date").distinct().orderBy("acq_date").collect()]  # the axis
    return series.to_long(series.to_wide(long, dates)).select("source_file", "pid", "acq_date", F.round("disp", 6).alias("disp"))


@query("select cast(date_trunc('day', ts) as date) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.streaming.incremental import windowed

    out = windowed(A.table(spark, sf_dir, "events"), by=("event_type",))
    return out.select(F.to_date("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


# --- classes --------------------------------------------------------------------------------------

_RULES = """f as (select 'lineitem' as source_file, cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as pid, l_orderkey * 7 + l_linenumber as k, l_partkey as n from lineitem),
    g as (select source_file, pid, case when k % 41 = 0 then null else (k * 7919 % 2001 - 1000)::double / 100 end as v, case when k % 17 = 0 then null else (k * 104729 % 1001 - 500)::double / 100 end as vd, (n * 31 % 600)::double / 100 as rd,
    (n * 37 % 800)::double / 100 as rs, case when k % 13 = 0 then null else (n * 41 % 400)::double / 1000 end as sr, (k * 613 % 801 - 400)::double / 100 as qc, (k * 211 % 200)::double / 1000 as qr, (n % 3)::double as nj,
    (n * 43 % 1200)::double / 100 as jm, (n * 47 % 500)::double / 100 as cu, (k * 307 % 1000)::double / 1000 as lr from f),
    h as (select *, case when abs(v) < 2.5::double and rd <= 3.0::double then 'stable' when abs(v) < 2.5::double and rd > 3.0::double then 'noisy' when abs(v) < 2.5::double and cu > 2.5::double and lr < 0.5::double then 'variable'
    when abs(v) >= 2.5::double and lr < 0.85::double and qr > 0.05::double and ((v < 0 and vd < -1.5::double and qc < 0) or (v > 0 and vd > 1.5::double and qc > 0)) then 'accel'
    when abs(v) >= 2.5::double and lr < 0.85::double and qr > 0.05::double and ((v < 0 and vd > 1.5::double and qc > 0) or (v > 0 and vd < -1.5::double and qc < 0)) then 'decel'
    when v is not null and lr >= 0.65::double then 'linear' end as rule, coalesce(sr > 0.15::double, false) as periodic, coalesce(nj >= 1 and jm > 5.0::double, false) as jumpy, coalesce(cu > 2.5::double and v is not null, false) as variable_flag,
    coalesce(abs(v) >= 2.5::double and rs > 4.0::double, false) as noisy_trend from g)"""


@query(f"with {_RULES} select pid, rule, periodic, jumpy, variable_flag, noisy_trend from h")
def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.rule_inputs(spark, sf_dir)
    return rows.select("pid", C.rule_class().alias("rule"), *[e.alias(k) for k, e in C.flags().items()])


@query(f"with {_RULES} select coalesce(rule, 'other') as class_1, count(*) as n, 100.0::double * count(*) / (select count(*) from h) as pct from h group by 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_distribution(A.rule_inputs(spark, sf_dir).select(F.coalesce(C.rule_class(), F.lit("other")).alias("class_1")))


@query(f"""with {_RULES} select unnest(['periodic', 'jumpy', 'variable_flag', 'noisy_trend']) as flag, unnest([count(*) filter (periodic), count(*) filter (jumpy), count(*) filter (variable_flag), count(*) filter (noisy_trend)]) as n,
    unnest([100.0::double * count(*) filter (periodic) / count(*), 100.0::double * count(*) filter (jumpy) / count(*), 100.0::double * count(*) filter (variable_flag) / count(*), 100.0::double * count(*) filter (noisy_trend) / count(*)]) as pct from h""")
def flag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flag_distribution(A.rule_inputs(spark, sf_dir).select(*[e.alias(k) for k, e in C.flags().items()]))


@query(f"""with {POINTS} select count(*) as n, count(*) filter (temporal_coherence >= 0.5::double and abs(mean_velocity) >= 1) as n_eligible, min(temporal_coherence) as coh_min, max(temporal_coherence) as coh_max,
    percentile_cont(0.25) within group (order by temporal_coherence) as coh_p25, percentile_cont(0.5) within group (order by temporal_coherence) as coh_p50, percentile_cont(0.75) within group (order by temporal_coherence) as coh_p75,
    min(abs(mean_velocity)) as vel_min, max(abs(mean_velocity)) as vel_max, percentile_cont(0.25) within group (order by abs(mean_velocity)) as vel_p25, percentile_cont(0.5) within group (order by abs(mean_velocity)) as vel_p50,
    percentile_cont(0.75) within group (order by abs(mean_velocity)) as vel_p75, 100.0::double * count(*) filter (temporal_coherence >= 0.5::double and abs(mean_velocity) >= 1) / count(*) as pct_eligible,
    0.5::double > 0.85::double * max(temporal_coherence) as coherence_high, 100.0::double * count(*) filter (temporal_coherence >= 0.5::double and abs(mean_velocity) >= 1) / count(*) < 1 as few_eligible from pts""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.eligibility(A.points(spark, sf_dir), 0.5, 1.0)


_WIDTH = 64
_VEC = "v as (select cast(vec_id as varchar) as pid, cast(label as varchar) as rule, " + ", ".join(f"embedding[{i + 1}]::double as f{i}" for i in range(_WIDTH)) + " from embeddings)"
_DIST = " + ".join(f"(v.f{i} - c.f{i}) * (v.f{i} - c.f{i})" for i in range(_WIDTH))


@query(f"""with {_VEC}, c as (select rule, {", ".join(f"avg(f{i}) as f{i}" for i in range(_WIDTH))} from v group by rule having count(*) >= 2),
    d as (select pid, c.rule as name, row_number() over (partition by pid order by {_DIST}, c.rule) as rn from v join c on c.rule <> v.rule) select pid, name as class_2 from d where rn = 1""")
def second_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.second_class(A.vectors(spark, sf_dir), "rule", [f"f{i}" for i in range(_WIDTH)]).select("pid", "class_2")


@query(f"""with {_VEC}, q as (select {", ".join(f"percentile_cont(0.5) within group (order by f{i}) as m{i}, percentile_cont(0.75) within group (order by f{i}) - percentile_cont(0.25) within group (order by f{i}) as s{i}" for i in range(_WIDTH))} from v)
    select pid, {", ".join(f"round((f{i} - m{i}) / case when s{i} = 0 then 1 else s{i} end, 6) as f{i}" for i in range(_WIDTH))} from v cross join q""")
def robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"f{i}" for i in range(_WIDTH)]
    return C.robust_scale(A.vectors(spark, sf_dir), names).select("pid", *[F.round(n, 6).alias(n) for n in names])


@query()
def mixture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"f{i}" for i in range(_WIDTH)]
    return mixture.classify_residual(C.robust_scale(A.vectors(spark, sf_dir), names), names)


@query()
def full_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of suppliers through features, rules, the mixture and the fill of points that were not eligible."""
    long = A.long_series(spark, sf_dir)
    f = kernel_features(series.to_arrays(long))
    names = list(schema.FEATURES)
    scaled = C.robust_scale(f, names)
    rest = f.where(C.rule_class().isNull()).select("source_file", "pid")
    residual = mixture.classify_residual(scaled.join(rest, ["source_file", "pid"], "left_semi"), names)
    everyone = long.select("source_file", "pid").distinct().unionByName(spark.createDataFrame([("supplier", "none")], "source_file string, pid string"))
    return C.classify(f, everyone, residual)


@query(f"""with {POINTS}, l as (select pid, 'accel' as a from pts where cast(pid as bigint) % 3 = 0) select p.pid, coalesce(l.a, 'unclassified') as class_1, case when l.a is null then 'unclassified' else 'linear' end as class_2,
    case when l.a is null then 0 else 1 end::float as class_prob_1, l.a is not null as periodic, false as jumpy, false as variable_flag, false as noisy_trend from pts p left join l on l.pid = p.pid""")
def label_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.points(spark, sf_dir)
    some = p.where(F.col("pid").cast("long") % 3 == 0).select("source_file", "pid", F.lit("accel").alias("class_1"), F.lit("linear").alias("class_2"), F.lit(1.0).cast("float").alias("class_prob_1"), F.lit(True).alias("periodic"), *[F.lit(False).alias(c) for c in ("jumpy", "variable_flag", "noisy_trend")])
    return C.with_labels(p, some.unionByName(some)).select("pid", "class_1", "class_2", "class_prob_1", "periodic", "jumpy", "variable_flag", "noisy_trend")


# --- clusters -------------------------------------------------------------------------------------


def _dbscan_sql(source: str, eps: float = 100.0, eps_vel: float = 3.0, least: int = 5, group: str = "", prefix: str = "") -> str:
    """Neighbours, cores, components by the recursive closure, numbers by first core, borders to the least number. prefix: of the
    tables' names."""
    same = "".join(f" and a.{c} = b.{c}" for c in group.split(", ") if c)
    part = f"partition by {group}" if group else ""
    g = f", {group}" if group else ""
    text = f"""p as (select *, v * {eps / eps_vel!r}::double as z, cast(floor(e / {eps}) as bigint) as cx, cast(floor(n / {eps}) as bigint) as cy from (@source)),
    nb as materialized (select a.idx as i, b.idx as j from (select *, cx + unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) as qx, cy + unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) as qy from p) a join p b on b.cx = a.qx and b.cy = a.qy {same}
        where (a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) + (a.z - b.z) * (a.z - b.z) <= {eps * eps}::double),
    core as materialized (select i from nb group by i having count(*) >= {least}),
    cc as materialized (select i, j from nb where i in (select i from core) and j in (select i from core)),
    reach as (select i, i as j from core union select r.i, cc.j from reach r join cc on cc.i = r.j),
    head as (select i, min(j) as h from reach group by i),
    num as (select head.i as idx, dense_rank() over ({part} order by h) - 1 as label{g} from head join p on p.idx = head.i),
    bord as (select nb.i as idx, min(num.label) as label from nb join num on num.idx = nb.j where nb.i not in (select i from core) group by nb.i),
    lab as (select p.*, coalesce(num.label, bord.label, -1) as label from p left join num on num.idx = p.idx left join bord on bord.idx = p.idx)"""
    for name in ("p", "nb", "core", "cc", "reach", "head", "num", "bord", "lab") if prefix else ():
        text = re.sub(rf"\b{name}\b(?= as (materialized )?\(|\.)", prefix + name, text)
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {prefix}{name}", text)
    return text.replace("@source", source)


_CUST = "select c_custkey as idx, (c_custkey * 7919 % 2000)::double as e, (c_custkey * 104729 % 2000)::double as n, (c_acctbal - 4500) / 500 as v, (c_custkey * 31 % 1000)::double / 1000 as coherence, c_mktsegment as class_1 from customer"
_SUB = "select idx, 'CL_' || lpad(cast(label as varchar), 4, '0') as cluster_id, class_1, e, n, v from lab where label >= 0 and class_1 in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')"
_ORD = "select o_orderkey as idx, (o_custkey * 7919 % 5000)::double as e, (o_custkey * 104729 % 5000 + o_orderkey % 97)::double as n, (o_totalprice - 250000) / 20000 as v from orders"


@query(f"with recursive {_dbscan_sql(_CUST)} select idx, label from lab")
def dbscan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(A.cluster_points(spark, sf_dir), 100, 3, 5)


@query(f"with recursive {_dbscan_sql(_ORD)} select idx, label from lab")
def dbscan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(A.cluster_points(spark, sf_dir, "orders"), 100, 3, 5)


@query(f"with recursive {_dbscan_sql(_CUST, 150.0, 4.0, 3, 'class_1')} select idx, class_1, label from lab")
def dbscan_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(A.cluster_points(spark, sf_dir), 150, 4, 3, ("class_1",), 0.01)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.cluster_points(spark, sf_dir)
    return p.join(dbscan(p, 100, 3, 5), "idx")


_SUMMARY = """m as (select * from lab where label >= 0), s as (select label, count(*) as n_points, round(avg(v), 8) as vel_mean, round(stddev_pop(v), 8) as vel_std, round(min(v), 8) as vel_min, round(max(v), 8) as vel_max, round(avg(coherence), 9) as coh_mean from m group by label),
    k as (select label, class_1, count(*) as c, row_number() over (partition by label order by count(*) desc, class_1) as r, sum(count(*)) over (partition by label) as t from m group by label, class_1),
    sm as (select 'CL_' || lpad(cast(s.label as varchar), 4, '0') as cluster_id, n_points, class_1 as dom_class, round(c::double / t, 3) as class_purity, round(c::double / t, 3) < 0.5::double as is_mixed, vel_mean, vel_std, vel_min, vel_max, coh_mean,
    case when round(c::double / t, 3) < 0.5::double then '#ffffff' else '#cccccc' end as color, s.label from s join k on k.label = s.label and k.r = 1)"""


@query(f"with recursive {_dbscan_sql(_CUST)}, {_SUMMARY} select * from sm")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more digits than shown, where means don't lie on the edge of rounding."""
    return clusters.summarise(_members(spark, sf_dir), digits=8)


@query(f"with recursive {_dbscan_sql(_CUST)}, {_SUMMARY} select dom_class, count(*) as n_clusters, sum(n_points)::bigint as total_pts from sm group by dom_class")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.rollup(clusters.summarise(_members(spark, sf_dir)), None)


@query(f"""with recursive {_dbscan_sql(_CUST)} select count(distinct label) filter (label >= 0) as n_clusters, count(*) filter (label >= 0) as n_clustered, count(*) filter (label < 0) as n_noise,
    count(*) filter (label >= 0)::double / greatest(count(distinct label) filter (label >= 0), 1) as avg_size from lab""")
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.totals(_members(spark, sf_dir).withColumn("cluster_id", scalars.cluster_id(F.col("label"))))


@query(f"with recursive {_dbscan_sql(_CUST)} select cast(idx as varchar) as pid, case when label < 0 then 'NOISE' else 'CL_' || lpad(cast(label as varchar), 4, '0') end as cluster_id from lab")
def cluster_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _members(spark, sf_dir).select(F.lit("customer").alias("source_file"), F.col("idx").cast("string").alias("pid"), scalars.cluster_id(F.col("label")).alias("cluster_id"))
    return clusters.with_cluster_ids(A.points(spark, sf_dir), found).select("pid", "cluster_id")


@query()
def cluster_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.polygons(_members(spark, sf_dir), ["label"])


@query()
def cluster_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.functions.geometry import to_degrees

    from terradrift.tables import Stage

    m = Stage(spark, "geojson").keep(_members(spark, sf_dir), "members")
    shapes = clusters.polygons(m.withColumns({"e": F.col("e") + 4321000, "n": F.col("n") + 3210000}), ["label"])
    out = clusters.summarise(m).join(shapes, "label")
    return views.geojson(out.withColumn("geometry", to_degrees("geometry")))


@query(f"""with recursive {_dbscan_sql(_CUST)}, {_dbscan_sql(_SUB, 50.0, 2.0, 3, "cluster_id, class_1", "s_")}
    select idx, cluster_id, class_1, label, cluster_id || case when label < 0 then '_SUB_NOISE' else '_SUB_' || lpad(cast(label as varchar), 3, '0') end as subcluster_id from s_lab""")
def subclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir).withColumn("cluster_id", scalars.cluster_id(F.col("label"))).drop("label")
    return clusters.subclusters(m, ("BUILDING", "MACHINERY", "AUTOMOBILE"))


@query("select cast(c_custkey as varchar) as pid, case when c_custkey % 5 = 0 then 'S' || cast(c_custkey % 9 as varchar) end as subcluster_id from customer")
def subcluster_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.points(spark, sf_dir)
    some = p.where(F.col("pid").cast("long") % 5 == 0).select("source_file", "pid", F.concat(F.lit("S"), F.col("pid").cast("long") % 9).alias("subcluster_id"))
    return clusters.with_subcluster_ids(p, some.unionByName(some)).select("pid", "subcluster_id")


# --- files ----------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier series as a raw delivery: all text, one column a date."""
    long = A.long_series(spark, sf_dir)
    dates = [r[0].strftime("%Y%m%d") for r in long.select("acq_date").distinct().orderBy("acq_date").collect()]  # the axis
    wide = series.to_wide(long, dates)
    k = F.col("pid").cast("long")
    meta = wide.select("pid", (44 + k / 1000).alias("latitude"), (7 + k / 500).alias("longitude"), (k * 37 % 360).alias("track_angle"), (k % 10 / 10).alias("temporal_coherence"), (k % 21 - 10).alias("mean_velocity"), *[F.col(d).alias(f"D{d}") for d in dates])
    return meta.select(*[F.col(c).cast("string").alias(c) for c in meta.columns])


@query(f"""with {_series_sql("supplier")}, n as (select max(date_diff('day', p, d))::smallint as g, count(*)::smallint as c from (select acq_date as d, lag(acq_date) over (order by acq_date) as p from (select distinct acq_date from ser)))
    select s_suppkey::varchar as pid, 44 + s_suppkey::double / 1000 as latitude, 7 + s_suppkey::double / 500 as longitude, case when s_suppkey * 37 % 360 > 90 and s_suppkey * 37 % 360 < 270 then 'D' else 'A' end as orbit, g as max_gap_days, c as n_acquisitions
    from supplier cross join n where s_suppkey % 10 >= 3 and abs(s_suppkey % 21 - 10) <= 8""")
def csv_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read back as text, and converted under quality limits."""
    from terradrift.sources.readers import read_deliveries
    from terradrift.tables import Stage

    stage = Stage(spark, "delivery")
    _raw(spark, sf_dir).coalesce(1).write.option("header", True).csv(f"{stage.root}/raw")
    raw, _ = read_deliveries(spark, f"{stage.root}/raw")
    found, _ = ingest.convert(raw, 0.3, 8)
    return found.select("pid", "latitude", "longitude", "orbit", "max_gap_days", "n_acquisitions")


@query("select cast(c_custkey as varchar) as pid, c_acctbal as x, case when c_custkey % 2 = 0 then c_name end as extra from customer")
def parquet_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with differing columns and types, read as one table."""
    from terradrift.sources.readers import read_parquet_by_name
    from terradrift.tables import Stage

    stage, c = Stage(spark, "union"), A.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    c.where(k % 2 == 0).select(k.cast("string").alias("pid"), F.col("c_acctbal").alias("x"), F.col("c_name").alias("extra")).write.parquet(f"{stage.root}/a")
    c.where(k % 2 == 1).select(k.cast("string").alias("pid"), F.col("c_acctbal").alias("x")).write.parquet(f"{stage.root}/b")
    return read_parquet_by_name(spark, stage.root).drop("source_file")


@query("""with r as (select case s_suppkey % 5 when 0 then 'skipped' when 1 then 'error' else 'ok' end as status, s_nationkey * 1000 as n_points, s_suppkey * 4000 as in_bytes, case when s_suppkey % 5 > 1 then s_suppkey * 1000 end as out_bytes from supplier)
    select count(*) filter (status = 'ok') as n_processed, count(*) filter (status = 'skipped') as n_skipped, count(*) filter (status = 'error') as n_errors, coalesce(sum(n_points) filter (status = 'ok'), 0)::bigint as total_points,
    sum(in_bytes)::double / 1e6 as in_mb, sum(out_bytes)::double / 1e6 as out_mb, 100.0::double * (1 - sum(out_bytes)::double / 1e6 / (sum(in_bytes)::double / 1e6)) as saving_pct from r""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a conversion's report, with suppliers as files."""
    from terradrift.jobs import batch_totals as totals

    k = F.col("s_suppkey")
    status = F.when(k % 5 == 0, "skipped").when(k % 5 == 1, "error").otherwise("ok")
    report = A.table(spark, sf_dir, "supplier").select(status.alias("status"), (F.col("s_nationkey") * 1000).cast("long").alias("n_points"), (k * 4000).alias("in_bytes"), F.when(k % 5 > 1, k * 1000).alias("out_bytes"))
    return totals(report)


_PROBS = ", ".join(f"abs(embedding[{i + 1}]::double)" for i in range(len(schema.CLASSES)))


@query(f"""with l as (select vec_id, unnest([{_PROBS}]) as p, unnest([{", ".join(f"'{c}'" for c in schema.CLASSES)}]) as name, unnest(range({len(schema.CLASSES)})) as i from embeddings),
    r as (select *, row_number() over (partition by vec_id order by p desc, i) as rn, sum(p) over (partition by vec_id) as t from l)
    select cast(vec_id as varchar) as pid, max(name) filter (rn = 1) as class_1, max(name) filter (rn = 2) as class_2, round(max(p / t) filter (rn = 1), 9) as class_prob_1 from r group by vec_id""")
def top_two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two likeliest classes of each row of class weights."""
    weights = F.array(*[F.abs(F.col("embedding")[i].cast("double")) for i in range(len(schema.CLASSES))])
    rows = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), C.top_two(weights).alias("t"))
    return rows.select("pid", "t.class_1", "t.class_2", F.round("t.class_prob_1", 9).alias("class_prob_1"))
