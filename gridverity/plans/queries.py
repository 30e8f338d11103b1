"""Registered queries: each applies operators to the demonstration views, with the same question in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import tidy
from ..functions.tests_of_rank import holm, signed_rank_statistics
from ..operators import align, categorical, compare, deterministic, ensemble, spectra, subseasonal, summary, tropical
from ..session import scratch
from ..sources import gridded
from .views import ARCHIVE, CELLS, DAILY, FC, FCC, HOURS, REGIONS, SPECTRA, TRACK, oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Register a function as the query of its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql, **views)
        return f

    return add


def r(*names: str) -> list:
    """Columns, rounded under their names."""
    return [tidy(n).alias(n) for n in names]


def rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


W = "cos(radians(lat))"


# --- deterministic ------------------------------------------------------------


@query(f"select model, lead_h, variable, count(*) as n, round(sqrt(sum({W}*(fcst-obs)*(fcst-obs))/sum({W})),6)+0.0 as rmse, round(sum({W}*(fcst-obs))/sum({W}),6)+0.0 as bias from fc group by 1,2,3", fc=FC)
def rmse_by_lead(spark, d):
    return deterministic.error_scores(view(spark, d, FC), ["model", "lead_h", "variable"]).select("model", "lead_h", "variable", "n", *r("rmse", "bias"))


_SUMS = f"select model, lead_h, variable, sum({W}) as w, sum({W}*fa) as f, sum({W}*oa) as o, sum({W}*fa*fa) as ff, sum({W}*oa*oa) as oo, sum({W}*fa*oa) as fo from (select *, fcst-clim as fa, obs-clim as oa from fcc) group by 1,2,3"


@query("""select model, lead_h, variable, round(fo/nullif(sqrt(ff*oo),0),6)+0.0 as acc, round((fo-f*o/w)/nullif(sqrt((ff-f*f/w)*(oo-o*o/w)),0),6)+0.0 as acc_centred,
 round(sqrt(greatest(ff/w-(f/w)*(f/w),0)),6)+0.0 as fa_pred, round(sqrt(greatest(oo/w-(o/w)*(o/w),0)),6)+0.0 as fa_obs,
 round(sqrt(greatest(ff/w-(f/w)*(f/w),0))-sqrt(greatest(oo/w-(o/w)*(o/w),0)),6)+0.0 as fa_bias,
 round(sqrt(greatest(ff/w-(f/w)*(f/w),0))/nullif(sqrt(greatest(oo/w-(o/w)*(o/w),0)),0),6)+0.0 as fa_ratio from sums""", fcc=FCC, sums=_SUMS)
def anomaly_scores(spark, d):
    out = deterministic.anomaly_scores(view(spark, d, FCC), ["model", "lead_h", "variable"])
    return out.select("model", "lead_h", "variable", *r("acc", "acc_centred", "fa_pred", "fa_obs", "fa_bias", "fa_ratio"))


@query(f"select name, model, count(*) as n, round(sqrt(sum({W}*(fcst-obs)*(fcst-obs))/sum({W})),6)+0.0 as rmse, round(sum({W}*(fcst-obs))/sum({W}),6)+0.0 as bias from fc join regions on lat between lat0 and lat1 and case when lon0<=lon1 then lon between lon0 and lon1 else lon>=lon0 or lon<=lon1 end group by 1,2", fc=FC, regions=REGIONS)
def region_scores(spark, d):
    regions = spark.sql(REGIONS).select("name", *[F.col(x).cast("double").alias(x) for x in ("lat0", "lat1", "lon0", "lon1")])
    return deterministic.region_scores(view(spark, d, FC), regions, ["model"]).select("name", "model", "n", *r("rmse", "bias"))


@query(f"select variable, count(*) as n, round(sqrt(sum({W}*(fcst-obs)*(fcst-obs))/sum({W})),6)+0.0 as rmse from fc where lat between 15 and 55 and lon between 70 and 140 group by 1", fc=FC)
def box_scores(spark, d):
    inside = view(spark, d, FC).where(c.in_box("lat", "lon", 15, 55, 70, 140))
    return deterministic.error_scores(inside, ["variable"]).select("variable", "n", *r("rmse"))


@query("""select model, count(*) as n, round(avg(fcst),6)+0.0 as fcst, round(avg(obs),6)+0.0 as obs from
 (select u.model, sqrt(u.fcst*u.fcst+v.fcst*v.fcst) as fcst, sqrt(u.obs*u.obs+v.obs*v.obs) as obs from cells u join cells v using (model, lat_i, lon_i) where u.variable='A' and v.variable='R') group by 1""", cells=CELLS)
def wind_speed(spark, d):
    keys = ["model", "lat_i", "lon_i"]
    w = deterministic.wind_speed(view(spark, d, CELLS), "A", "R", "ws", keys, ["fcst", "obs"]).where("fcst is not null")
    return w.groupBy("model").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("fcst")).alias("fcst"), tidy(F.avg("obs")).alias("obs"))


_SERIES = f"select model, init, variable, lead_h, sum(fcst) as x from ({FC}) f group by 1,2,3,4"


@query("select variable, lead_h, count(*) as n, round(sum(y),6)+0.0 as total from (select *, x - lag(x) over w as y, row_number() over w as k from s window w as (partition by model, init, variable order by lead_h)) where k > 1 group by 1,2", s=_SERIES)
def deaccumulated(spark, d):
    x = deterministic.deaccumulate(view(spark, d, _SERIES), ["model", "init", "variable"], "x")
    return x.groupBy("variable", "lead_h").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("x")).alias("total"))


@query("select lead_h, count(*) as n, round(sum(y),6)+0.0 as total from (select *, sum(x) over w as y, count(x) over w as k, min(lead_h) over w as lo from s window w as (partition by model, init, variable order by lead_h rows 1 preceding)) where k=2 and lead_h-lo=6 and lead_h % 12 = 0 group by 1", s=_SERIES)
def window_sums(spark, d):
    x = deterministic.accumulate(view(spark, d, _SERIES), ["model", "init", "variable"], "x", 2, 6.0)
    return x.groupBy("lead_h").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("x")).alias("total"))


@query("select variable, round(avg(case variable when 'A' then fcst*1000 when 'R' then fcst*0.5 else fcst end),6)+0.0 as scaled from fc group by 1", fc=FC)
def unit_scaling(spark, d):
    x = view(spark, d, FC).withColumn("scaled", c.scaled("variable", "fcst", {"A": 1000.0, "R": 0.5}))
    return x.groupBy("variable").agg(tidy(F.avg("scaled")).alias("scaled"))


_DOY = "(dayofyear(init) - case when (year(init)%4=0 and year(init)%100<>0 or year(init)%400=0) and dayofyear(init)>=60 then 1 else 0 end)"


@query(f"""select f.variable, count(*) as n, round(avg((1-s)*a.value + s*b.value),6)+0.0 as clim from
 (select variable, cast(floor(p) as int) % 365 as s0, (cast(floor(p) as int)+1) % 365 as s1, p-floor(p) as s from (select variable, {_DOY}-1 + 0.25 as p from fc)) f
 join slots a on a.variable=f.variable and a.slot=f.s0 join slots b on b.variable=f.variable and b.slot=f.s1 group by 1""",
 fc=FC, slots=f"select variable, cast({_DOY}-1 as int) as slot, avg(obs) as value from fc group by 1,2")
def climatology_interpolated(spark, d):
    fc = view(spark, d, FC)
    slots = fc.groupBy("variable", F.floor(c.year_slot("init", 365)).cast("int").alias("slot")).agg(F.avg("obs").alias("value"))
    out = align.climatology_at(fc.withColumn("valid_time", c.valid_time("init", F.lit(6.0))), slots, 365, 1, keys=["variable"])
    return out.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("clim")).alias("clim"))


_SLOTS = f"select variable, cast(month(init) as int) - 1 as slot, avg(obs) as value from ({FC}) f group by 1,2"


@query("select variable, slot, round(value,6)+0.0 as value from (select variable, slot, lap, avg(value) over (partition by variable order by slot+lap rows between 1 preceding and 1 following) as value from slots, (select unnest([-12,0,12]) as lap)) where lap=0", slots=_SLOTS)
def climatology_smoothed(spark, d):
    return align.smooth_climatology(view(spark, d, _SLOTS), 12, 3, 1, ["variable"]).select("variable", "slot", *r("value"))


@query("select f.variable, count(*) as n, round(avg(fcst - truth),6)+0.0 as diff from (select *, cast(init as timestamp) + interval 1 day as valid_time from fc) f join t on t.variable=f.variable and t.lat_i=f.lat_i and t.valid_time=f.valid_time group by 1",
 fc=FC, t=f"select variable, lat_i, cast(init as timestamp) as valid_time, avg(obs) as truth from ({FC}) f group by 1,2,3")
def valid_time_join(spark, d):
    fc = view(spark, d, FC)
    truth = fc.groupBy("variable", "lat_i", F.col("init").cast("timestamp").alias("valid_time")).agg(F.avg("obs").alias("truth"))
    x = align.at_valid_time(fc.withColumn("lead_h", F.lit(24.0)), truth, ["variable", "lat_i"])
    return x.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(F.col("fcst") - F.col("truth"))).alias("diff"))


@query("select f.variable, count(*) as n from (select distinct variable, lat_i, init + interval 1 day as v from fc) f where not exists (select 1 from fc g where g.variable=f.variable and g.lat_i=f.lat_i and g.init=f.v) group by 1", fc=FC)
def missing_truth(spark, d):
    fc = view(spark, d, FC)
    truth = fc.select("variable", "lat_i", F.col("init").cast("timestamp").alias("valid_time")).distinct()
    return align.missing_truth(fc.withColumn("lead_h", F.lit(24.0)), truth, ["variable", "lat_i"]).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("select p.lead_h, count(*) as n, round(avg(p.x - o.x),6)+0.0 as diff from s p join s o on o.model=p.model and o.init=p.init and o.variable=p.variable and o.lead_h = p.lead_h + 6 group by 1", s=_SERIES)
def shifted_pairs(spark, d):
    x = view(spark, d, _SERIES).withColumn("lead_index", (F.col("lead_h") / 6 - 1).cast("int"))
    keys = ["model", "init", "variable"]
    out = align.shifted_pair(x.select(*keys, "lead_index", F.col("x").alias("p")), x.select(*keys, "lead_index", F.col("x").alias("o")), keys, 1, 6.0)
    return out.groupBy("lead_h").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(F.col("p") - F.col("o"))).alias("diff"))


_GRID = f"select variable, lat_i, lon_i % 40 as lon_i, avg(fcst) as value from ({FC}) f group by 1,2,3"
_POINTS = "select s_suppkey as station_id, -95 + cast(s_suppkey * 37 % 190 as double) + 0.3 as lat, cast(s_suppkey * 53 % 360 as double) + 0.7 as lon from {supplier}"


@query("""select variable, count(value) as n, round(avg(value),6)+0.0 as value from
 (select p.station_id, g.variable, case when count(g.value)=4 then sum(g.value*wt) end as value from
  (select station_id, i+a as lat_i, (cast(j as int)+b) % 40 as lon_i, (case a when 1 then y-i else 1-(y-i) end)*(case b when 1 then x-j else 1-(x-j) end) as wt from
   (select station_id, y, x, cast(least(floor(y),119) as int) as i, floor(x) as j from (select station_id, greatest(0,least(120,(lat+90)/1.5)) as y, lon/9.0 as x from pts)), (select unnest([0,1]) as a), (select unnest([0,1]) as b)) p
  join g on g.lat_i=p.lat_i and g.lon_i=p.lon_i group by 1,2) group by 1""", g=_GRID, pts=_POINTS)
def station_bilinear(spark, d):
    # rows of the grid are 1.5 degrees apart, its columns 9
    y = F.greatest(F.lit(0.0), F.least(F.lit(120.0), (F.col("lat") + 90) / 1.5))
    scaled = view(spark, d, _POINTS).withColumn("lat", -90 + 9.0 * y)
    w = align.corner_weights(scaled, 121, 40, -90.0, 9.0)
    out = align.to_stations(view(spark, d, _GRID), w, ["variable"], "value")
    return out.groupBy("variable").agg(F.count("value").alias("n"), tidy(F.avg("value")).alias("value"))


@query("""select to_lat, to_lon, round(sum(z*wx),6)+0.0 as value from
 (select y.to_lat, lon_i, sum(value*wy) as z from g join (select k as to_lat, i+a as lat_i, case a when 1 then p-i else 1-(p-i) end as wy from (select k, p, cast(least(greatest(floor(p),0),119) as int) as i from (select k, k*2.5 as p from (select unnest(range(49)) as k))), (select unnest([0,1]) as a)) y using (lat_i) where variable='A' group by 1,2)
 join (select k as to_lon, i+a as lon_i, case a when 1 then p-i else 1-(p-i) end as wx from (select k, p, cast(least(greatest(floor(p),0),38) as int) as i from (select k, k*2.5 as p from (select unnest(range(16)) as k))), (select unnest([0,1]) as a)) x using (lon_i) group by 1,2""", g=_GRID)
def regridded(spark, d):
    lat = align.axis_weights(spark.range(49).select(F.col("id").alias("to_lat"), (F.col("id") * 3.75 - 90).alias("p")), "to_lat", "p", 121, -90.0, 1.5)
    lon = align.axis_weights(spark.range(16).select(F.col("id").alias("to_lon"), (F.col("id") * 22.5).alias("p")), "to_lon", "p", 40, 0.0, 9.0)
    out = align.regrid(view(spark, d, _GRID).where("variable = 'A'"), lat, lon, [], "value")
    return out.select("to_lat", "to_lon", *r("value"))


# --- categorical --------------------------------------------------------------

_T24 = categorical.THRESHOLDS["categorical"][24]
_TSQL = "(select unnest([0.1,10.0,25.0,50.0,100.0])::double as threshold)"
_COUNTS = f"select model, lead_h, threshold, count(*) filter (fcst>=threshold and obs>=threshold) as hits, count(*) filter (fcst<threshold and obs>=threshold) as misses, count(*) filter (fcst>=threshold and obs<threshold) as false_alarms, count(*) as n_pairs from fc, {_TSQL} group by 1,2,3"
_SCORES = "round(hits/nullif(hits+misses+false_alarms,0)::double,6)+0.0 as ts, round(hits/nullif(hits+misses,0)::double,6)+0.0 as pod, round(false_alarms/nullif(hits+false_alarms,0)::double,6)+0.0 as far, round(misses/nullif(hits+misses,0)::double,6)+0.0 as miss_rate, round((hits+false_alarms)/nullif(hits+misses,0)::double,6)+0.0 as bias_score"
_SCORE_NAMES = ("ts", "pod", "far", "miss_rate", "bias_score")


@query(f"select *, {_SCORES} from ct", fc=FC, ct=_COUNTS)
def contingency(spark, d):
    out = categorical.contingency_table(view(spark, d, FC), ["model", "lead_h"], _T24)
    return out.select("model", "lead_h", "threshold", "hits", "misses", "false_alarms", "n_pairs", *r(*_SCORE_NAMES))


@query(f"select * exclude (h,m,f,n), {_SCORES} from (select model, threshold, cast(sum(hits) as bigint) as hits, cast(sum(misses) as bigint) as misses, cast(sum(false_alarms) as bigint) as false_alarms, cast(sum(n_pairs) as bigint) as n_pairs, 0 as h, 0 as m, 0 as f, 0 as n from ct group by 1,2)", fc=FC, ct=_COUNTS)
def pooled_contingency(spark, d):
    out = categorical.pooled(categorical.contingency_table(view(spark, d, FC), ["model", "lead_h"], _T24), ["model", "threshold"])
    return out.select("model", "threshold", "hits", "misses", "false_alarms", "n_pairs", *r(*_SCORE_NAMES))


@query("select model, lead_h, round(sum(w*ts)/sum(case when ts is not null then w end),6)+0.0 as ts_composite from (select model, lead_h, case threshold when 0.1 then 0.3 when 100 then 0.1 else 0.2 end as w, hits/nullif(hits+misses+false_alarms,0)::double as ts from ct) group by 1,2", fc=FC, ct=_COUNTS)
def composite_score(spark, d):
    table = categorical.contingency_table(view(spark, d, FC), ["model", "lead_h"], _T24, missing_as_zero=True)
    out = categorical.composite(table, ["model", "lead_h"], dict(zip(_T24, categorical.COMPOSITE_WEIGHTS[24], strict=True)))
    return out.select("model", "lead_h", *r("ts_composite"))


@query("""select model, variable, n as "window", round(1-sum((pf-po)*(pf-po))/nullif(sum(pf*pf+po*po),0),6)+0.0 as fss from (select t.model, t.variable, n, t.lat_i, t.lon_i, sum((c.fcst>=30)::int)/(n*n)::double as pf, sum((c.obs>=30)::int)/(n*n)::double as po
 from cells t, (select unnest([3,7]) as n), cells c where c.model=t.model and c.variable=t.variable and c.lat_i between t.lat_i-n//2 and t.lat_i+n//2 and c.lon_i between t.lon_i-n//2 and t.lon_i+n//2 group by 1,2,3,4,5) group by 1,2,3""", cells=CELLS)
def fractions_skill(spark, d):
    return categorical.fractions_skill(view(spark, d, CELLS), ["model", "variable"], 30.0, [3, 7]).select("model", "variable", "window", *r("fss"))


@query("select station_id, count(*) as n, round(sum(total),4)+0.0 as total from (select station_id, sum(rain) over w as total, count(*) over w as k from h window w as (partition by station_id order by obs_time range between interval 5 hours preceding and current row)) where k=6 group by 1", h=HOURS)
def complete_windows(spark, d):
    out = categorical.complete_windows(view(spark, d, HOURS), 6)
    return out.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("total"), 4).alias("total"))


@query("select station_id, count(*) as n, round(sum(total),4)+0.0 as total from (select station_id, sum(greatest(rain,0)) over w as total from h window w as (partition by station_id order by obs_time range between interval 5 hours preceding and current row)) group by 1", h=HOURS)
def lenient_windows(spark, d):
    out = categorical.lenient_windows(view(spark, d, HOURS), 6)
    return out.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("total"), 4).alias("total"))


# --- ensembles ----------------------------------------------------------------


def ens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with 64 members, and the next vector's first number as observation."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("members", F.col("embedding").cast("array<double>"))
    nxt = F.lead(F.col("members")[0]).over(Window.partitionBy("label").orderBy("vec_id"))
    lat = (F.col("vec_id") % 13).cast("double") * 14.0 - 84.0
    return e.select("vec_id", F.col("label").cast("int").alias("variable"), "members", nxt.alias("obs"), lat.alias("lat"), F.cos(F.radians(lat)).alias("w")).where("obs is not null")


ENS = "select * from (select vec_id, cast(label as int) as variable, embedding as members, lead(embedding[1]::double) over (partition by label order by vec_id) as obs, cast(vec_id % 13 as double)*14.0-84.0 as lat, cos(radians(cast(vec_id % 13 as double)*14.0-84.0)) as w from embeddings) where obs is not null"
_MEM = "select vec_id, variable, obs, w, x, row_number() over (partition by vec_id order by x) as k from (select vec_id, variable, obs, w, unnest(members)::double as x from ens)"
_CELL = "select vec_id, variable, any_value(obs) as obs, any_value(w) as w, avg(abs(x-obs)) - sum(x*(2*k-65))/4096 as crps, stddev_pop(x) as sd, stddev_samp(x) as sd1, avg(x) as mean from mem group by 1,2"


@query(f"select variable, round(sum(w*crps)/sum(w),6)+0.0 as crps, round(sum(w*greatest(crps,0))/sum(w),6)+0.0 as crps_floored, round(sqrt(sum(sd*sd)/sum(w)),6)+0.0 as spread, round(sqrt(sum(w*sd1*sd1)/sum(w)),6)+0.0 as spread_sample, round(sqrt(sum(w*(mean-obs)*(mean-obs))/sum(w)),6)+0.0 as rmse, round(sqrt(sum(sd*sd)/sum(w))/sqrt(sum(w*(mean-obs)*(mean-obs))/sum(w)),6)+0.0 as spread_error_ratio from cell group by 1", ens=ENS, mem=_MEM, cell=_CELL)
def ensemble_scores(spark, d):
    return ensemble.ensemble_scores(ens(spark, d), ["variable"]).select("variable", *r("crps", "crps_floored", "spread", "spread_sample", "rmse", "spread_error_ratio"))


_ET = "(select unnest([-0.1,0.0,0.1])::double as threshold)"


@query(f"select variable, threshold, round(sum(w*(p-e)*(p-e))/sum(w),6)+0.0 as brier from (select vec_id, variable, threshold, any_value(w) as w, avg((x>=threshold)::int) as p, any_value((obs>=threshold)::int) as e from mem, {_ET} group by 1,2,3) group by 1,2", ens=ENS, mem=_MEM)
def brier(spark, d):
    return ensemble.brier(ens(spark, d), ["variable"], [-0.1, 0.0, 0.1]).select("variable", "threshold", *r("brier"))


_HIST = f"select variable, threshold, k, count(*) filter (e=0) as h0, count(*) filter (e=1) as h1 from (select vec_id, variable, threshold, sum((x>=threshold)::int)::int as k, any_value((obs>=threshold)::int) as e from mem, {_ET} group by 1,2,3) group by 1,2,3"


@query("select variable, threshold, k, h0, h1 from hist", ens=ENS, mem=_MEM, hist=_HIST)
def event_histogram(spark, d):
    return categorical.event_histogram(ens(spark, d), ["variable"], [-0.1, 0.0, 0.1]).select("variable", "threshold", "k", "h0", "h1")


@query("""select variable, threshold, round(sum(h0*pow(k/64.0,2)+h1*pow(1-k/64.0,2))/sum(h0+h1),6)+0.0 as bs, round(sum(h1)/sum(h0+h1),6)+0.0 as base_rate,
 round(1-(sum(h0*pow(k/64.0,2)+h1*pow(1-k/64.0,2))/sum(h0+h1))/nullif(sum(h1)/sum(h0+h1)*(1-sum(h1)/sum(h0+h1)),0),6)+0.0 as bss,
 round(case when max(n1)>0 and max(n0)>0 then sum((pofd-coalesce(p0,0))*(pod+coalesce(d0,0))/2) end,6)+0.0 as aroc from
 (select *, lag(pofd) over v as p0, lag(pod) over v as d0 from (select *, sum(h1) over u/nullif(sum(h1) over g,0) as pod, sum(h0) over u/nullif(sum(h0) over g,0) as pofd, sum(h1) over g as n1, sum(h0) over g as n0 from hist
  window u as (partition by variable, threshold order by k desc rows unbounded preceding), g as (partition by variable, threshold)) window v as (partition by variable, threshold order by k desc)) group by 1,2""", ens=ENS, mem=_MEM, hist=_HIST)
def probability_scores(spark, d):
    h = categorical.event_histogram(ens(spark, d), ["variable"], [-0.1, 0.0, 0.1])
    return categorical.probability_scores(h, ["variable"]).select("variable", "threshold", *r("bs", "base_rate", "bss", "aroc"))


@query(f"""select variable, threshold, round(least(1,greatest(0,sum((pofd-coalesce(p0,0))*(pod+coalesce(d0,0))/2))),6)+0.0 as aroc from
 (select *, lag(pofd) over v as p0, lag(pod) over v as d0 from (select variable, threshold, p, sum(h) over u/nullif(sum(h) over g,0) as pod, sum(f) over u/nullif(sum(f) over g,0) as pofd from
  (select variable, threshold, p, sum(case when e=1 then w else 0 end) as h, sum(case when e=0 then w else 0 end) as f from (select vec_id, variable, threshold, any_value(w) as w, avg((x>=threshold)::int) as p, any_value((obs>=threshold)::int) as e from mem, {_ET} group by 1,2,3) group by 1,2,3)
  window u as (partition by variable, threshold order by p desc rows unbounded preceding), g as (partition by variable, threshold)) window v as (partition by variable, threshold order by p desc)) group by 1,2""", ens=ENS, mem=_MEM)
def weighted_roc(spark, d):
    """An undefined area is 0 here, as in the SQL."""
    x = categorical.at_thresholds(ens(spark, d), [-0.1, 0.0, 0.1])
    x = x.select("variable", "threshold", "w", c.exceed_share("members", "threshold").alias("p"), (F.col("obs") >= F.col("threshold")).cast("int").alias("event"))
    return categorical.weighted_roc(x, ["variable", "threshold"], undefined=0.0).select("variable", "threshold", *r("aroc"))


@query("select variable, round(bs,6)+0.0 as bs, round(bs_ref,6)+0.0 as bs_ref, round(case when bs_ref>0 then 1-bs/bs_ref end,6)+0.0 as bss from (select variable, avg(pow(p-e,2)) as bs, avg(pow(coalesce(r,0)-e,2)) as bs_ref from (select vec_id, variable, avg((x>=0)::int) as p, any_value((obs>=0)::int) as e, case when vec_id % 3 = 0 then null else 0.5 end as r from mem group by 1,2) group by 1)", ens=ENS, mem=_MEM)
def reference_brier(spark, d):
    x = ens(spark, d).select("variable", c.exceed_share("members", F.lit(0.0)).alias("p"), (F.col("obs") >= 0).cast("int").alias("event"), F.when(F.col("vec_id") % 3 != 0, 0.5).alias("p_ref"))
    return categorical.reference_brier(x, ["variable"]).select("variable", *r("bs", "bs_ref", "bss"))


# --- spectra ------------------------------------------------------------------

_RING = "select vec_id, lat, cos(radians(lat)) as w, unnest(members)::double as x, unnest(range(64)) as i from (select vec_id, embedding as members, cast(vec_id % 13 as double)*14.0-84.0 as lat from embeddings)"
_PSD = "select vec_id, any_value(w) as w, k as wavenumber, case when k=0 then 0.0 else (pow(sum((x-m)*cos(2*pi()*((k*i)%64)/64)),2)+pow(sum((x-m)*sin(2*pi()*((k*i)%64)/64)),2))/4096 end as psd from (select *, avg(x) over (partition by vec_id) as m from ring), (select unnest(range(33)) as k) group by 1,3"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", ((F.col("vec_id") % 13).cast("double") * 14.0 - 84.0).alias("lat"), F.col("embedding").cast("array<double>").alias("values"))


@query("select cast(wavenumber as int) as wavenumber, round(sum(w*psd)/sum(w),9)+0.0 as psd, round(40075.0/nullif(wavenumber,0),6)+0.0 as wavelength_km from psd group by 1, wavenumber", ring=_RING, psd=_PSD)
def zonal_spectrum(spark, d):
    p = spectra.ring_spectrum(rings(spark, d), ["vec_id", "lat"])
    return spectra.zonal_spectrum(p, []).select("wavenumber", tidy("psd", 9).alias("psd"), *r("wavelength_km"))


@query("select band, round(sum(z),9)+0.0 as psd from (select wavenumber, sum(w*psd)/sum(w) as z from psd group by 1) join (select * from (values ('1_4',1,4),('5_20',5,20),('21_40',21,40)) t(band,lo,hi)) on wavenumber between lo and hi group by 1", ring=_RING, psd=_PSD)
def band_power(spark, d):
    z = spectra.zonal_spectrum(spectra.ring_spectrum(rings(spark, d), ["vec_id", "lat"]), [])
    return spectra.band_power(z, [], spectra.band_table(spark, spectra.BANDS[:3])).select("band", tidy("psd", 9).alias("psd"))


_F2 = f"select lat_i % 12 as lat_i, lon_i % 24 as lon_i, avg(fcst) as value from ({FC}) f group by 1,2"


@query("select cast(k as int) as k, round(case when k=0 or k=12 then 1 else 2 end*12.0*sum(a*a+b*b),3)+0.0 as p from (select k, ((lat_i-lon_i)%12+12)%12 as d, sum(value*cos(2*pi()*((k*lon_i)%24)/24)) as a, sum(value*sin(2*pi()*((k*lon_i)%24)/24)) as b from f2, (select unnest(range(11)) as k) group by 1,2) group by 1, k", f2=_F2)
def diagonal_spectrum(spark, d):
    x = view(spark, d, _F2).withColumn("field", F.lit(1))
    return spectra.diagonal_spectrum(x, ["field"], 12, 24, 10).select("k", tidy("p", 3).alias("p"))


def _harmonics(n: int, l_max: int) -> str:
    """Rows (i, w, l, m, h): interpolatory weights of n equidistant latitudes, and weighted orthonormal harmonics there.

    Weights solve the moment equations of Chebyshev polynomials; harmonics are derivatives of Legendre polynomials.
    """
    theta = np.pi * np.arange(n) / (n - 1)
    k = np.arange(n)
    w = np.linalg.solve(np.cos(np.outer(k, theta)), [0.0 if j % 2 else 2.0 / (1 - j * j) for j in k])
    x = -np.cos(theta)
    rows = []
    for deg in range(l_max + 1):
        for m in range(deg + 1):
            norm = math.sqrt((2 * deg + 1) / (4 * math.pi) * math.factorial(deg - m) / math.factorial(deg + m))
            p = np.polynomial.legendre.Legendre.basis(deg).deriv(m)(x) if m else np.polynomial.legendre.Legendre.basis(deg)(x)
            h = w * norm * np.maximum(1 - x * x, 0) ** (m / 2) * p
            rows += [f"({i},{w[i]!r}::double,{deg},{m},{h[i]!r}::double)".replace("np.float64(", "(") for i in range(n)]
    return "select * from (values " + ",".join(rows) + ") t(i,w,l,m,h)"


@query("select cast(field as int) as field, cast(l as int) as degree, round(sum(case m when 0 then 1 else 2 end*(re*re+im*im)),9)+0.0 as power from coef group by 1,2",
 e="select vec_id // 13 as field, vec_id % 13 as i, unnest(embedding)::double as x, unnest(range(64)) as j from embeddings", basis=_harmonics(13, 6),
 mean="select field, sum(w*x)/sum(w) as g from e join (select distinct i, w from basis) using (i) group by 1 having count(distinct i)=13",
 wave="select field, i, m, sum((x-g)*cos(2*pi()*m*j/64))*2*pi()/64 as re, sum((x-g)*sin(2*pi()*m*j/64))*2*pi()/64 as im from e join mean using (field), (select unnest(range(7)) as m) group by 1,2,3",
 coef="select field, l, m, sum(h*re) as re, sum(h*im) as im from wave join basis using (i, m) group by 1,2,3")
def spherical_spectrum(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    ring = e.select((F.col("vec_id") / 13).cast("int").alias("field"), ((F.col("vec_id") % 13).cast("double") * 15.0 - 90.0).alias("lat"), F.col("embedding").cast("array<double>").alias("values"))
    return spectra.spherical_spectrum(ring, ["field"], 6).select("field", "degree", tidy("power", 9).alias("power"))


# --- sub-seasonal -------------------------------------------------------------


@query("select variable, lat_i, case when min(fcst)<max(fcst) and min(obs)<max(obs) then round(corr(fcst,obs),6)+0.0 end as tcc, round(sqrt(avg(pow(fcst-obs,2))),6)+0.0 as rmse, count(*) as n from daily group by 1,2", daily=DAILY)
def temporal_skill(spark, d):
    return subseasonal.temporal_skill(view(spark, d, DAILY), ["variable", "lat_i"]).select("variable", "lat_i", *r("tcc", "rmse"), "n")


#: Both tails of Student's t of a correlation tcc of n pairs: the integral of cos^(n-3) from asin |tcc| to a right angle, by Simpson's rule.
_STUDENT = "2*exp(lgamma((n-1)/2.0)-lgamma((n-2)/2.0))/sqrt(pi())*((pi()/2-t)/400/3)*list_sum(list_transform(range(401), lambda i: (case when i=0 or i=400 then 1 when i%2=1 then 4 else 2 end)*pow(abs(cos(t+(pi()/2-t)*i/400.0)), n-3)))"


@query(f"select variable, lat_i, round(tcc,6)+0.0 as tcc, n, round(case when n>2 then {_STUDENT} end,6)+0.0 as p from (select *, asin(least(abs(tcc),0.999999)) as t from (select variable, lat_i, case when min(fcst)<max(fcst) and min(obs)<max(obs) then corr(fcst,obs) end as tcc, count(*) as n from daily group by 1,2))", daily=DAILY)
def correlation_p_values(spark, d):
    x = subseasonal.temporal_skill(view(spark, d, DAILY), ["variable", "lat_i"])
    return x.select("variable", "lat_i", *r("tcc"), "n", tidy(c.clean(subseasonal.correlation_p("tcc", "n"))).alias("p"))


_LEADS = f"select variable, cast(1 + (lon_i % 60) as int) as lead_day, avg(fcst) as value from ({FC}) f group by 1,2"
_WEEKS = "(values " + ",".join(f"('{n}',{a},{b})" for n, a, b in subseasonal.WEEKS) + ") t(week,lo,hi)"


@query(f"select variable, week, round(avg(value),6)+0.0 as value from leads join (select * from {_WEEKS}) on lead_day between lo and hi group by 1,2", leads=_LEADS)
def weekly_means(spark, d):
    return subseasonal.weekly_means(view(spark, d, _LEADS), ["variable"]).select("variable", "week", *r("value"))


@query(f"with wk as (select variable, week, avg(value) as value from leads join (select * from {_WEEKS} where week in ('week3','week4','week5','week6')) on lead_day between lo and hi group by 1,2) select variable, week, round(value,6)+0.0 as value from wk union all select variable, case when week in ('week3','week4') then 'week34' else 'week56' end, round(avg(value),6)+0.0 from wk group by 1,2".replace("with wk as", "select * from (with wk as") + ")", leads=_LEADS)
def derived_weeks(spark, d):
    w = subseasonal.weekly_means(view(spark, d, _LEADS), ["variable"]).where(F.col("week").isin("week3", "week4", "week5", "week6"))
    return subseasonal.derived_weeks(w, ["variable"], ["value"]).select("variable", "week", *r("value"))


@query("select variable, mmdd, round(clim,9)+0.0 as clim, n, round(worst,6)+0.0 as worst from (select variable, mmdd, avg(v) as clim, cast(sum(n) as bigint) as n, max(abs(d)) as worst from (select variable, strftime(day,'%m%d') as mmdd, obs as v, 1 as n, obs - avg(obs) over (partition by variable, lat_i, strftime(day,'%m%d')) as d from daily where strftime(day,'%m%d')<>'0229') group by 1,2)", daily=DAILY)
def daily_anomalies(spark, d):
    x = view(spark, d, DAILY).where(F.date_format("day", "MMdd") != "0229")
    clim = subseasonal.daily_climatology(x, ["variable", "lat_i"], "obs")
    a = subseasonal.daily_anomaly(x, clim, ["variable", "lat_i"], "obs")
    return a.groupBy("variable", "mmdd").agg(tidy(F.avg("obs"), 9).alias("clim"), F.count(F.lit(1)).alias("n"), tidy(F.max(F.abs("anomaly"))).alias("worst"))


@query("select year(d) as y, count(*) as n, min(d) as first_day, max(d) as last_day from (select unnest(generate_series(date '1995-01-01', date '1998-12-31', interval 1 day))::date as d) where strftime(d,'%m%d')<>'0229' and (dayofyear(d) - case when year(d)%4=0 and dayofyear(d)>59 then 1 else 0 end) % 2 = 1 group by 1")
def odd_day_starts(spark, d):
    x = subseasonal.odd_day_starts(spark, [1995, 1996, 1997, 1998])
    return x.groupBy(F.year("init_date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("init_date").alias("first_day"), F.max("init_date").alias("last_day"))


_DAYS = f"select variable, init as day, avg(fcst) as anomaly from ({FC}) f group by 1,2"
_ORD = "(year({0})*365+dayofyear({0})-case when (year({0})%4=0 and year({0})%100<>0 or year({0})%400=0) and dayofyear({0})>59 then 1 else 0 end)"


@query(f"select s.variable, s.lead_day, count(*) as n, count(d.anomaly) as n_there, round(avg(d.anomaly),6)+0.0 as anomaly from (select variable, init_date, lead_day, {_ORD.format('init_date')}+lead_day as o from (select distinct variable from days), (select unnest([date '1996-02-20', date '1996-12-20', date '1997-06-01']) as init_date), (select unnest(range(1,61)) as lead_day)) s left join (select *, {_ORD.format('day')} as o from days where strftime(day,'%m%d')<>'0229') d on d.variable=s.variable and d.o=s.o group by 1,2".replace("s.lead_day, count", "cast(s.lead_day as int) as lead_day, count").replace("group by 1,2", "group by 1, s.lead_day"), days=_DAYS)
def assembled_leads(spark, d):
    starts = spark.createDataFrame([("1996-02-20",), ("1996-12-20",), ("1997-06-01",)], "x string").select(F.to_date("x").alias("init_date"))
    x = subseasonal.assemble_leads(starts, view(spark, d, _DAYS), ["variable"], 60)
    return x.groupBy("variable", "lead_day").agg(F.count(F.lit(1)).alias("n"), F.count("anomaly").alias("n_there"), tidy(F.avg("anomaly")).alias("anomaly"))


@query(f"select name, variable, round(sum({W}*v)/sum({W}),6)+0.0 as value from (select variable, lat, lon, avg(obs) as v from cells group by 1,2,3) join regions on lat between lat0 and lat1 and case when lon0<=lon1 then lon between lon0 and lon1 else lon>=lon0 or lon<=lon1 end group by 1,2", cells=CELLS, regions=REGIONS)
def region_means(spark, d):
    regions = spark.sql(REGIONS).select("name", *[F.col(x).cast("double").alias(x) for x in ("lat0", "lat1", "lon0", "lon1")])
    x = view(spark, d, CELLS).groupBy("variable", "lat", "lon").agg(F.avg("obs").alias("value"))
    return deterministic.weighted_region_mean(x, regions, ["variable"], "value").select("name", "variable", *r("value"))


# --- tropical cyclones --------------------------------------------------------

_OBS = "10 + tcid + lead_h/12.0 as lat, 130 + 0.7*lead_h/6.0 as lon"
_GC = "2*6371*asin(sqrt(least(1,greatest(0,pow(sin(radians({2}-{0})/2),2)+cos(radians({0}))*cos(radians({2}))*pow(sin(radians({3}-{1})/2),2)))))"
_BR = "atan2((({3}-{1}+180)-360*floor(({3}-{1}+180)/360)-180)*cos(radians(({0}+{2})/2)),{2}-{0})"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACK).withColumns({"lat": 10.0 + F.col("tcid") + F.col("lead_h") / 12.0, "lon": 130.0 + 0.7 * F.col("lead_h") / 6.0})


_ERR = f"""select tcid, member, lead_h, {_GC.format('lat', 'lon', 'plat', 'plon')} as distance_km,
 {_GC.format('la', 'lo', 'plat', 'plon')}*cos({_BR.format('la', 'lo', 'plat', 'plon')}-{_BR.format('la', 'lo', 'lat', 'lon')})-{_GC.format('la', 'lo', 'lat', 'lon')} as along_km,
 {_GC.format('la', 'lo', 'plat', 'plon')}*sin({_BR.format('la', 'lo', 'plat', 'plon')}-{_BR.format('la', 'lo', 'lat', 'lon')}) as cross_km
 from (select *, lag(lat) over w as la, lag(lon) over w as lo from (select *, {_OBS} from track) window w as (partition by tcid, member order by lead_h))"""


@query("select tcid, member, lead_h, round(distance_km,4)+0.0 as distance_km, round(along_km,4)+0.0 as along_km, round(cross_km,4)+0.0 as cross_km from err", track=TRACK, err=_ERR)
def track_errors(spark, d):
    out = tropical.track_errors(tracks(spark, d), ["tcid", "member"])
    return out.select("tcid", "member", "lead_h", *[tidy(x, 4).alias(x) for x in ("distance_km", "along_km", "cross_km")])


@query("select tcid, lead_h, round(avg(distance_km),4)+0.0 as distance_km, count(distinct member) as n_members from err group by 1,2", track=TRACK, err=_ERR)
def ensemble_track_a(spark, d):
    out = tropical.ensemble_track_mean(tropical.track_errors(tracks(spark, d), ["tcid", "member"]), ["tcid", "lead_h"])
    return out.select("tcid", "lead_h", tidy("distance_km", 4).alias("distance_km"), "n_members")


@query(f"select tcid, lead_h, round({_GC.format('lat', 'lon', 'plat', 'plon')},4)+0.0 as distance_km from (select *, {_OBS} from (select tcid, lead_h, avg(plat) as plat, avg(plon) as plon from track group by 1,2))", track=TRACK)
def ensemble_track_b(spark, d):
    x = tropical.ensemble_mean_track(tracks(spark, d), ["tcid", "lead_h", "lat", "lon"])
    return x.select("tcid", "lead_h", tidy(c.great_circle("lat", "lon", "plat", "plon"), 4).alias("distance_km"))


@query("select model, variable, round(arg_min(fcst, (fcst,lat_i,lon_i)),6)+0.0 as fcst, arg_min(lat, (fcst,lat_i,lon_i)) as lat, arg_min(lon, (fcst,lat_i,lon_i)) as lon from cells group by 1,2".replace("arg_min(fcst, (fcst,lat_i,lon_i))", "min(fcst)").replace("(fcst,lat_i,lon_i)", "row(fcst,lat_i,lon_i)"), cells=CELLS)
def storm_centres(spark, d):
    return tropical.centres(view(spark, d, CELLS), ["model", "variable"], "fcst").select("model", "variable", *r("fcst"), "lat", "lon")


@query("select m.model, round(max(cells.obs),6)+0.0 as vmax from cells join (select model, arg_min(lat, row(fcst,lat_i,lon_i)) as clat, arg_min(lon, row(fcst,lat_i,lon_i)) as clon from cells where variable='A' group by 1) m on m.model=cells.model where abs(lat-clat)<=10 and abs((lon-clon+180)-360*floor((lon-clon+180)/360)-180)<=10 group by 1", cells=CELLS)
def storm_wind(spark, d):
    cells = view(spark, d, CELLS)
    at = tropical.centres(cells.where("variable = 'A'"), ["model"], "fcst").select("model", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return tropical.max_wind(cells, at, ["model"], 10.0, "obs").select("model", *r("vmax"))


# --- roll-ups -----------------------------------------------------------------


@query("select model, variable, init, round(arg_min(rmse, row(abs(lead_h-24), lead_h)),6)+0.0 as rmse_24h, round(arg_max(rmse, lead_h),6)+0.0 as rmse_last, round(avg(rmse),6)+0.0 as rmse_mean, count(distinct lead_h) as n_leads from a group by 1,2,3", a=ARCHIVE)
def batch_rows(spark, d):
    out = summary.batch_row(view(spark, d, ARCHIVE), ["model", "variable", "init"], "rmse")
    return out.select("model", "variable", F.col("init").cast("date").alias("init"), *r("rmse_24h", "rmse_last", "rmse_mean"), "n_leads")


ORACLE["batch_rows"] = ORACLE["batch_rows"].replace("variable, init, round", "variable, cast(init as date) as init, round")


@query("select model, variable, lead_h, round(avg(rmse),6)+0.0 as rmse, count(distinct init) as n_dates from a group by 1,2,3", a=ARCHIVE)
def mean_over_dates(spark, d):
    return summary.mean_over_dates(view(spark, d, ARCHIVE), ["model", "variable", "lead_h"], ["rmse"]).select("model", "variable", "lead_h", *r("rmse"), "n_dates")


@query("select model, lead_h, metric, round(value,6)+0.0 as value from (unpivot (select model, lead_h, avg(rmse) as rmse_mean, max(rmse) as rmse_max from a group by 1,2) on rmse_mean, rmse_max into name metric value value)", a=ARCHIVE)
def long_form(spark, d):
    x = view(spark, d, ARCHIVE).groupBy("model", "lead_h").agg(F.avg("rmse").alias("rmse_mean"), F.max("rmse").alias("rmse_max"))
    return summary.long_form(x, ["model", "lead_h"], ["rmse_mean", "rmse_max"]).select("model", "lead_h", "metric", *r("value"))


@query("select variable, lead_h, round(avg(rmse),6)+0.0 as mean, round(quantile_cont(rmse,0.1),6)+0.0 as lo, round(quantile_cont(rmse,0.9),6)+0.0 as hi, count(*) as n from a group by 1,2", a=ARCHIVE)
def lead_band(spark, d):
    return summary.lead_band(view(spark, d, ARCHIVE), ["variable", "lead_h"], "rmse").select("variable", "lead_h", *r("mean", "lo", "hi"), "n")


_CURVE = f"select model, variable, lead_h, avg(rmse) as value from ({ARCHIVE}) a group by 1,2,3"


@query('select model, variable, round(max(value) filter (k=1),6)+0.0 as "first", round(max(value) filter (k=n//2+1),6)+0.0 as middle, round(max(value) filter (k=n),6)+0.0 as "last", round(avg(value),6)+0.0 as mean, count(*) filter (d>0) as n_rise, count(*) filter (d<0) as n_fall from (select *, row_number() over w as k, count(*) over (partition by model, variable) as n, value-lag(value) over w as d from curve window w as (partition by model, variable order by lead_h)) group by 1,2', curve=_CURVE)
def series_statistics(spark, d):
    out = summary.series_statistics(view(spark, d, _CURVE), ["model", "variable"])
    return out.select("model", "variable", *r("first", "middle", "last", "mean"), "n_rise", "n_fall")


@query("select model, round(q1,6)+0.0 as q1, round(median,6)+0.0 as median, round(q3,6)+0.0 as q3, round(coalesce(min(rmse) filter (rmse between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)),q1),6)+0.0 as whisker_lo, round(coalesce(max(rmse) filter (rmse between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)),q3),6)+0.0 as whisker_hi, count(*) filter (not rmse between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as n_out from a join (select model, quantile_cont(rmse,0.25) as q1, quantile_cont(rmse,0.5) as median, quantile_cont(rmse,0.75) as q3 from a group by 1) using (model) group by model, q1, median, q3".replace("as q1, round(median", "as q1, round(median"), a=ARCHIVE)
def box_statistics(spark, d):
    out = summary.box_statistics(view(spark, d, ARCHIVE), ["model"], "rmse")
    return out.select("model", *r("q1", "median", "q3", "whisker_lo", "whisker_hi"), F.size("outliers").cast("long").alias("n_out"))


@query(f"select model, threshold, cast(sum(hits) as bigint) as hits, round(sum(hits)/nullif(sum(hits+misses+false_alarms),0),6)+0.0 as ts, round(avg(hits/nullif(hits+misses+false_alarms,0)::double),6)+0.0 as ts_mean, count(distinct lead_h) as n_leads, round((arg_min(hits/nullif(hits+misses+false_alarms,0)::double, lead_h)-arg_max(hits/nullif(hits+misses+false_alarms,0)::double, lead_h))/nullif((max(lead_h)-min(lead_h))/24,0),6)+0.0 as decay_per_day from ct where threshold < 100 group by 1,2", fc=FC, ct=_COUNTS)
def ts_summary(spark, d):
    t = categorical.contingency_table(view(spark, d, FC), ["model", "lead_h"], _T24).where("threshold < 100")
    return summary.ts_summary(t, ["model", "threshold"]).select("model", "threshold", "hits", *r("ts", "ts_mean"), "n_leads", *r("decay_per_day"))


@query("select model, lead_h, threshold, coalesce((hits+false_alarms)/nullif(hits+misses,0)::double>1.3 and false_alarms/nullif(hits+false_alarms,0)::double>0.45, false) as overforecast, hits+misses<50 as rare, case when hits/nullif(hits+misses+false_alarms,0)::double>=0.3 then 'good' when hits/nullif(hits+misses+false_alarms,0)::double>=0.2 then 'fair' else 'poor' end as mark from ct", fc=FC, ct=_COUNTS)
def ts_diagnosis(spark, d):
    t = summary.ts_diagnosis(categorical.contingency_table(view(spark, d, FC), ["model", "lead_h"], _T24))
    return t.select("model", "lead_h", "threshold", F.coalesce("overforecast", F.lit(False)).alias("overforecast"), "rare", "mark")


@query("select model, variable, count(*) filter (d>0.005) as n_rises, min(lead_h) filter (value<9) as first_below from (select *, value-lag(value) over (partition by model, variable order by lead_h) as d from curve) group by 1,2", curve=_CURVE)
def curve_changes(spark, d):
    return summary.curve_changes(view(spark, d, _CURVE), ["model", "variable"], "value", floor=9.0).select("model", "variable", "n_rises", "first_below")


@query("select variable, lead_h, winner, coalesce(winner <> lag(winner) over (partition by variable order by lead_h), false) as flip from (select variable, lead_h, arg_min(model, row(-value, model)) as winner from curve group by 1,2)", curve=_CURVE)
def winner_flips(spark, d):
    return summary.winner_flips(view(spark, d, _CURVE), ["variable"], "lead_h").select("variable", "lead_h", "winner", "flip")


# --- comparison ---------------------------------------------------------------

_MEANS = f"select model, variable, avg(rmse) as rmse from ({ARCHIVE}) a group by 1,2"
_REL = "select *, 100*rmse/exp(avg(ln(rmse)) over (partition by variable)) as relative from means"


@query("select init, count(*) as n from a where init in (select init from a group by 1 having count(distinct model) = (select count(distinct model) from a)) group by 1".replace("select init, count", "select cast(init as date) as init, count").replace("group by 1 having", "group by init having").replace("group by 1", "group by init"), a=ARCHIVE)
def common_dates(spark, d):
    return compare.common_dates(view(spark, d, ARCHIVE)).groupBy(F.col("init").cast("date").alias("init")).agg(F.count(F.lit(1)).alias("n"))


@query("select model, variable, round(relative,6)+0.0 as relative from rel", means=_MEANS, rel=_REL)
def relative_scores(spark, d):
    return compare.relative(view(spark, d, _MEANS), ["variable"]).select("model", "variable", *r("relative"))


@query("select model, round(c,6)+0.0 as relative, rank() over (order by c) as relative_rank from (select model, avg(relative) as c from rel group by 1)", means=_MEANS, rel=_REL)
def composite_ranks(spark, d):
    out = compare.ranks(compare.composite_relative(view(spark, d, _MEANS)), {"relative": True})
    return out.select("model", *r("relative"), F.col("relative_rank").cast("long").alias("relative_rank"))


@query("select model, lead_h, round(avg(relative),6)+0.0 as relative from (select model, variable, lead_h, 100*value/exp(avg(ln(value)) over (partition by variable, lead_h)) as relative from curve) group by 1,2", curve=_CURVE)
def composite_by_lead(spark, d):
    return compare.composite_relative(view(spark, d, _CURVE), ["lead_h"], "value").select("model", "lead_h", *r("relative"))


@query("select model, band, round(avg(relative),6)+0.0 as relative from (select model, band, 100*v/exp(avg(ln(v)) over (partition by variable, band)) as relative from (select model, variable, case when lead_h<=12 then '0_12' else '12_60' end as band, avg(value) as v from curve group by 1,2,3)) group by 1,2", curve=_CURVE)
def composite_by_band(spark, d):
    return compare.lead_bands(view(spark, d, _CURVE), "value", bands=((0, 12), (12, 60))).select("model", "band", *r("relative"))


@query("select model, round(f,6)+0.0 as full, round(w,6)+0.0 as without, rank() over (order by f) <> rank() over (order by w) as moved from (select model, avg(relative) as f, avg(relative) filter (variable<>'A') as w from rel group by 1)".replace("as full", 'as "full"').replace("as without", 'as "without"'), means=_MEANS, rel=_REL)
def without_variable(spark, d):
    return compare.without_variable(view(spark, d, _MEANS), "A").select("model", *r("full", "without"), "moved")


@query("select variable, worst_model, round(worst,6)+0.0 as worst, round(worst/median,6)+0.0 as times_median, coalesce(worst/median>=3,false) as flagged, round(worst/mo,6)+0.0 as times_others from (select m.variable, any_value(x.worst) as worst, any_value(x.worst_model) as worst_model, any_value(x.median) as median, quantile_cont(m.rmse,0.5) filter (m.model<>x.worst_model) as mo from means m join (select variable, max(rmse) as worst, arg_max(model, rmse) as worst_model, quantile_cont(rmse,0.5) as median from means group by 1) x on x.variable=m.variable group by 1)", means=_MEANS)
def anomaly_detector(spark, d):
    return compare.anomalies(view(spark, d, _MEANS)).select("variable", "worst_model", *r("worst", "times_median"), "flagged", *r("times_others"))


@query("select model, round(100*avg(rr),6)+0.0 as log_rms from (select model, variable, init, sqrt(avg(pow(ln(pred/obs),2))) as rr from sp where wavenumber>0 group by 1,2,3) group by 1", sp=SPECTRA)
def log_spectrum(spark, d):
    by = compare.log_spectrum_rms(view(spark, d, SPECTRA).withColumn("init", F.struct("init", "variable")), ["model"])
    return by.select("model", *r("log_rms"))


@query("select model, band, round(avg(p)/avg(o),6)+0.0 as energy_ratio from (select model, init, variable, band, sum(pred) as p, sum(obs) as o from sp join (select * from (values ('1_4',1,4),('5_20',5,20)) t(band,lo,hi)) on wavenumber between lo and hi group by 1,2,3,4) group by 1,2", sp=SPECTRA)
def band_energy(spark, d):
    bands = spectra.band_table(spark, spectra.BANDS[:2])
    sp = view(spark, d, SPECTRA)
    keys = ["model", "init", "variable"]
    both = spectra.band_power(sp, keys, bands, "pred").join(spectra.band_power(sp, keys, bands, "obs"), [*keys, "band"])
    return compare.band_energy_ratio(both, ["model"]).select("model", "band", *r("energy_ratio"))


_PAIRS = "select variable, x.model as model_a, y.model as model_b, x.init, x.rmse - y.rmse as d from (select model, init, variable, avg(rmse) as rmse from a group by 1,2,3) x join (select model, init, variable, avg(rmse) as rmse from a group by 1,2,3) y using (init, variable) where x.model<y.model"


@query("select variable, model_a, model_b, round(sum(case when d>0 then rk else 0 end),6)+0.0 as w_plus, count(*) as n from (select *, rank() over (partition by variable, model_a, model_b order by abs(d)) + (count(*) over (partition by variable, model_a, model_b, abs(d)) - 1)/2.0 as rk from pairs where d<>0) group by 1,2,3", a=ARCHIVE, pairs=_PAIRS)
def signed_rank(spark, d):
    daily = view(spark, d, ARCHIVE).groupBy("model", "init", "variable").agg(F.avg("rmse").alias("rmse"))
    out = signed_rank_statistics(compare.model_pairs(daily, ["variable"], "rmse"), ["variable", "model_a", "model_b"])
    return out.select("variable", "model_a", "model_b", *r("w_plus"), F.col("n").cast("long").alias("n"))


_SIDES = "select variable, x.model as model_a, y.model as model_b, x.rmse as a, y.rmse as b, x.rmse - y.rmse as d from daily x join daily y using (init, variable) where x.model<y.model"
_PAIRMEANS = "select variable, model_a, model_b, avg(a) as mean_a, avg(b) as mean_b, count(*) filter (d=0) as zeros, count(*) filter (d<>0) as n, count(*) filter (abs(d)>1e-8+1e-5*abs(b)) as apart from sides group by 1,2,3"
_RANKS = "select variable, model_a, model_b, sum(case when d>0 then rk else 0 end) as w, sum(t*t-1) as ties from (select *, rank() over (partition by variable, model_a, model_b order by abs(d)) + (count(*) over same - 1)/2.0 as rk, count(*) over same as t from sides where d<>0 window same as (partition by variable, model_a, model_b, abs(d))) group by 1,2,3"
#: How many subsets of the ranks 1 to n have the sum w.
_SUBSETS = "select 0 as n, 0 as w, 1.0::double as c union all select n+1, w+u*(n+1), sum(c) from subsets, (select unnest([0,1]) as u) where n<50 group by 1,2"
#: Both tails of the normal distribution beyond z, by Simpson's rule.
_TAILS = "2*(10/400.0/3)*list_sum(list_transform(range(401), lambda i: (case when i=0 or i=400 then 1 when i%2=1 then 4 else 2 end)*exp(-pow(z+i/40.0,2)/2)/sqrt(2*pi())))"
_PTEST = f"""select *, case when n+zeros<2 then null when apart=0 then 1.0 when ties=0 and zeros=0 and n<=50 then least(1, 2*(select sum(c) from subsets s where s.n=t.n and s.w<=least(t.w, t.n*(t.n+1)/2-t.w))/pow(2,n)) when v<=0 then 1.0 else {_TAILS} end as p from
 (select *, case when v>0 then abs(w-n*(n+1)/4.0)/sqrt(v) end as z from (select *, n*(n+1)*(2*n+1)/24.0 - ties/48.0 as v from means left join ranks using (variable, model_a, model_b))) t"""
_PHOLM = "select *, case when p is not null then least(1, max(raw) over (partition by variable, p is null order by p rows unbounded preceding)) end as p_holm from (select *, (count(p) over (partition by variable) - row_number() over (partition by variable, p is null order by p) + 1) * p as raw from ptest)"
_DAILYMEAN = "select model, init, variable, avg(rmse) as rmse from a group by 1,2,3"
_TESTS = {"a": ARCHIVE, "daily": _DAILYMEAN, "sides": _SIDES, "means": _PAIRMEANS, "ranks": _RANKS, "subsets": _SUBSETS, "ptest": _PTEST}
_VERDICT = "case when {0} is null or {0}>=0.05 or mean_a=mean_b then 'tie' when mean_a<mean_b then 'a' else 'b' end"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, ARCHIVE).groupBy("model", "init", "variable").agg(F.avg("rmse").alias("rmse"))


@query(f"select variable, model_a, model_b, round(mean_a,6)+0.0 as mean_a, round(mean_b,6)+0.0 as mean_b, round(100*(mean_a-mean_b)/mean_b,6)+0.0 as delta_pct, n, round(p,6)+0.0 as p, round(p_holm,6)+0.0 as p_holm, {_VERDICT.format('p_holm')} as winner from holm", **_TESTS, holm=_PHOLM)
def pair_report(spark, d):
    out = compare.pair_report(_daily(spark, d), ["variable"], "rmse")
    return out.select("variable", "model_a", "model_b", *r("mean_a", "mean_b", "delta_pct"), F.col("n").cast("long").alias("n"), *r("p", "p_holm"), "winner")


@query(f"select model_a, model_b, count(*) filter (won='a') as n_a, count(*) filter (won='b') as n_b, count(*) filter (won='tie') as n_tie from (select *, {_VERDICT.format('p')} as won from ptest) group by 1,2", **_TESTS)
def win_counts(spark, d):
    return compare.win_counts(compare.pair_report(_daily(spark, d), ["variable"], "rmse"))


for _name in ("pair_report", "win_counts"):
    ORACLE[_name] = ORACLE[_name].replace("with ", "with recursive ", 1)


@query("select model, variable, count(*) as n from (select model, init, variable from (select distinct model from a), (select distinct init from a), (select distinct variable from a) except select model, init, variable from a) group by 1,2", a=ARCHIVE)
def completeness(spark, d):
    a = view(spark, d, ARCHIVE)
    declared = a.select("model").distinct().join(a.select("init").distinct(), how="cross").join(a.select("variable").distinct(), how="cross")
    return compare.completeness(a, declared).groupBy("model", "variable").agg(F.count(F.lit(1)).alias("n"))


@query("select model, variable, lead_h, round(value-base,6)+0.0 as delta, case when abs(value-base)<0.005 then 'tie' when value>base then 'win' else 'loss' end as outcome from curve join (select variable, lead_h, value as base from curve where model=0) using (variable, lead_h) where model<>0", curve=_CURVE)
def baseline_deltas(spark, d):
    return compare.baseline_delta(view(spark, d, _CURVE), 0, ["variable", "lead_h"], "value").select("model", "variable", "lead_h", *r("delta"), "outcome")


@query("select variable, model, lead_h, round(value,6)+0.0 as value from (select *, row_number() over (partition by variable order by value desc, model, lead_h) as k from curve) where k<=3", curve=_CURVE)
def worst_three(spark, d):
    return compare.top(view(spark, d, _CURVE), ["variable"], [F.desc("value"), "model", "lead_h"], 3).select("variable", "model", "lead_h", *r("value"))


@query("select p_type, any_value(x) as newest from (select p_type, arg_max(p_name, row(p_retailprice, p_name)) as x from part group by 1) group by 1")
def newest_version(spark, d):
    from ..sources.archive import newest

    part = spark.read.parquet(f"{d}/part.parquet")
    return newest(part, ["p_type"], ["p_retailprice", "p_name"]).select("p_type", F.col("p_name").alias("newest"))


@query("select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v from (select p_partkey as k, 'det' as v from part where p_partkey % 3 = 0) a full join (select p_partkey as k, 'ens' as v from part where p_partkey % 2 = 0) b on a.k=b.k")
def first_available(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"))
    return align.first_available([part.where("k % 3 = 0").withColumn("v", F.lit("det")), part.where("k % 2 = 0").withColumn("v", F.lit("ens"))], ["k"]).select("k", "v")


# --- further tables of reports and audits -------------------------------------


@query("select model, round(100*sqrt(avg(pow(ln(pred/obs),2))),6)+0.0 as log_rms, round(avg(pred/obs),6)+0.0 as mean_ratio, round(100*(avg(pred/obs)-1),6)+0.0 as bias_pct from sp group by 1", sp=SPECTRA)
def pooled_spectrum_error(spark, d):
    return compare.pooled_log_rms(view(spark, d, SPECTRA), ["model"]).select("model", *r("log_rms", "mean_ratio", "bias_pct"))


_BANDS = "select model, band, sum(pred) as pred, sum(obs) as obs from sp join (select * from (values ('1_4',1,4),('5_20',5,20),('21_40',21,40)) t(band,lo,hi)) on wavenumber between lo and hi group by 1,2"


def _bands(spark: SparkSession, d: str) -> DataFrame:
    bands, sp = spectra.band_table(spark, spectra.BANDS[:3]), view(spark, d, SPECTRA)
    return spectra.band_power(sp, ["model"], bands, "pred").join(spectra.band_power(sp, ["model"], bands, "obs"), ["model", "band"])


@query("select model, band, round(pred/obs,6)+0.0 as energy_ratio, round(obs/sum(obs) over w,6)+0.0 as obs_share, round(sum(pred) over w/sum(obs) over w,6)+0.0 as total_ratio from b window w as (partition by model)", sp=SPECTRA, b=_BANDS)
def band_shares(spark, d):
    return compare.band_shares(_bands(spark, d), ["model"]).select("model", "band", *r("energy_ratio", "obs_share", "total_ratio"))


@query("select model, round(max(pred) filter (band='1_4'),4)+0.0 as zonal_pred_1_4, round(max(obs) filter (band='1_4'),4)+0.0 as zonal_obs_1_4, round(max(pred) filter (band='1_4')/max(obs) filter (band='1_4'),6)+0.0 as zonal_ratio_1_4, round(max(pred) filter (band='5_20')/max(obs) filter (band='5_20'),6)+0.0 as zonal_ratio_5_20 from b group by 1", sp=SPECTRA, b=_BANDS)
def band_columns(spark, d):
    out = spectra.band_columns(_bands(spark, d), ["model"], "zonal", spectra.BANDS[:2])
    return out.select("model", tidy("zonal_pred_1_4", 4).alias("zonal_pred_1_4"), tidy("zonal_obs_1_4", 4).alias("zonal_obs_1_4"), *r("zonal_ratio_1_4", "zonal_ratio_5_20"))


@query("select variable from a group by 1 having count(distinct model) = (select count(distinct model) from a)", a=ARCHIVE)
def shared_variables(spark, d):
    return compare.shared_variables(view(spark, d, ARCHIVE), "rmse")


@query("select model, relative_rank, spread_rank, (relative_rank+spread_rank)/2.0 as mean_rank from (select model, rank() over (order by m) as relative_rank, rank() over (order by s desc) as spread_rank from (select model, round(avg(rmse),6) as m, round(stddev_pop(rmse),6) as s from a group by 1))", a=ARCHIVE)
def mean_ranks(spark, d):
    x = view(spark, d, ARCHIVE).groupBy("model").agg(F.round(F.avg("rmse"), 6).alias("relative"), F.round(F.stddev_pop("rmse"), 6).alias("spread"))
    out = compare.ranks(x, {"relative": True, "spread": False})
    return out.select("model", *[F.col(k).cast("long").alias(k) for k in ("relative_rank", "spread_rank")], F.col("mean_rank").cast("double").alias("mean_rank"))


_LAND = "select cast(s_suppkey % 7 as int) as tcid, timestamp '2024-01-01 00:00:00' + cast(s_suppkey as int) * interval 4 hours as obs_time, cast(s_suppkey % 50 as double) as lat, cast(s_suppkey % 90 as double) + 100 as lon from {supplier}"


@query("select t.tcid, t.init, count(*) as n, count(l.lat) as n_matched from (select tcid, init, lead from (select distinct tcid from land), (select unnest([timestamp '2024-01-01 00:00:00', timestamp '2024-01-05 00:00:00']) as init), (select unnest([0,4,8,12,16]) as lead)) t left join land l on l.tcid=t.tcid and l.obs_time = t.init + t.lead * interval 1 hour + interval 8 hours group by 1,2", land=_LAND)
def best_track_match(spark, d):
    land = view(spark, d, _LAND)
    inits = spark.sql("select explode(array(timestamp '2024-01-01 00:00:00', timestamp '2024-01-05 00:00:00')) as init").crossJoin(spark.sql("select explode(array(0D,4D,8D,12D,16D)) as lead_h"))
    t = land.select("tcid").distinct().crossJoin(inits)
    return tropical.match_best_track(t, land, 8).groupBy("tcid", "init").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_matched"))


@query("select tcid, obs_time - interval 8 hours as init from land where extract(hour from obs_time - interval 8 hours)=0 and obs_time - interval 8 hours in (timestamp '2024-01-01 00:00:00', timestamp '2024-01-02 00:00:00', timestamp '2024-01-03 00:00:00')", land=_LAND)
def storm_starts(spark, d):
    inits = spark.sql("select explode(array(timestamp '2024-01-01 00:00:00', timestamp '2024-01-02 00:00:00', timestamp '2024-01-03 00:00:00')) as init")
    return tropical.inits_from_best_track(view(spark, d, _LAND), inits, 8).select("tcid", "init")


@query("select tcid, arg_min(obs_time, row(abs(epoch(obs_time) - epoch(timestamp '2024-01-02 01:30:00')), obs_time)) as obs_time from land group by 1", land=_LAND)
def nearest_record(spark, d):
    land = view(spark, d, _LAND)
    wanted = land.select("tcid").distinct().withColumn("obs_time", F.lit("2024-01-02 01:30:00").cast("timestamp"))
    return tropical.nearest_record(land, wanted).select("tcid", "obs_time")


@query("select variable, lat_i from (select distinct variable, lat_i from fc where model=0 and lead_h=6) except select variable, lat_i from fc where model=1 and lead_h=42", fc=FC)
def pair_faults(spark, d):
    fc = view(spark, d, FC)
    x = align.pair_faults(fc.where("model = 0 and lead_h = 6"), fc.where("model = 1 and lead_h = 42"), ["variable", "lat_i"])
    return x.where("only = 'a'").select("variable", "lat_i")


@query("select w.variable, w.metric from (values ('A','rmse'),('A','acc'),('N','rmse'),('N','acc'),('R','acc')) w(variable,metric) where not (variable='A' and metric='acc')")
def listed_metrics(spark, d):
    wanted = spark.createDataFrame([("A", "rmse"), ("A", "acc"), ("N", "rmse"), ("N", "acc"), ("R", "acc")], "variable string, metric string")
    return deterministic.kept_metrics(wanted, spark.createDataFrame([("A", "rmse"), ("R", "acc")], "variable string, metric string")).select("variable", "metric")


@query("select p.station_id, g.variable, round(g.value,6)+0.0 as value from (select station_id, cast(floor(y) + case when y-floor(y)>0.5 then 1 else 0 end as int) as lat_i, cast(round_even(lon/9.0, 0) as int) % 40 as lon_i from (select *, greatest(0,least(120,(lat+90)/1.5)) as y from pts)) p join g on g.lat_i=p.lat_i and g.lon_i=p.lon_i", g=_GRID, pts=_POINTS)
def station_nearest(spark, d):
    y = F.greatest(F.lit(0.0), F.least(F.lit(120.0), (F.col("lat") + 90) / 1.5))
    at = align.nearest_cell(view(spark, d, _POINTS).withColumn("lat", -90 + 9.0 * y), 121, 40, -90.0, 9.0).select("station_id", "lat_i", "lon_i")
    return view(spark, d, _GRID).join(at, ["lat_i", "lon_i"]).select("station_id", "variable", *r("value"))


@query("select variable, lead_h, round(avg(crps),6)+0.0 as crps, count(distinct init) as n_dates_crps from (select variable, lead_h, init, avg(rmse) as crps from a where model=0 group by 1,2,3) group by 1,2", a=ARCHIVE)
def ensemble_summary(spark, d):
    x = view(spark, d, ARCHIVE).where("model = 0").groupBy("variable", "lead_h", "init").agg(F.avg("rmse").alias("crps")).withColumn("spread_error_ratio", F.lit(1.0))
    return summary.ensemble_summary(x, ["variable", "lead_h"]).select("variable", "lead_h", *r("crps"), "n_dates_crps")


@query("select variable, round(avg(p),6)+0.0 as fa_pred, round(avg(p-o),6)+0.0 as fa_bias, round(avg(p/nullif(o,0)),6)+0.0 as fa_ratio, count(distinct init) as n_dates from (select variable, date_trunc('month',init) as init, sum(fcst) as p, sum(obs) as o from fc group by 1,2) group by 1", fc=FC)
def deterministic_summary(spark, d):
    x = view(spark, d, FC).groupBy("variable", F.date_trunc("month", "init").alias("init")).agg(F.sum("fcst").alias("fa_pred"), F.sum("obs").alias("fa_obs"))
    none = F.lit(None).cast("double")
    x = x.withColumns({"rmse": none, "acc": none, "fa_bias": none, "fa_ratio": none})
    return summary.deterministic_summary(x, ["variable"]).select("variable", *r("fa_pred", "fa_bias", "fa_ratio"), "n_dates")


@query("select variable, lead_h, count(value) as n, round(sum(value),4)+0.0 as value from (select variable, lead_h, case when obs < 45 then fcst end as value from fc) where variable in ('A','R') and lead_h between 12 and 24 group by 1,2", fc=FC)
def pruned_scan(spark, d):
    """Cells of two variables and some leads: the scan reads what is asked for, and fill values are missing."""
    path = f"{scratch(spark)}/cells"
    fill = F.when(F.col("obs") < 45, F.col("fcst")).otherwise(9.9e30)
    view(spark, d, FC).select("variable", "lead_h", "lat_i", "lon_i", fill.alias("value")).write.parquet(path)
    x = gridded.cells(spark, path, ["A", "R"], (12, 24))
    return x.groupBy("variable", "lead_h").agg(F.count("value").alias("n"), tidy(F.sum("value"), 4).alias("value"))


# --- tests of pairs, the chained search, and compatible forms -----------------

_DAILYRMSE = f"select model, variable, init, avg(rmse) as rmse from ({ARCHIVE}) a group by 1, 2, 3"


@query("select x.variable, x.model as model_a, y.model as model_b, round(avg(x.rmse),6)+0.0 as mean_a, round(avg(y.rmse),6)+0.0 as mean_b, round(100*(avg(x.rmse)-avg(y.rmse))/avg(y.rmse),6)+0.0 as delta_pct, count(*) filter (x.rmse<>y.rmse) as n from s x join s y on x.variable=y.variable and x.init=y.init and x.model<y.model group by 1,2,3", s=_DAILYRMSE)
def pair_deltas(spark, d):
    out = compare.pair_report(view(spark, d, _DAILYRMSE), ["variable"], "rmse")
    return out.select("variable", "model_a", "model_b", *r("mean_a", "mean_b", "delta_pct"), "n")


_PVALUES = f"select variable, lead_h, model, case when model = 3 then null else avg(abs(fcst - obs)) / 1000 * lead_h end as p from ({FC}) f group by 1, 2, 3"


@query("select variable, lead_h, model, round(p,9)+0.0 as p, round(case when p is not null then least(1, max(raw) over (partition by variable, p is null order by p rows unbounded preceding)) end,9)+0.0 as p_holm from (select *, (count(p) over (partition by variable) - row_number() over (partition by variable, p is null order by p) + 1) * p as raw from t)", t=_PVALUES)
def holm_correction(spark, d):
    return holm(view(spark, d, _PVALUES), ["variable"]).select("variable", "lead_h", "model", tidy("p", 9).alias("p"), tidy("p_holm", 9).alias("p_holm"))


_BOX = f"select model as tcid, lead_h, lat, lon, avg(fcst) as msl from ({FC}) f where lat between -30 and 30 and lon between 100 and 200 group by 1, 2, 3, 4"
_STARTS = "select tcid, arg_min(lat, row(msl,lat,lon)) as la, arg_min(lon, row(msl,lat,lon)) as lo, null::double as lead_h, null::double as pmin from b where lead_h=6 group by 1"


def _step(k: int) -> str:
    half = 4 if 6 * k <= 12 else 3
    near = f"abs(b.lat-s.la)<={half} and abs((b.lon-s.lo+180)-360*floor((b.lon-s.lo+180)/360)-180)<={half}"
    pick = lambda x: f"arg_min(b.{x}, row(b.msl,b.lat,b.lon))"
    return f"select s.tcid, coalesce({pick('lat')}, any_value(s.la)) as la, coalesce({pick('lon')}, any_value(s.lo)) as lo, case when min(b.msl) is not null then {6 * k}::double end as lead_h, min(b.msl) as pmin from s{k - 1} s left join b on b.tcid=s.tcid and b.lead_h={6 * k} and {near} group by 1"


@query(" union all ".join(f"select tcid, lead_h, la as plat, lo as plon, round(pmin,6)+0.0 as pmin from s{k} where lead_h is not null" for k in range(1, 8)), b=_BOX, s0=_STARTS, **{f"s{k}": _step(k) for k in range(1, 8)})
def storm_search(spark, d):
    """Each lead looks around the centre of the lead before; a lead without a cell there keeps the centre."""
    cells = view(spark, d, _BOX)
    starts = cells.where("lead_h = 6").groupBy("tcid").agg(F.min_by("lat", F.struct("msl", "lat", "lon")).alias("lat"), F.min_by("lon", F.struct("msl", "lat", "lon")).alias("lon"))
    return tropical.track_storms(cells, starts).select("tcid", "lead_h", "plat", "plon", *r("pmin"))


_GAPS = f"select model, variable, lat, case when lat_i % 5 <> 0 then fcst end as fcst, case when lon_i % 7 <> 0 then obs end as obs, 20.0 + lat_i % 7 as clim from ({CELLS}) x"
_JOINT = "sum(case when fcst is not null and obs is not null then w end)"


def _activity(side: str) -> str:
    return f"round(sqrt(greatest(sum(w*pow({side}-clim,2))/{_JOINT}-pow(sum(w*({side}-clim))/{_JOINT},2),0)),5)+0.0"


@query(f"select model, variable, {_activity('fcst')} as fa_pred, {_activity('obs')} as fa_obs from (select *, {W} as w from g) group by 1,2", g=_GAPS)
def published_activity(spark, d):
    """Sums over one side alone, weights over cells of both."""
    out = deterministic.anomaly_scores(view(spark, d, _GAPS), ["model", "variable"], compat=True)
    return out.select("model", "variable", tidy("fa_pred", 5).alias("fa_pred"), tidy("fa_obs", 5).alias("fa_obs"))


@query("""select variable, count(value) as n, round(avg(value),6)+0.0 as value from (select p.station_id, g.variable, case when count(g.value)=4 then sum(g.value*wt) end as value from
  (select station_id, i+a as lat_i, cast(j as int)+b as lon_i, (case a when 1 then y-i else 1-(y-i) end)*(case b when 1 then x-j else 1-(x-j) end) as wt from
   (select station_id, y, x, cast(least(floor(y),119) as int) as i, cast(least(floor(x),38) as int) as j from (select station_id, greatest(0,least(120,(lat+90)/1.5)) as y, lon/9.0 as x from pts) where x between 0 and 39), (select unnest([0,1]) as a), (select unnest([0,1]) as b)) p
  join g on g.lat_i=p.lat_i and g.lon_i=p.lon_i group by 1,2) group by 1""", g=_GRID, pts=_POINTS)
def station_bilinear_regional(spark, d):
    """A regional grid does not wrap: stations beyond its columns have no value."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(120.0), (F.col("lat") + 90) / 1.5))
    scaled = view(spark, d, _POINTS).withColumn("lat", -90 + 9.0 * y)
    w = align.corner_weights(scaled, 121, 40, -90.0, 9.0, wrap=False)
    out = align.to_stations(view(spark, d, _GRID), w, ["variable"], "value")
    return out.groupBy("variable").agg(F.count("value").alias("n"), tidy(F.avg("value")).alias("value"))


@query("select model, variable, max(case when k>=n-1 then abs(dv) end) < 20 as plateau, count(*) filter (dv > 0.005) as n_rises, min(lead_h) filter (value < 40) as first_below from (select *, value - lag(value) over w as dv, row_number() over w as k, count(*) over (partition by model, variable) as n from curve window w as (partition by model, variable order by lead_h)) group by 1,2", curve=_CURVE)
def curve_plateaus(spark, d):
    out = summary.curve_changes(view(spark, d, _CURVE), ["model", "variable"], "value", eps=20.0, floor=40.0)
    rises = summary.curve_changes(view(spark, d, _CURVE), ["model", "variable"], "value").select("model", "variable", "n_rises")
    return out.select("model", "variable", "plateau", "first_below").join(rises, ["model", "variable"])


@query("select x.model as model_a, y.model as model_b, count(distinct x.variable) as n_variables from s x join s y on x.variable=y.variable and x.init=y.init and x.model<y.model group by 1,2", s=_DAILYRMSE)
def win_totals(spark, d):
    """Wins, losses and ties of each pair add up to the variables."""
    out = compare.win_counts(compare.pair_report(view(spark, d, _DAILYRMSE), ["variable"], "rmse"))
    return out.select("model_a", "model_b", (F.col("n_a") + F.col("n_b") + F.col("n_tie")).alias("n_variables"))
