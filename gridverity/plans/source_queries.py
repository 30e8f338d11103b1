"""Registered queries of sources, sinks, scalar rules and report tables, with the same question in SQL.

Text formats are written to the shared scratch folder from the tables, and read back.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import tidy
from ..operators import align, categorical, compare, packed, report, summary
from ..session import scratch
from ..sources import archive, gridded, netcdf, station_text
from .queries import query, r
from .views import ARCHIVE, CELLS, FC, HOURS, SPECTRA, view

# --- scalar rules -------------------------------------------------------------

_METRICS = f"select variable, case lead_h when 6 then 'rmse' when 12 then 'crps' when 18 then 'spectrum' when 24 then 'zonal_pred_1_4' when 30 then 'brier' when 36 then 'fa_bias' else 'acc' end as metric, avg(fcst) as value from ({FC}) f group by 1, 2"


@query("select variable, metric, round(value * case when variable in ('A','R') and metric in ('rmse','crps','fa_bias') then 1e3 when variable in ('A','R') and metric in ('spectrum','zonal_pred_1_4') then 1e6 else 1 end,4)+0.0 as value from m", m=_METRICS)
def humidity_report(spark, d):
    x = view(spark, d, _METRICS)
    return x.select("variable", "metric", tidy(c.humidity_report("metric", "variable", "value", ("A", "R")), 4).alias("value"))


_UNITS = f"""select case model when 0 then 'z500' when 1 then 't2m' when 2 then 'msl' else 'tp' end as v,
 case variable when 'A' then case model when 0 then 'm**2 s**-2' when 1 then 'C' when 2 then 'hPa' else 'mm/s' end when 'R' then '' else 'mm' end as u, lead_h, fcst as x,
 avg(fcst) over (partition by model, variable) as m from ({FC}) f"""


@query("""select v, u, lead_h, count(*) as n, round(sum(case when v='z500' and (u='m**2 s**-2' or u='' and m>10000) then x/9.80665 when v='t2m' and (u='C' or u='' and m<100) then x+273.15 when v='msl' and (u='hPa' or u='' and m between 800.0001 and 1499.9999) then x*100
 when v='tp' and u='mm/s' then x*lead_h*3600 when v='tp' and u='' and m<0.01 then x*lead_h*3600 else x end),3)+0.0 as x from units group by 1,2,3""", units=_UNITS)
def standard_units(spark, d):
    x = view(spark, d, _UNITS).withColumn("y", c.to_standard_unit("v", "u", "x", "m", "lead_h"))
    return x.groupBy("v", "u", "lead_h").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("y"), 3).alias("x"))


_SPELT = "select o_orderkey, o_orderdate, cast(o_orderkey % 7 as int) as kind from {orders}"


@query("select kind, count(*) as n, count(t) as n_read, cast(max(t) as date) as last from (select kind, case when kind < 6 then o_orderdate end as t from s) group by 1", s=_SPELT)
def parsed_times(spark, d):
    x = view(spark, d, _SPELT)
    spell = F.lit("none of these")
    for k, f in enumerate(c.INIT_FORMATS[:6]):
        spell = F.when(F.col("kind") == k, F.date_format("o_orderdate", f)).otherwise(spell)
    x = x.withColumn("t", c.init_time(spell))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("n_read"), F.to_date(F.max("t")).alias("last"))


@query("select unit, count(*) as n, round(avg(h),4)+0.0 as hours, max(t) as last from (select unit, x/per as h, timestamp '1992-01-01' + to_hours(cast(x/per as bigint)) as t from (select l_linenumber*3600.0 as x, l_linenumber % 4 as k from lineitem) join (select * from (values (0,'seconds since 1992-01-01 00:00:00',3600.0),(1,'minutes since 1992-01-01',60.0),(2,'hours since 1992-01-01T00:00:00',1.0),(3,'days since 1992-01-01 00:00',1/24.0)) t(k,unit,per)) using (k)) group by 1")
def time_axes(spark, d):
    units = ["seconds since 1992-01-01 00:00:00", "minutes since 1992-01-01", "hours since 1992-01-01T00:00:00", "days since 1992-01-01 00:00"]
    x = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") * 3600.0).alias("x"), F.element_at(F.array(*map(F.lit, units)), F.col("l_linenumber") % 4 + 1).alias("unit"))
    return x.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(c.hours_from_unit("x", "unit")), 4).alias("hours"), F.max(c.time_from_unit("x", "unit")).alias("last"))


@query("select l_linenumber as threshold_i, '≥' || case when l_linenumber % 2 = 0 then cast(l_linenumber // 2 as varchar) else cast(l_linenumber / 2 as varchar) end as grade, l_linenumber / 2 as threshold, 7 * l_linenumber as week from (select distinct l_linenumber from lineitem)")
def labels_parsed(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber").distinct()
    x = x.withColumn("grade", c.grade_label(F.col("l_linenumber") / 2)).withColumn("label", F.concat(F.lit("week "), F.col("l_linenumber") * 7, F.lit(" of 11")))
    return x.select(F.col("l_linenumber").alias("threshold_i"), "grade", c.grade_threshold("grade").alias("threshold"), c.week_number("label").alias("week"))


@query("select model, case when lo>=1 and hi<=120 then 1 else 0 end as base from (select model, min(lead_h)/6-model%2 as lo, max(lead_h)/6-model%2 as hi from fc group by 1)", fc=FC)
def lead_index_base(spark, d):
    x = view(spark, d, FC).groupBy("model").agg((F.min("lead_h") / 6 - F.col("model") % 2).alias("lo"), (F.max("lead_h") / 6 - F.col("model") % 2).alias("hi"))
    return x.select("model", c.lead_index_base("lo", "hi").alias("base"))


_AXES = f"select model, cast(lon_i as int) as i, case when model = 0 and lon_i = 239 then 360.0 else cast(lon_i as double) * 1.5 end as lon, lat, case model when 3 then 40 else 1 end as f from ({FC}) f"


@query("select model, first, last, first<0.5 and abs(last-360)<0.5 as broken, round(avg(case when first<0.5 and abs(last-360)<0.5 then i*1.5 else lon end),6)+0.0 as lon from (select *, min(lon) over (partition by model) as first, max(lon) over (partition by model) as last from a) group by 1,2,3", a=_AXES)
def longitude_headers(spark, d):
    x = view(spark, d, _AXES)
    head = x.groupBy("model").agg(F.min("lon").alias("first"), F.max("lon").alias("last"), F.count_distinct("i").alias("n"))
    head = head.withColumn("broken", c.header_is_broken("first", "last", "n", F.lit(1.5), 1.4, 1.6))
    y = x.join(head, "model").withColumn("fixed", c.repaired_lon("i", "lon", "broken", 1.5))
    return y.groupBy("model", "first", "last", "broken").agg(tidy(F.avg("fixed")).alias("lon"))


@query("select model, lo, hi, n from (select model, min(lat*f) as lo, max(lat*f) as hi, count(distinct lat*f) as n from a group by 1) where lo < -90 or hi > 90 or (hi-lo)/nullif(n-1,0) < 0.005", a=_AXES)
def latitude_faults(spark, d):
    x = view(spark, d, _AXES).withColumn("lat", F.col("lat") * F.col("f"))
    out = None
    for m in range(4):
        part = gridded.latitude_faults(x.where(F.col("model") == m)).withColumn("model", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "lo", "hi", "n")


_STEPS = f"select distinct variable, case when variable = 'A' and lead_h > 18 then lead_h + 3.5 else lead_h end as lead_h from ({FC}) f"


@query("select * from (select variable, lead_h, lead_h - lag(lead_h) over (partition by variable order by lead_h) as step from s) where step is not null and step not in (1,3,6,12,24)", s=_STEPS)
def lead_step_faults(spark, d):
    return gridded.lead_step_faults(view(spark, d, _STEPS)).select("variable", "lead_h", "step")


@query("select lat_i, lon_i, count(*) as n, round(avg(fcst),6)+0.0 as fcst from fc group by 1,2", fc=FC)
def aligned_cells(spark, d):
    """One model's rows from the north, one's from -180 degrees: keys follow from the places."""
    x = view(spark, d, FC).drop("lat_i", "lon_i").withColumn("lon", F.when((F.col("model") == 1) & (F.col("lon") >= 180), F.col("lon") - 360).otherwise(F.col("lon")))
    x = gridded.aligned_cells(x, -90.0, 1.5, 121, 240)
    return x.groupBy("lat_i", "lon_i").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("fcst")).alias("fcst"))


@query("select variable from (select variable from fc where model=0 intersect select variable from fc where model=1) where variable in ('A','R') union all select 'ws'", fc=FC)
def chosen_variables(spark, d):
    x = view(spark, d, FC).where("model in (0, 1)").groupBy("model").agg(F.collect_set("variable").alias("v")).collect()  # a few names
    names = gridded.chosen_variables(["A", "R", "ws", "tp"], [r.v for r in x], {"ws": ("A", "R")})
    return spark.createDataFrame([(n,) for n in names], "variable string")


@query("select cast(x as date) as day, strftime(x, '%Y%m%d') || '12' as stamp from (select unnest(generate_series((select min(o_orderdate) from orders), (select max(o_orderdate) from orders), interval 1 day)) as x)")
def expanded_dates(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return x.select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("stamp", F.concat(F.date_format("day", "yyyyMMdd"), F.lit("12")))


# --- text formats -------------------------------------------------------------


def _text(spark: SparkSession, lines: DataFrame, folder: str, *order: str) -> str:
    """Lines (file, line) as one text for each file, in a folder of its name."""
    path = f"{scratch(spark)}/{folder}"
    lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line").write.partitionBy("file").text(path)
    return path


_RAIN = f"select station_id, obs_time, round(rain, 3) as rain from ({HOURS}) h"


def _hour_files(spark: SparkSession, d: str, damage: bool = False) -> str:
    x = view(spark, d, _RAIN).withColumn("file", F.date_format("obs_time", "yyyyMMddHH"))
    line = F.format_string("%d %.2f %.2f 10 %.3f", F.col("station_id") + 50000, F.col("station_id") + 100.25, F.col("station_id") + 20.5, F.col("rain"))
    if damage:  # every fifth station's amount is no number
        line = F.when(F.col("station_id") % 5 == 0, F.concat(F.col("station_id").cast("string"), F.lit(" 1 2 3 nothing"))).otherwise(line)
    rows = x.select("file", F.lit(2).alias("n"), "station_id", line.alias("line"))
    heads = x.groupBy("file").agg(F.count(F.lit(1)).alias("count"), F.min("obs_time").alias("t"))
    first = heads.select("file", F.lit(0).alias("n"), F.lit(0).cast("long").alias("station_id"), F.lit("diamond 3 hourly rain").alias("line"))
    second = heads.select("file", F.lit(1).alias("n"), F.lit(0).cast("long").alias("station_id"), F.concat(F.date_format("t", "yy MM dd HH"), F.lit(" 0 1 0 "), F.col("count").cast("string")).alias("line"))
    return _text(spark, first.unionByName(second).unionByName(rows), "hours", "n", "station_id")


@query("select station_id + 50000 as station_id, count(*) as n, round(sum(rain),3)+0.0 as rain, max(obs_time) as last from rain group by 1", rain=_RAIN)
def hourly_stations(spark, d):
    x = station_text.hourly_stations(spark, _hour_files(spark, d))
    return x.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("rain"), 3).alias("rain"), F.max("obs_time").alias("last"))


@query("select station_id + 50000 as station_id, count(*) as n, round(sum(rain),3)+0.0 as rain from rain where station_id % 5 <> 0 group by 1", rain=_RAIN)
def lenient_stations(spark, d):
    x = station_text.hourly_stations(spark, _hour_files(spark, d, damage=True), strict=False)
    return x.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("rain"), 3).alias("rain"))


@query("select distinct obs_time from rain", rain=_RAIN)
def station_files(spark, d):
    return station_text.station_index(spark, _hour_files(spark, d)).select("obs_time")


@query("select station_id, count(*) as n from rain where station_id in (1,3,8) group by 1", rain=_RAIN)
def listed_stations(spark, d):
    lines = spark.createDataFrame([("list", f"{i} name of station {i}") for i in (1, 3, 8)] + [("list", "no number")], "file string, line string")
    listed = station_text.whitelist(spark, _text(spark, lines, "list", "line"))
    return station_text.keep_listed(view(spark, d, _RAIN), listed).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query("select station_id, count(*) as n, count(*) filter (station_id % 3 <> 0) as n_found, round(avg(case when station_id % 3 <> 0 then round(station_id/20.0,3) end),6)+0.0 as p, round(avg(case when station_id % 3 <> 0 then round(station_id/20.0,3) else 0 end),6)+0.0 as p0 from rain group by 1", rain=_RAIN)
def reference_probabilities(spark, d):
    x = view(spark, d, _RAIN)
    file = F.concat(F.date_format("obs_time", "MMddHH"), F.lit(".000"))
    p = F.col("station_id") / 20.0
    line = F.format_string("%d %.3f %.3f %.3f %.3f", "station_id", p, p / 2, p / 4, p / 8)
    lines = x.where("station_id % 3 <> 0").select(file.alias("file"), "station_id", line.alias("line")).distinct()
    both = station_text.with_reference(x, station_text.reference_probabilities(spark, _text(spark, lines, "ref", "station_id")), "obs_time")
    p = F.get("probs", F.lit(0))
    return both.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count("probs").alias("n_found"), tidy(F.avg(p)).alias("p"), tidy(F.avg(F.coalesce(p, F.lit(0.0)))).alias("p0"))


_BEST = "select cast(o_custkey % 20 as int) as storm, cast(o_orderdate as date) as day, avg(o_totalprice) as price from {orders} group by 1, 2"


@query("select 'T' || lpad(cast(storm as varchar),2,'0') as tcid, count(*) as n, cast(min(day) as timestamp) as first, round(avg(round(10+storm/2.0,1)),4)+0.0 as lat, round(avg(round(price/1000,1)),2)+0.0 as pmin from b group by 1", b=_BEST)
def best_tracks(spark, d):
    x = view(spark, d, _BEST).withColumn("file", F.concat(F.lit("storm"), F.col("storm").cast("string")))
    time = F.date_format("day", "yyyy MM dd 00")
    row = lambda lead, lat: F.concat(time, F.format_string(" %s 120.5 %.1f %.1f 30", F.lit(lead), lat, F.round(F.col("price") / 1000, 1)))
    rows = x.select("file", F.lit(3).alias("n"), "day", row("000", F.col("storm") / 2.0 + 10).alias("line"))
    ahead = x.select("file", F.lit(3).alias("n"), "day", row("024", F.lit(-99.0)).alias("line"))  # a forecast, to be left out
    head = x.select("file", "storm").distinct()
    heads = [head.select("file", F.lit(n).alias("n"), F.lit(None).cast("date").alias("day"), t.alias("line")) for n, t in enumerate((F.lit("diamond 7 track"), F.format_string("NAME T%02d", "storm"), F.lit("0 0 0")))]
    lines = rows.unionByName(ahead)
    for h in heads:
        lines = lines.unionByName(h)
    got = station_text.best_track(spark, _text(spark, lines, "best", "n", "day"))
    return got.groupBy("tcid").agg(F.count(F.lit(1)).alias("n"), F.min("obs_time").alias("first"), tidy(F.avg("lat"), 4).alias("lat"), tidy(F.avg("pmin_hpa"), 2).alias("pmin"))


# --- trees, layouts and resolution --------------------------------------------

_PATHS = "select o_orderkey, o_orderdate, '/data/' || replace(substr(cast(o_orderdate as string), 1, 10), case when o_orderkey % 2 = 0 then '-' else '#' end, '') || '/' || case when o_orderkey % 3 = 0 then '' else concat('member_00', cast(o_orderkey % 3 as string), '/') end || lpad(cast(o_orderkey % 9 + 1 as string), 3, '0') || '.nc' as path from {orders}"


@query("select cast(o_orderdate as date) as init, case when o_orderkey % 3 = 0 then 'det' else 'member_00' || cast(o_orderkey % 3 as varchar) end as member, cast(6 + (o_orderkey % 9) * 6 as double) as lead_h, count(*) as n from orders group by 1,2,3")
def file_trees(spark, d):
    x = gridded.file_tree(view(spark, d, _PATHS))
    return x.groupBy(F.to_date("init").alias("init"), "member", "lead_h").agg(F.count(F.lit(1)).alias("n"))


@query("select member, count(*) as n, count(distinct day) as n_days from (select case when o_orderkey % 3 = 0 then 'det' else 'member_00' || cast(o_orderkey % 3 as varchar) end as member, cast(o_orderdate as date) as day from orders) where day between date '1995-01-01' and date '1995-12-31' and member like '%1' group by 1")
def dated_members(spark, d):
    x = gridded.between_dates(gridded.file_tree(view(spark, d, _PATHS)), "1995-01-01", "1995-12-31").where(F.col("member").endswith("1"))
    return x.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("init")).alias("n_days"))


_SMALL = f"select init, lead_h, variable, avg(fcst) as value from ({FC}) f where model = 0 group by 1, 2, 3"


@query("select case variable when 'A' then 'u10m' else variable end as variable, count(*) as n, round(sum(value),4)+0.0 as value from s where (variable = 'A' or variable = 'R') and exists (select 1 from s a where a.variable='A' and a.init=s.init and a.lead_h=s.lead_h) and exists (select 1 from s b where b.variable='R' and b.init=s.init and b.lead_h=s.lead_h) group by 1", s=_SMALL)
def two_families(spark, d):
    x = view(spark, d, _SMALL)
    both = gridded.two_families(x.where("variable = 'A'"), x.where("variable = 'R'"), {"A": "u10m"})
    return both.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 4).alias("value"))


@query("select variable, count(value) as n, round(sum(value),4)+0.0 as value from s group by 1", s=_SMALL)
def dual_layout(spark, d):
    """Half of the starts in rows, half with a column for each variable."""
    x = view(spark, d, _SMALL)
    even = F.month("init") % 2 == 0
    wide = x.where(~even).groupBy("init", "lead_h").pivot("variable", ["A", "N", "R"]).agg(F.first("value"))
    both = gridded.dual_layout(x.where(even)).unionByName(gridded.dual_layout(wide))
    return both.groupBy("variable").agg(F.count("value").alias("n"), tidy(F.sum("value"), 4).alias("value"))


@query("select variable, round(sum(case when variable='N' then exp(least(7,greatest(0,value/10)))-1 else value*2+5 end),4)+0.0 as value, count(*) as n from s group by 1", s=_SMALL)
def standardised(spark, d):
    x = view(spark, d, _SMALL).withColumn("name", F.when(F.col("variable") == "N", "tp").otherwise(F.col("variable")))
    std, mean = F.when(F.col("name") == "tp", 0.1).otherwise(2.0), F.when(F.col("name") == "tp", 0.0).otherwise(5.0)
    y = x.withColumn("y", gridded.standardised(F.col("value"), mean, std, F.col("name")))
    return y.groupBy("variable").agg(tidy(F.sum("y"), 4).alias("value"), F.count("y").alias("n"))


_KEYED = f"select init, variable as short_name, cast(lead_h as int) as level, avg(obs) - 26 as value from ({FC}) f where model = 1 group by 1, 2, 3"


@query("select short_name, level, count(*) as n, round(sum(value),4)+0.0 as value from (select *, case when short_name='R' and level=12 then 0 when short_name='A' then 1 when level=6 then 2 end as k, min(case when short_name='R' and level=12 then 0 when short_name='A' then 1 when level=6 then 2 end) over (partition by init) as best from t) where k=best group by 1,2", t=_KEYED)
def first_keys(spark, d):
    x = gridded.first_key(view(spark, d, _KEYED), [("R", 12), ("A", None), (None, 6)], by=["init"])
    return x.groupBy("short_name", "level").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 4).alias("value"))


@query("select short_name, count(*) as n, round(sum(greatest(value,0)),4)+0.0 as value from (select *, min(case short_name when 'N' then 0 when 'A' then 1 end) over (partition by init, level) as best from t) where case short_name when 'N' then 0 when 'A' then 1 end = best group by 1", t=_KEYED)
def rain_truth(spark, d):
    x = gridded.rain_truth(view(spark, d, _KEYED), [("N", None), ("A", None)], by=["init", "level"])
    return x.groupBy("short_name").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 4).alias("value"))


_FILES = "select cast(l_suppkey % 4 as int) as model, l_orderkey as init, cast(l_linenumber as int) as lead_h, l_partkey, l_shipdate, concat('m', cast(l_linenumber as string), '.nc') as name, concat('/d/', case when l_partkey % 3 = 2 then 'ens/' else 'det/' end, case when l_partkey % 3 = 1 then 'x_' else '' end, 'm', cast(l_linenumber as string), case when l_partkey % 3 = 1 then '_old.nc' when l_partkey % 3 = 2 then concat('_', cast(l_partkey as string), '.nc') else '.nc' end) as path from {lineitem}"


@query("select source, count(*) as n, count(distinct init) as n_starts from (select *, rank() over (partition by model, init, lead_h order by k) as r, row_number() over (partition by model, init, lead_h order by k, path) as one from (select *, case l_partkey % 3 when 0 then 0 when 1 then 1 else 2 end as k, case l_partkey % 3 when 0 then 'exact' when 1 then 'loose' else 'members' end as source from f)) where r=1 and (k=2 or one=1) group by 1", f=_FILES)
def resolved_files(spark, d):
    return gridded.resolved_files(view(spark, d, _FILES)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("init").alias("n_starts"))


_MODEL = f"select model, init, lead_h, case variable when 'A' then 'z' else variable end as variable, lat, avg(fcst) * 2000 as value from ({FC}) f group by 1, 2, 3, 4, 5"


@query("select model, lat_i, count(*) as n, round(sum(case when m>10000 then value/9.80665 else value end),3)+0.0 as value from (select *, avg(value) over (partition by model, init, lead_h) as m, cast(dense_rank() over (partition by model, init, lead_h order by lat desc)-1 as int) as lat_i from t where variable='z') group by 1,2", t=_MODEL)
def model_fields(spark, d):
    x = gridded.model_field(view(spark, d, _MODEL), "z500", "z")
    return x.groupBy("model", "lat_i").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 3).alias("value"))


@query("select variable, slot, round(value,6)+0.0 as value from (select variable, cast(month(init) as int)-1 as slot, avg(obs) as value from fc group by 1,2)", fc=FC)
def climatology_layouts(spark, d):
    x = view(spark, d, FC).groupBy("variable", (F.month("init") - 1).alias("slot")).agg(F.avg("obs").alias("value"))
    wide = x.where("variable <> 'A'").groupBy("slot").pivot("variable", ["N", "R"]).agg(F.first("value"))
    return gridded.climatology_layouts([x.where("variable = 'A'"), wide]).where("value is not null").select("variable", "slot", *r("value"))


@query("select cast(l_linenumber as int) as lead, count(*) as n, round(avg(l_quantity),6)+0.0 as value from lineitem group by 1")
def structure_checks(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("STEP"), F.col("l_quantity").alias("Rain"), "l_tax")
    x = gridded.structured(x, {"lead": ("step", "lead_time"), "value": ("data", "rain")})
    return x.groupBy(F.col("lead").cast("int").alias("lead")).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("value")).alias("value"))


@query("select how, count(*) as n, count(value) as n_there from (select 'nan' as how, v.value from days left join v using (day) union all select 'skip', v.value from days join v using (day)) group by 1",
 days="select unnest(generate_series((select min(o_orderdate) from orders), (select max(o_orderdate) from orders), interval 1 day))::date as day", v="select cast(o_orderdate as date) as day, avg(o_totalprice) as value from orders where month(o_orderdate) <> 2 group by 1")
def calendar_scans(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    days = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    files = o.where("month(day) <> 2").groupBy("day").agg(F.avg("o_totalprice").alias("value"))
    both = archive.tagged({"nan": gridded.calendar_scan(days, files, ["day"], False), "skip": gridded.calendar_scan(days, files, ["day"], True)}, "how")
    return both.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_there"))


_GRIDH = "select cast(user_id % 7 as int) as lat_i, date_trunc('hour', ts) as obs_time, sum(value) - 40 as rain from {events} group by 1, 2"


@query("select lat_i, hour_end, sum(case when rain>0 then rain else 0 end) as total_x, round(sum(greatest(rain,0)),4)+0.0 as total, count(*) as n_found, 6-count(*) as n_missing from (select g.lat_i, e.hour_end, g.rain from (select distinct date_trunc('day', obs_time) + interval 12 hour as hour_end from g) e join g on g.obs_time <= e.hour_end and g.obs_time > e.hour_end - interval 6 hour) group by 1,2".replace("sum(case when rain>0 then rain else 0 end) as total_x, ", ""), g=_GRIDH)
def hourly_sums(spark, d):
    x = view(spark, d, _GRIDH)
    ends = x.select((F.date_trunc("day", "obs_time") + F.expr("interval 12 hours")).alias("end")).distinct()
    out = categorical.hourly_sums(x, ends, 6, ["lat_i"])
    return out.select("lat_i", F.col("end").alias("hour_end"), tidy("total", 4).alias("total"), "n_found", F.col("n_missing").cast("long").alias("n_missing"))


@query("select lat_i, lon_i, round(greatest(rain,0),4)+0.0 as rain from (select lat_i, lon_i, arg_min(s_suppkey, row(pow(lat-la,2)+pow(lon-lo,2), s_suppkey)) as id from (select i as lat_i, j as lon_i, 20+i*2.0 as lat, 100+j*2.0 as lon from (select unnest(range(10)) as i), (select unnest(range(12)) as j)), (select s_suppkey, 20 + cast(s_suppkey*37 % 180 as double)/10 as la, 100 + cast(s_suppkey*53 % 230 as double)/10 as lo from supplier) group by 1,2) join (select s_suppkey as id, s_acctbal/100 as rain from supplier) using (id)")
def stations_to_grid(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    st = s.select(F.col("s_suppkey").alias("station_id"), (F.lit(20) + (F.col("s_suppkey") * 37 % 180).cast("double") / 10).alias("lat"), (F.lit(100) + (F.col("s_suppkey") * 53 % 230).cast("double") / 10).alias("lon"), (F.col("s_acctbal") / 100).alias("rain"))
    grid = spark.range(120).select((F.col("id") / 12).cast("int").alias("lat_i"), (F.col("id") % 12).cast("int").alias("lon_i"))
    grid = grid.select("lat_i", "lon_i", (F.col("lat_i") * 2.0 + 20).alias("lat"), (F.col("lon_i") * 2.0 + 100).alias("lon"))
    return align.to_grid(st.select("station_id", "rain"), align.nearest_stations(grid, st), "rain").select("lat_i", "lon_i", tidy("rain", 4).alias("rain"))


# --- array files --------------------------------------------------------------

_CUBE = f"select model, cast(lead_h as int) as lead_h, variable, cast(lat_i % 12 as int) as lat_i, cast(lon_i % 24 as int) as lon_i, avg(fcst) as value from ({FC}) f group by 1, 2, 3, 4, 5"


def _cube(spark: SparkSession, d: str) -> np.ndarray:
    """(model, lead, variable, lat, lon) of the demonstration's forecasts on a grid of fixed size; NaN where there is nothing."""
    out = np.full((4, 7, 3, 12, 24), np.nan)
    for x in view(spark, d, _CUBE).collect():  # the grid's cells at most
        out[x.model, x.lead_h // 6 - 1, "ANR".index(x.variable), x.lat_i, x.lon_i] = x.value
    return out


_LAT = (("lat",), {"units": "degrees_north"}, np.arange(12) * 15.0 - 82.5)
_LON = (("lon",), {"units": "degrees_east"}, np.arange(24) * 15.0)


@query("select variable, 'member_00' || cast(model as varchar) as member, cast(lead_h as double) as lead_h, count(value) as n, round(sum(value*(lat_i*15-82.5+lon_i)),3)+0.0 as value from c where model in (1,3) group by 1,2,3", c=_CUBE)
def netcdf_tree(spark, d):
    """A file for each member and lead, with a variable for each field; two members are read."""
    cube, root = _cube(spark, d), scratch(spark)
    for m in range(4):
        for k in range(7):
            fields = {v: (("lat", "lon"), {}, cube[m, k, i]) for i, v in enumerate("ANR")}
            netcdf.put(spark, f"{root}/20240101/member_00{m}/{k + 1:03d}.nc", netcdf.write_classic({"lat": 12, "lon": 24}, {"lat": _LAT, "lon": _LON, **fields}))
    x = netcdf.forecast_tree(spark, root, step=15.0, members=["1", "3"])
    return x.groupBy("variable", "member", "lead_h").agg(F.count("value").alias("n"), tidy(F.sum(F.col("value") * (F.col("lat") + F.col("lon_i"))), 3).alias("value"))


@query("select variable, timestamp '2024-01-01' + to_hours(lead_h) as valid, count(value) as n, round(sum(value*lon_i*15),3)+0.0 as value from c group by 1,2", c=_CUBE)
def netcdf_cubes(spark, d):
    """A cube for each model, its fields along a level axis and its times in hours since an epoch; missing cells hold a fill value."""
    cube, root = _cube(spark, d), scratch(spark)
    for m in range(4):
        data = np.where(np.isnan(cube[m]), 9.96e36, cube[m])
        time = (("time",), {"units": "hours since 2024-01-01 00:00:00"}, np.arange(1, 8) * 6.0)
        level = (("level", "chars"), {}, np.array([list("A "), list("N "), list("R ")], "S1"))
        netcdf.put(spark, f"{root}/model{m}.nc", netcdf.write_classic({"time": 7, "level": 3, "lat": 12, "lon": 24, "chars": 2}, {"time": time, "level": level, "lat": _LAT, "lon": _LON, "data": (("time", "level", "lat", "lon"), {}, data)}))
    x = netcdf.classic_files(spark, root, 15.0)
    return x.groupBy("variable", F.col("time").alias("valid")).agg(F.count("value").alias("n"), tidy(F.sum(F.col("value") * F.col("lon")), 3).alias("value"))


@query("select cast(lead_h // 6 - 1 as int) as time_i, variable, count(value) as n, round(sum(value*2+5),3)+0.0 as value from c where model=2 and lead_h between 12 and 30 and variable <> 'R' group by 1,2", c=_CUBE)
def chunked_truth(spark, d):
    """A store of normalised channels: a range of times and channels is read, and brought back to its unit."""
    cube, root = _cube(spark, d)[2], scratch(spark)
    chunks = (2, 1, 12, 10)
    spec = {"zarr_format": 2, "shape": list(cube.shape), "chunks": list(chunks), "dtype": "<f8", "order": "C", "fill_value": None, "compressor": {"id": "zlib"}, "filters": None}
    netcdf.put(spark, f"{root}/truth.zarr/data/.zarray", json.dumps(spec).encode())
    for t, k, j in itertools.product(range(4), range(3), range(3)):
        block = np.full(chunks, np.nan)
        part = cube[2 * t : 2 * t + 2, k : k + 1, :, 10 * j : 10 * j + 10]
        block[tuple(slice(n) for n in part.shape)] = part
        netcdf.put(spark, f"{root}/truth.zarr/data/{t}.{k}.0.{j}", zlib.compress(block.tobytes()))
    x = netcdf.chunked_store(spark, f"{root}/truth.zarr", where={"time": (1, 5), "channel": (0, 2)})
    x = x.withColumn("variable", F.element_at(F.array(F.lit("A"), F.lit("N")), F.col("channel_i") + 1))
    y = gridded.standardised(F.col("value"), F.lit(5.0), F.lit(2.0), F.col("variable"))
    return x.withColumn("y", y).groupBy("time_i", "variable").agg(F.count("y").alias("n"), tidy(F.sum("y"), 3).alias("value"))


# --- packed fields ------------------------------------------------------------

_PK = f"select model, variable, cast(lat_i as int) as lat_i, lat, cast(lon_i as int) as lon_i, fcst, obs, 20.0 + lat_i % 7 + lon_i / 100.0 as clim from ({CELLS}) c where abs(lat) < 89"


@query("""select model, variable, count(*) as n, round(sqrt(sum(w*(fcst-obs)*(fcst-obs))/sum(w)),6)+0.0 as rmse, round(sum(w*(fcst-obs))/sum(w),6)+0.0 as bias, round(sum(w*fa*oa)/nullif(sqrt(sum(w*fa*fa)*sum(w*oa*oa)),0),6)+0.0 as acc,
 round((sum(w*fa*oa)-sum(w*fa)*sum(w*oa)/sum(w))/nullif(sqrt((sum(w*fa*fa)-pow(sum(w*fa),2)/sum(w))*(sum(w*oa*oa)-pow(sum(w*oa),2)/sum(w))),0),6)+0.0 as acc_centred,
 round(sqrt(greatest(sum(w*fa*fa)/sum(w)-pow(sum(w*fa)/sum(w),2),0)),6)+0.0 as fa_pred from (select *, cos(radians(lat)) as w, fcst-clim as fa, obs-clim as oa from c) group by 1,2""", c=_PK)
def packed_scores(spark, d):
    rings = packed.pack(view(spark, d, _PK), ["model", "variable"], ["fcst", "obs", "clim"], 240)
    out = packed.ring_scores(rings, ["model", "variable"])
    return out.select("model", "variable", "n", *r("rmse", "bias", "acc", "acc_centred", "fa_pred"))


_PR = "select vec_id % 3 as g, vec_id, cos(radians(cast(vec_id % 13 as double)*14.0-84.0)) as w, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings"
_PP = "select g, vec_id, any_value(w) as w, k, case when k=0 then 0.0 else (pow(sum((x-m)*cos(2*pi()*((k*i)%64)/64)),2)+pow(sum((x-m)*sin(2*pi()*((k*i)%64)/64)),2))/4096 end as p from (select *, avg(x) over (partition by vec_id) as m from rings), (select unnest(range(9)) as k) group by 1,2,4"


@query("select cast(g as bigint) as g, cast(k as int) as wavenumber, round(sum(w*p)/sum(w),9)+0.0 as fcst, round(9*sum(w*p)/sum(w),9)+0.0 as obs from power group by 1, k", rings=_PR, power=_PP)
def packed_spectra(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 3).alias("g"), ((F.col("vec_id") % 13).cast("double") * 14.0 - 84.0).alias("lat"), F.col("embedding").cast("array<double>").alias("fcst"))
    rings = e.withColumn("obs", F.transform("fcst", lambda x: 3 * x))
    out = packed.ring_report(rings, ["g"], 8).select("g", F.posexplode(F.arrays_zip("fcst_power", "obs_power")).alias("wavenumber", "p"))
    return out.select("g", "wavenumber", tidy("p.fcst_power", 9).alias("fcst"), tidy("p.obs_power", 9).alias("obs"))


# --- archives and sinks -------------------------------------------------------

_MONTHS = f"select model, cast(init as date) as init, variable, lead_h, rmse from ({ARCHIVE}) a"


@query("select model, variable, count(*) as n, round(avg(rmse),6)+0.0 as rmse, count(distinct init) as n_dates from a group by 1,2", a=_MONTHS)
def archive_by_date(spark, d):
    """Written by date, one date written again, and read back with its metadata."""
    x = view(spark, d, _MONTHS).withColumn("init_date", F.col("init"))
    root = archive.archive_path(scratch(spark), "demo", {"b": 1, "a": [2]})
    archive.write_scores(x, f"{root}/rmse")
    archive.write_scores(x.where(F.month("init") == 3), f"{root}/rmse")
    archive.write_meta(spark, f"{root}/meta", {"name": "demo"})
    table, meta = archive.load_archive(spark, root)
    assert meta == {"name": "demo"}
    return table.groupBy("model", "variable").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("rmse")).alias("rmse"), F.count_distinct("init").alias("n_dates"))


@query("select init, count(*) as n from a where month(init) > 6 group by 1", a=_MONTHS)
def pending_dates(spark, d):
    x = view(spark, d, _MONTHS).withColumn("init_date", F.col("init"))
    path = f"{scratch(spark)}/rmse"
    archive.write_scores(x.where(F.month("init") <= 6), path)
    todo = archive.pending(x.select("init_date").distinct(), spark, path)
    return x.join(todo, "init_date", "left_semi").groupBy("init").agg(F.count(F.lit(1)).alias("n"))


@query("select init as init_date, 'm' || cast(model as varchar) as member, count(*) as n, round(avg(lead_h),4)+0.0 as lead_h, round(sum(floor(rmse*10)/10),4)+0.0 as rmse from a group by 1,2", a=_MONTHS)
def date_csv(spark, d):
    """Files by date and member, read back with what their names say."""
    x = view(spark, d, _MONTHS).select(F.col("init").alias("init_date"), F.concat(F.lit("m"), F.col("model").cast("string")).alias("member"), "lead_h", "variable", (F.floor(F.col("rmse") * 10) / 10).alias("rmse"))
    path = f"{scratch(spark)}/csv"
    archive.write_date_csv(x, path, "rmse")
    got = spark.read.schema("lead_h double, variable string, rmse double, file string").option("header", True).csv(path)
    part = F.split("file", "_")
    got = got.select(F.to_date(part[1], "yyyyMMdd").alias("init_date"), part[2].alias("member"), "lead_h", "rmse")
    return got.groupBy("init_date", "member").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("lead_h"), 4).alias("lead_h"), tidy(F.sum("rmse"), 4).alias("rmse"))


@query("select cast(lead_h as int) as lead_h, threshold, count(*) filter (fcst>=threshold and obs>=threshold) as hits, count(*) as n_pairs from fc, (select unnest([10.0,25.0])::double as threshold) group by 1,2", fc=FC)
def ts_csv(spark, d):
    """A threat score table as one CSV with a header, its metadata beside it."""
    root = scratch(spark)
    table = categorical.contingency_table(view(spark, d, FC), ["lead_h"], (10.0, 25.0))
    archive.write_csv(table, f"{root}/ts_demo.csv", ["lead_h", "threshold"])
    archive.write_meta(spark, f"{root}/demo_meta", {"thresholds": [10.0, 25.0]})
    got = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/ts_demo.csv")
    return got.select(F.col("lead_h").cast("int").alias("lead_h"), F.col("threshold").cast("double").alias("threshold"), F.col("hits").cast("long").alias("hits"), F.col("n_pairs").cast("long").alias("n_pairs"))


_HOUR7 = "select cast(user_id % 7 as bigint) as station_id, date_trunc('hour', ts) as obs_time, sum(value) - 20 as rain from {events} group by 1, 2"


@query("""select hour_end, station_id, round(sum(greatest(rain,0)),4)+0.0 as total, any_value(k) as n_hours from (select e.hour_end, g.*, count(distinct g.obs_time) over (partition by e.hour_end) as k, max(g.obs_time) over (partition by e.hour_end) as last from (select distinct date_trunc('day', obs_time) + interval 12 hour as hour_end from g) e join g on g.obs_time <= e.hour_end and g.obs_time > e.hour_end - interval 6 hour)
 group by 1,2 having bool_or(obs_time = last)""", g=_HOUR7)
def latest_station_sums(spark, d):
    x = view(spark, d, _HOUR7)
    ends = x.select((F.date_trunc("day", "obs_time") + F.expr("interval 12 hours")).alias("end")).distinct()
    out = categorical.latest_station_sums(x, ends, 6)
    return out.select(F.col("end").alias("hour_end"), "station_id", tidy("total", 4).alias("total"), "n_hours")


@query("select init as init_date, model, count(*) as n, round(sum(rmse),4)+0.0 as rmse, 6 as accum_hours from a group by 1,2", a=_MONTHS)
def merged_csv(spark, d):
    x = view(spark, d, _MONTHS)
    path = f"{scratch(spark)}/csv"
    x.select("model", "lead_h", "rmse", F.date_format("init", "yyyyMMdd").alias("init")).write.partitionBy("init").option("header", True).csv(path)
    got = archive.merged_csv(spark, path, "model int, lead_h double, rmse double", 6)
    return got.groupBy("init_date", "model", "accum_hours").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("rmse"), 4).alias("rmse"))


@query("select init_date, kind, count(*) as n from (select init as init_date, case model when 0 then '_det' when 1 then '' when 2 then '_ensmean' else '_ens' end as kind, min(case model when 0 then 0 when 1 then 1 else 2 end) over (partition by init) as best, case model when 0 then 0 when 1 then 1 else 2 end as k from a) where k=best group by 1,2", a=_MONTHS)
def csv_by_priority(spark, d):
    """Of each date's files the deterministic one, else a bare one, else those of ensembles."""
    x = view(spark, d, _MONTHS)
    kind = F.element_at(F.array(F.lit("_det"), F.lit(""), F.lit("_ensmean"), F.lit("_ens")), F.col("model") + 1)
    path = f"{scratch(spark)}/csv"
    x.select("lead_h", "rmse", kind.alias("kind"), F.concat(F.lit("rmse_"), F.date_format("init", "yyyyMMdd"), kind, F.lit(".csv")).alias("file")).write.partitionBy("file").option("header", True).csv(path)
    names = [f"{path}/{s.getPath().getName()}" for s in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if "=" in s.getPath().getName()]
    got = archive.read_csv_metrics(spark, names, "lead_h double, rmse double, kind string")
    return got.groupBy("init_date", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select \"table\", variable, round(avg(rmse),6)+0.0 as rmse from (select case when lead_h <= 24 then 'step4_bar' else 'step5_regional' end as \"table\", variable, rmse from a) group by 1,2", a=_MONTHS)
def tagged_tables(spark, d):
    x = view(spark, d, _MONTHS)
    both = archive.tagged({"step4_bar": x.where("lead_h <= 24"), "step5_regional": x.where("lead_h > 24").drop("model")})
    return both.groupBy("table", "variable").agg(tidy(F.avg("rmse")).alias("rmse"))


@query("select string_agg(line, chr(10)) || chr(10) as text from (select 0 as k, '| variable | n |' as line union all select 1, '| --- | --- |' union all select 2 + row_number() over (order by variable), '| ' || variable || ' | ' || cast(n as varchar) || ' |' from (select variable, count(*) as n from a group by 1) order by 1)", a=_MONTHS)
def markdown_report(spark, d):
    x = view(spark, d, _MONTHS).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(archive.markdown(x, ["variable"]),)], "text string")


@query("select cast(2*model as bigint) as events, 'model ' || cast(model as varchar) as name from (select distinct model from a)", a=_MONTHS)
def run_log(spark, d):
    x = [r.model for r in view(spark, d, _MONTHS).select("model").distinct().collect()]  # four models
    path = f"{scratch(spark)}/log"
    for m in x:
        archive.write_log(spark, path, [{"name": f"model {m}", "events": 2 * m}])
    return spark.read.schema("events long, name string").json(path)


@query("select model, round(avg(rmse),6)+0.0 as rmse from a where init in (select init from a group by 1 having count(distinct model)=4) group by 1", a=_MONTHS)
def strict_dates(spark, d):
    x = view(spark, d, _MONTHS)
    dates = x.groupBy("init").agg(F.count_distinct("model").alias("n")).where("n = 4")
    return archive.strict_dates(x, dates, [0, 1, 2, 3]).groupBy("model").agg(tidy(F.avg("rmse")).alias("rmse"))


@query("select member, count(*) as n, round(sum(rmse),4)+0.0 as rmse from (select case model when 0 then 'det' when 1 then 'ensmean' else 'm' || cast(model as varchar) end as member, * from a union all select 'ensmean', a.* from a where model=0 and not exists (select 1 from a b where b.model=1 and b.init=a.init and b.variable=a.variable and b.lead_h=a.lead_h)) group by 1", a=_MONTHS)
def resumed_members(spark, d):
    x = view(spark, d, _MONTHS)
    x = x.withColumn("member", F.element_at(F.array(*[F.lit(m) for m in ("det", "ensmean", "m2", "m3")]), F.col("model") + 1)).drop("model")
    return archive.with_means(x, ["init", "variable", "lead_h"]).groupBy("member").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("rmse"), 4).alias("rmse"))


@query("select variable, wavenumber, field, round(avg(value),6)+0.0 as value from (select variable, wavenumber, 'power_forecast' as field, pred as value from sp union all select variable, wavenumber, 'power_observation', obs from sp) group by 1,2,3", sp=SPECTRA)
def wavenumber_rows(spark, d):
    x = view(spark, d, SPECTRA).groupBy("variable", "wavenumber").agg(F.avg("pred").alias("power_forecast"), F.avg("obs").alias("power_observation"))
    long = x.unpivot(["variable", "wavenumber"], ["power_forecast", "power_observation"], "field", "value").withColumn("scope", F.lit("wavenumber"))
    other = long.withColumn("scope", F.lit("lead")).withColumn("wavenumber", F.lit(None).cast("int"))
    out = archive.wavenumber_rows(long.unionByName(other).select("scope", "variable", F.col("wavenumber").cast("string").alias("wavenumber"), "field", F.col("value").cast("string").alias("value")))
    return out.select("variable", "wavenumber", "field", *r("value"))


@query("select wavenumber, round(avg(pred),6)+0.0 as value from sp where variable='A' group by 1", sp=SPECTRA)
def spectrum_details(spark, d):
    x = view(spark, d, SPECTRA).select("variable", F.lit(24.0).alias("lead_h"), F.concat(F.lit("k="), F.col("wavenumber").cast("string")).alias("group"), F.col("pred").alias("value"))
    x = x.unionByName(x.withColumn("group", F.lit("band 1-4")))
    return archive.spectrum_details(x, "A", 24.0).groupBy("wavenumber").agg(tidy(F.avg("value")).alias("value"))


# --- roll-ups and report tables -----------------------------------------------

_SPREAD = f"select model, variable, lead_h, init, avg(abs(fcst)) as spread, avg(abs(fcst - obs)) as rmse from ({FC}) f group by 1, 2, 3, 4"


@query("select variable, lead_h, round(avg(spread)/nullif(avg(rmse),0),6)+0.0 as ratio from s group by 1,2", s=_SPREAD)
def ratio_of_means(spark, d):
    return summary.ratio_of_means(view(spark, d, _SPREAD), ["variable", "lead_h"], "spread", "rmse").select("variable", "lead_h", *r("ratio"))


_PROB = f"select cast(lead_h as int) as lead_h, cast(model as double) as threshold, case when variable <> 'N' then avg(fcst) / 100 end as aroc, avg(obs) / 100 as bs, case when variable = 'R' then avg(fcst - obs) / 10 end as bss, variable from ({FC}) f group by 1, 2, variable"


@query("select lead_h, threshold, variable, round(aroc,6)+0.0 as aroc, round(bs,6)+0.0 as bs, round(bss,6)+0.0 as bss, 0 as n_used from p union all select lead_h, null, null, round(avg(aroc),6)+0.0, round(avg(bs) filter (bss is not null),6)+0.0, round(avg(bss),6)+0.0, count(aroc) from p group by 1", p=_PROB)
def average_rows(spark, d):
    out = categorical.with_average(view(spark, d, _PROB), ["lead_h"])
    return out.select("lead_h", "threshold", "variable", *r("aroc", "bs", "bss"), F.coalesce("n_used", F.lit(0)).alias("n_used"))


@query("select model, round(100*avg(dv),6)+0.0 as fa_deviation from (select model, lead_h, avg(abs(f-1)) as dv from (select model, lead_h, variable, avg(spread)/avg(rmse) as f from s group by 1,2,3) group by 1,2) group by 1", s=_SPREAD)
def activity_deviation(spark, d):
    x = summary.ratio_of_means(view(spark, d, _SPREAD), ["model", "lead_h", "variable"], "spread", "rmse", "fa_ratio")
    return compare.activity_deviation(x).select("model", *r("fa_deviation"))


@query("select model, variable, round(100*avg(q),6)+0.0 as log_rms from (select model, variable, init, sqrt(avg(pow(log10(pred/obs),2))) as q from sp where wavenumber between 1 and 720 group by 1,2,3) group by 1,2", sp=SPECTRA)
def log10_spectrum_rms(spark, d):
    return compare.log_spectrum_rms(view(spark, d, SPECTRA), ["model", "variable"], base10=True).select("model", "variable", *r("log_rms"))


_LONG = f"select case when variable = 'A' then 'z500' else variable end as variable, case when model < 2 then 'rmse' else 'acc' end as metric, lead_h, avg(abs(fcst - obs)) as value, case when variable = 'R' and lead_h > 30 then 'no data' else 'success' end as status, case when variable = 'N' then 'K' else '' end as unit from ({FC}) f group by 1, 2, 3, variable"


@query("select metric, variable, unit, round(arg_min(value, lead_h),6)+0.0 as first, round(arg_max(value, lead_h),6)+0.0 as last, round(avg(value),6)+0.0 as mean, sum((value>p)::int)::bigint as n_rise, sum((value<p)::int)::bigint as n_fall from (select *, lag(value) over (partition by metric, variable order by lead_h) as p from l where status='success') group by 1,2,3", l=_LONG)
def field_curves(spark, d):
    out = report.field_curves(report.field_table(view(spark, d, _LONG)))
    return out.select("metric", "variable", "unit", *r("first", "last", "mean"), "n_rise", "n_fall")


@query("select metric, variable, count(*) as n, min(lead_h) as lead_min, max(lead_h) as lead_max from l where status <> 'success' group by 1,2", l=_LONG)
def failed_groups(spark, d):
    return report.failed_groups(report.field_table(view(spark, d, _LONG)))


@query("select m.metric, v.variable from (select unnest(['rmse','acc','fa']) as metric) m, (select unnest(['z500','R','q700']) as variable) v where not exists (select 1 from l where l.metric=m.metric and l.variable=v.variable and status='success')", l=_LONG)
def missing_requested(spark, d):
    wanted = spark.createDataFrame([(m, v) for m in ("rmse", "acc", "fa") for v in ("z500", "R", "q700")], "metric string, variable string")
    return report.missing_requested(report.field_table(view(spark, d, _LONG)), wanted)


_TS = f"select concat('≥', cast(t as string)) as grade, cast(lead_h as string) as lead_h, avg(case when fcst >= t and obs >= t then 1e0 else 0e0 end) as TS, avg(case when fcst >= t then 1e0 else 0e0 end) as POD from ({FC}) f cross join (select 10 as t union all select 25 as t) g group by 1, 2"


@query("select cast(replace(grade,'≥','') as double) as threshold_mm, cast(lead_h as double) as lead_h, round(TS,6)+0.0 as ts, round(1-POD,6)+0.0 as miss_rate from t", t=_TS.replace("concat('≥', cast(t as string))", "'≥' || cast(t as varchar)"))
def prepared_ts(spark, d):
    out = report.ts_table(view(spark, d, _TS))
    return out.select("threshold_mm", "lead_h", tidy("TS").alias("ts"), tidy("miss_rate").alias("miss_rate"))


@query("select metric, case when max((variable='z500')::int)=1 then 'z500' else min(variable) end as variable from l where not (metric='acc' and variable='z500') group by 1", l=_LONG)
def leading_variables(spark, d):
    return report.leading_variable(view(spark, d, _LONG).where("not (metric = 'acc' and variable = 'z500')"), ["metric"])


_NAMES = "select distinct case l_linenumber when 1 then 'Wave_tuned' when 2 then 'wave' when 3 then 'Othertuned' when 4 then 'lone' else concat('m', cast(l_linenumber as string)) end as model from {lineitem}"


@query("select 'Wave_tuned' as model, 'wave' as reference union all select 'Othertuned', null")
def primary_pairs(spark, d):
    return report.primary_pairs(view(spark, d, _NAMES), "tuned")


_FOUR = f"select model, avg(abs(fcst - obs)) as relative, avg(fcst) as acc, avg(obs) as fa_deviation, max(fcst) as spectrum_rms, min(fcst) as zonal_rms from ({FC}) f group by 1"


@query("select model, (rank() over (order by relative) + rank() over (order by acc desc) + rank() over (order by fa_deviation) + rank() over (order by spectrum_rms)) / 4.0 as by_log10, (rank() over (order by relative) + rank() over (order by acc desc) + rank() over (order by fa_deviation) + rank() over (order by zonal_rms)) / 4.0 as by_zonal from s", s=_FOUR)
def four_score_ranks(spark, d):
    x = view(spark, d, _FOUR)
    a = report.four_score_ranks(x).select("model", F.col("mean_rank").alias("by_log10"))
    return a.join(report.four_score_ranks(x, "zonal_rms").select("model", F.col("mean_rank").alias("by_zonal")), "model")


@query("""with z as (select model, variable, 100*avg(q) as log_rms from (select model, variable, init, sqrt(avg(pow(ln(pred/obs),2))) as q from sp where wavenumber between 1 and 720 group by 1,2,3) group by 1,2)
 select model, (rank() over (order by relative) + rank() over (order by acc desc) + rank() over (order by fa_deviation) + rank() over (order by zr)) / 4.0 as mean_rank, round(zr,6)+0.0 as zonal_rms from s join (select model, avg(log_rms) as zr from z group by 1) using (model)""".replace("with z as", "select * from (with z as") + ")", sp=SPECTRA, s=_FOUR)
def wave_report(spark, d):
    sp = view(spark, d, SPECTRA)
    bands = sp.withColumn("band", F.when(F.col("wavenumber") < 5, "1_4").otherwise("5_20"))
    scores = view(spark, d, _FOUR).drop("zonal_rms")
    return report.wave_report(sp, bands, scores)["ranks"].select("model", "mean_rank", *r("zonal_rms"))


@query("""select threshold, cast(sum(misses) as bigint) as misses, cast(sum(false_alarms) as bigint) as false_alarms, case when sum(false_alarms)>sum(misses) then 'false alarms' when sum(false_alarms)<sum(misses) then 'misses' else 'even' end as kind from
 (select threshold, count(*) filter (fcst<threshold and obs>=threshold) as misses, count(*) filter (fcst>=threshold and obs<threshold) as false_alarms from fc, (select unnest([10.0,25.0])::double as threshold) group by 1) group by 1""", fc=FC)
def error_structure(spark, d):
    table = categorical.contingency_table(view(spark, d, FC), ["lead_h"], (10.0, 25.0))
    return report.grade_analysis(table)["structure"].select("threshold", "misses", "false_alarms", "kind")


@query("select band, model_a, model_b, count(*) as n, round(avg(a-b),6)+0.0 as diff from (select x.band, x.model as model_a, y.model as model_b, x.rmse as a, y.rmse as b from b x join b y on x.band=y.band and x.init=y.init and x.model<y.model) group by 1,2,3", b=f"select model, init, case when lead_h <= 24 then '0_24' else '24_48' end as band, avg(rmse) as rmse from ({_MONTHS}) m group by 1,2,3")
def band_pairs(spark, d):
    x = view(spark, d, _MONTHS).withColumn("band", F.when(F.col("lead_h") <= 24, "0_24").otherwise("24_48")).groupBy("model", "init", "band").agg(F.avg("rmse").alias("rmse"))
    out = compare.pair_report(x, ["band"], "rmse", family=["band"])
    return out.select("band", "model_a", "model_b", (F.col("n") + F.col("n_zero")).alias("n"), tidy(F.col("mean_a") - F.col("mean_b")).alias("diff"))
