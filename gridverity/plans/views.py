"""Demonstration views over the star-schema tables, as SQL that runs on either engine.

Names in braces are tables.  They stand in for gridded forecasts, ensembles,
station rain, tracks and metric archives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FC = """
select cast(l_suppkey % 4 as int) as model, cast(o_orderdate as date) as init, cast(l_linenumber as double) * 6 as lead_h,
       l_returnflag as variable, cast(l_partkey % 121 as int) as lat_i, cast(l_orderkey % 240 as int) as lon_i,
       cast(l_partkey % 121 as double) * 1.5 - 90 as lat, cast(l_orderkey % 240 as double) * 1.5 as lon,
       l_quantity as obs, l_quantity * (0.6 + 8 * l_discount) + 100 * (l_tax - 0.04) as fcst
from {lineitem} join {orders} on l_orderkey = o_orderkey"""

FCC = f"select f.*, avg(obs) over (partition by variable, month(init)) as clim from ({FC}) f"

#: Unique cells: pairs of rows at one cell are averaged.
CELLS = f"""
select model, variable, lat_i, lon_i, cast(lat_i as double) * 1.5 - 90 as lat, cast(lon_i as double) * 1.5 as lon, avg(fcst) as fcst, avg(obs) as obs
from ({FC}) f group by model, variable, lat_i, lon_i"""

ARCHIVE = f"""
select model, date_trunc('month', init) as init, variable, lead_h, sqrt(sum(cos(radians(lat)) * (fcst - obs) * (fcst - obs)) / sum(cos(radians(lat)))) as rmse
from ({FC}) f where abs(lat) < 89 group by 1, 2, 3, 4"""

HOURS = "select cast(user_id % 10 as bigint) as station_id, date_trunc('hour', ts) as obs_time, sum(value) as rain from {events} group by 1, 2"

TRACK = """
select cast(o_custkey % 20 as int) as tcid, cast(o_orderkey % 5 as int) as member, cast(o_orderkey % 10 as double) * 6 as lead_h,
       avg(10 + cast(o_custkey % 300 as double) / 10) as plat, avg(120 + cast(o_orderkey % 400 as double) / 10) as plon
from {orders} group by 1, 2, 3"""

DAILY = f"select variable, lat_i % 12 as lat_i, init as day, avg(fcst) as fcst, avg(obs) as obs from ({FC}) f group by 1, 2, 3"

#: Spectrum pairs by wave number, from counts: positive numbers that vary with model and month.
SPECTRA = f"""
select model, date_trunc('month', init) as init, variable, cast(lon_i % 30 as int) as wavenumber, sum(abs(fcst)) + 1 as pred, sum(obs) + 1 as obs
from ({FC}) f group by 1, 2, 3, 4"""

REGIONS = """
select 'north' as name, 20.0 as lat0, 90.0 as lat1, 0.0 as lon0, 360.0 - 0.001 as lon1 union all
select 'tropics', -20.0, 20.0, 0.0, 360.0 - 0.001 union all
select 'atlantic', 0.0, 60.0, 280.0, 20.0"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view as a DataFrame."""
    tables = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(text: str, **views: str) -> str:
    """SQL for the other engine: views as common table expressions, tables by name."""
    ctes = ",\n".join(f"{name} as ({body})" for name, body in views.items())
    return re.sub(r"\{(\w+)\}", r"\1", (f"with {ctes}\n" if ctes else "") + text)
