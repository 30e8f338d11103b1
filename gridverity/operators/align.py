"""Alignment of forecasts with truth, climatology, stations and other grids: equi-joins on integer keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]
CELL = ("variable", "lat_i", "lon_i")


def at_valid_time(forecast: DataFrame, truth: DataFrame, keys: Keys = CELL, shift_h: float = 0) -> DataFrame:
    """forecast (init, lead_h, fcst, ...) joined with truth (valid_time, obs, ...) at init + lead + shift."""
    return forecast.withColumn("valid_time", c.valid_time("init", "lead_h", shift_h)).join(truth, [*keys, "valid_time"])


def missing_truth(forecast: DataFrame, truth: DataFrame, keys: Keys = CELL) -> DataFrame:
    """Valid times and keys of a forecast that truth has no row for; empty when verification may start."""
    return forecast.withColumn("valid_time", c.valid_time("init", "lead_h")).select(*keys, "valid_time").distinct().join(truth, [*keys, "valid_time"], "left_anti")


def shifted_pair(forecast: DataFrame, truth: DataFrame, keys: Keys, shift: int, step_h: float) -> DataFrame:
    """Lead i of the forecast with lead i + shift of the truth; leads are numbered anew from step_h."""
    moved = truth.withColumn("lead_index", F.col("lead_index") - shift)
    return forecast.join(moved, [*keys, "lead_index"]).withColumn("lead_h", (F.col("lead_index") + 1) * step_h)


def climatology_at(rows: DataFrame, clim: DataFrame, n_days: int, per_day: int, time: str = "valid_time", keys: Keys = CELL) -> DataFrame:
    """rows with clim: the two slots around their time of year, interpolated; the year is a circle.

    clim has keys, slot (0 to n_days * per_day - 1) and value.
    """
    n = n_days * per_day
    at = c.year_slot(time, n_days) * per_day
    rows = rows.withColumns({"__s": at}).withColumns({"__slot0": (F.floor("__s") % n).cast("int"), "__share": F.col("__s") - F.floor("__s")}).withColumn("__slot1", ((F.col("__slot0") + 1) % n).cast("int"))
    low = clim.select(*keys, F.col("slot").alias("__slot0"), F.col("value").alias("__c0"))
    high = clim.select(*keys, F.col("slot").alias("__slot1"), F.col("value").alias("__c1"))
    out = rows.join(low, [*keys, "__slot0"]).join(high, [*keys, "__slot1"])
    return out.withColumn("clim", (1 - F.col("__share")) * F.col("__c0") + F.col("__share") * F.col("__c1")).drop("__s", "__slot0", "__slot1", "__share", "__c0", "__c1")


def smooth_climatology(clim: DataFrame, n_slots: int, window_days: int, per_day: int, keys: Keys = CELL) -> DataFrame:
    """Centred moving average over the circle of slots, of 2 * ((window_days * per_day) // 2) + 1 slots."""
    half = window_days * per_day // 2
    laps = F.explode(F.array(*[F.lit(k * n_slots) for k in (-1, 0, 1)]))
    rows = clim.withColumn("__lap", laps).withColumn("__at", F.col("slot") + F.col("__lap")).where(F.col("__at").between(-half, n_slots - 1 + half))
    mean = F.avg("value").over(W.partitionBy(*keys).orderBy("__at").rangeBetween(-half, half))
    return rows.withColumn("value", mean).where("__lap = 0").drop("__lap", "__at")


def corner_weights(points: DataFrame, n_lat: int, n_lon: int, lat0: float, step: float, wrap: bool = True) -> DataFrame:
    """points (lat, lon) with the four cells around them (lat_i, lon_i) and bilinear weights.

    Latitudes beyond the grid take its edge; longitudes wrap, or have no row beyond the grid.
    """
    y = F.greatest(F.lit(0.0), F.least(F.lit(n_lat - 1.0), (F.col("lat") - lat0) / step))
    i = F.least(F.floor(y), F.lit(n_lat - 2)).cast("int")
    x = c.lon360("lon") / step if wrap else F.col("lon") / step
    j = F.floor(x).cast("int")
    if not wrap:
        points = points.where(F.col("lon").between(0, (n_lon - 1) * step))
        j = F.least(j, F.lit(n_lon - 2))
    p = points.withColumns({"__i": i, "__j": j, "__y": y, "__x": x}).withColumns({"__dy": F.col("__y") - F.col("__i"), "__dx": F.col("__x") - F.col("__j")})
    corners = F.explode(F.array(*[
        F.struct((F.col("__i") + a).alias("lat_i"), ((F.col("__j") + b) % n_lon).cast("int").alias("lon_i"), ((F.col("__dy") if a else 1 - F.col("__dy")) * (F.col("__dx") if b else 1 - F.col("__dx"))).alias("weight"))
        for a in (0, 1) for b in (0, 1)
    ]))
    return p.withColumn("__c", corners).select(*points.columns, "__c.*")


def to_stations(cells: DataFrame, weights: DataFrame, keys: Keys, value: str, station: str = "station_id") -> DataFrame:
    """Fields at stations by corner_weights(); a missing corner makes the value missing, at weight 0 too."""
    rows = cells.join(F.broadcast(weights) if _small(weights) else weights, ["lat_i", "lon_i"])
    total = F.sum(F.col(value) * F.col("weight"))
    return rows.groupBy(station, *keys).agg(F.when(F.count(value) == 4, total).alias(value))


def _small(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether a table has at most so many rows: its size is checked, not assumed."""
    return df.limit(rows + 1).count() <= rows


def nearest_cell(points: DataFrame, n_lat: int, n_lon: int, lat0: float, step: float) -> DataFrame:
    """points with their nearest cell; a tie in latitude goes to the lower index, in longitude to the even one."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(n_lat - 1.0), (F.col("lat") - lat0) / step))
    i = F.floor(y) + F.when(y - F.floor(y) > 0.5, 1).otherwise(0)
    return points.withColumns({"lat_i": i.cast("int"), "lon_i": (F.rint(c.lon360("lon") / step) % n_lon).cast("int")})


def nearest_stations(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """(lat_i, lon_i, station_id): the station closest to each grid point, in degrees; ties go to the smaller id.

    Depends on places only, so it is made once for all times; stations are broadcast if they are few.
    """
    s = stations.select("station_id", F.col("lat").alias("__la"), F.col("lon").alias("__lo"))
    d = (F.col("lat") - F.col("__la")) ** 2 + (F.col("lon") - F.col("__lo")) ** 2
    pairs = grid.select("lat_i", "lon_i", "lat", "lon").crossJoin(F.broadcast(s) if _small(s) else s)
    return pairs.groupBy("lat_i", "lon_i").agg(F.min_by("station_id", F.struct(d, "station_id")).alias("station_id"))


def to_grid(rows: DataFrame, nearest: DataFrame, value: str) -> DataFrame:
    """Station amounts on a grid by nearest_stations(), negative ones as 0."""
    return nearest.join(rows, "station_id").withColumn(value, F.greatest(F.col(value), F.lit(0.0))).drop("station_id")


def axis_weights(target: DataFrame, index: str, position: str, n: int, x0: float, step: float, extrapolate: bool = True) -> DataFrame:
    """(target index, source index, weight) of linear interpolation along one axis of a regular grid."""
    y = (F.col(position) - x0) / step
    i = F.greatest(F.lit(0), F.least(F.floor(y), F.lit(n - 2))).cast("int")
    d = y - i
    d = d if extrapolate else F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))
    return target.select(index, F.explode(F.array(F.struct(i.alias("source"), (1 - d).alias("weight")), F.struct((i + 1).alias("source"), d.alias("weight")))).alias("x")).select(index, "x.*")


def regrid(cells: DataFrame, lat_weights: DataFrame, lon_weights: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Bilinear regridding by two axis_weights() tables (to_lat, source, weight), (to_lon, source, weight), one axis after the other."""
    lat = lat_weights.select("to_lat", F.col("source").alias("lat_i"), F.col("weight").alias("wy"))  # two rows for each grid line
    lon = lon_weights.select("to_lon", F.col("source").alias("lon_i"), F.col("weight").alias("wx"))
    rows = cells.join(lat, "lat_i").groupBy(*keys, "to_lat", "lon_i").agg(F.sum(F.col(value) * F.col("wy")).alias(value))
    return rows.join(lon, "lon_i").groupBy(*keys, "to_lat", "to_lon").agg(F.sum(F.col(value) * F.col("wx")).alias(value))


def first_available(sources: Sequence[DataFrame], keys: Keys) -> DataFrame:
    """Rows of the first source that has a key."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("__rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    best = F.row_number().over(W.partitionBy(*keys).orderBy("__rank"))
    return out.withColumn("__r", best).where("__r = 1").drop("__rank", "__r")


def pair_faults(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """Keys (leads, cells, variables) that only one side of a pair has; empty when the pair can be scored."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("only", F.lit("a")).unionByName(y.exceptAll(x).withColumn("only", F.lit("b")))
