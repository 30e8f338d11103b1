"""Tropical cyclones: centres, track errors, best-track matching, ensemble tracks, and the chained search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]


def centres(cells: DataFrame, keys: Keys, value: str = "msl") -> DataFrame:
    """The cell of the least pressure of each group; ties go to the first in row-major order."""
    best = F.min(F.struct(value, "lat_i", "lon_i", "lat", "lon"))
    return cells.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col(f"x.{value}").alias(value), "x.lat", "x.lon")


def max_wind(cells: DataFrame, at: DataFrame, keys: Keys, half: float = 5.0, value: str = "wind") -> DataFrame:
    """Strongest wind within `half` degrees of each group's centre (clat, clon)."""
    return cells.join(at, list(keys)).where(c.near("lat", "lon", "clat", "clon", F.lit(half))).groupBy(*keys).agg(F.max(value).alias("vmax"))


def match_best_track(track: DataFrame, best: DataFrame, tz_shift: float = 8) -> DataFrame:
    """track (tcid, init, lead_h, plat, plon) with the observation at init + lead on the best track's clock, or NULLs."""
    return track.withColumn("obs_time", c.valid_time("init", "lead_h", tz_shift)).join(best, ["tcid", "obs_time"], "left")


def track_errors(matched: DataFrame, keys: Keys) -> DataFrame:
    """Distance, along- and cross-track error (km) of matched positions (plat, plon; lat, lon).

    The direction is from the last matched observation before; the first has none.
    """
    w = W.partitionBy(*keys).orderBy("lead_h").rowsBetween(W.unboundedPreceding, -1)
    x = matched.withColumns({"__la": F.last("lat", ignorenulls=True).over(w), "__lo": F.last("lon", ignorenulls=True).over(w)})
    along, cross = c.along_cross("__la", "__lo", "lat", "lon", "plat", "plon")
    return x.withColumns({"distance_km": c.great_circle("lat", "lon", "plat", "plon"), "along_km": along, "cross_km": cross}).drop("__la", "__lo")


def ensemble_track_mean(errors: DataFrame, keys: Keys) -> DataFrame:
    """Scheme A: mean over members of their errors, with counts."""
    return errors.groupBy(*keys).agg(F.avg("distance_km").alias("distance_km"), F.avg("along_km").alias("along_km"), F.avg("cross_km").alias("cross_km"), F.count_distinct("member").alias("n_members"), F.count("distance_km").alias("n"))


def ensemble_mean_track(tracks: DataFrame, keys: Keys) -> DataFrame:
    """Scheme B: the mean position over members, to be scored as one track."""
    return tracks.groupBy(*keys).agg(F.avg("plat").alias("plat"), F.avg("plon").alias("plon"), F.count_distinct("member").alias("n_members"))


def inits_from_best_track(best: DataFrame, forecasts: DataFrame, tz_shift: float = 8) -> DataFrame:
    """(tcid, init) of best-track times that are 00 UTC starts for which a forecast exists."""
    init = F.timestamp_micros((F.unix_micros("obs_time") - int(tz_shift * 3_600_000_000)).cast("long"))
    return best.select("tcid", init.alias("init")).where((F.hour("init") == 0) & (F.minute("init") == 0)).join(forecasts.select("init").distinct(), "init", "left_semi")


def nearest_record(best: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (tcid, obs_time) that is wanted, the record closest in time."""
    x = wanted.withColumnRenamed("obs_time", "wanted_time").join(best, "tcid")
    gap = F.abs(F.unix_micros("obs_time") - F.unix_micros("wanted_time"))
    return x.groupBy("tcid", "wanted_time").agg(F.min_by("obs_time", F.struct(gap, "obs_time")).alias("obs_time"))


def track_storms(cells: DataFrame, starts: DataFrame, half: float = 3.0, early_half: float = 4.0, early_hours: float = 12.0) -> DataFrame:
    """(tcid, lead_h, plat, plon, pmin) by a chained search: each lead looks around the centre of the lead before.

    cells (tcid, lead_h, lat, lon, msl), starts (tcid, lat, lon).  A storm is one
    group; its cells are those of a regional grid.
    """
    x = cells.join(starts.select("tcid", F.col("lat").alias("__la"), F.col("lon").alias("__lo")), "tcid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        la, lo = pdf["__la"].iloc[0], pdf["__lo"].iloc[0]
        rows = []
        for lead, g in pdf.sort_values(["lead_h", "lat", "lon"]).groupby("lead_h"):
            h = early_half if lead <= early_hours else half
            turn = np.mod(g["lon"] - lo + 180, 360) - 180
            box = g[((g["lat"] - la).abs() <= h) & (turn.abs() <= h)]
            if len(box):
                i = box["msl"].idxmin()
                la, lo = box.loc[i, "lat"], box.loc[i, "lon"]
                rows.append((pdf["tcid"].iloc[0], lead, la, lo, box.loc[i, "msl"]))
        return pd.DataFrame(rows, columns=["tcid", "lead_h", "plat", "plon", "pmin"])

    kind = cells.schema["tcid"].dataType.simpleString()
    return x.groupBy("tcid").applyInPandas(run, f"tcid {kind}, lead_h double, plat double, plon double, pmin double")
