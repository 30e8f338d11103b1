"""Scores of deterministic fields: weighted sums over the cells of each group, one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]


def with_weight(cells: DataFrame, weighted: bool = True) -> DataFrame:
    """Cells with w = cos(lat), or 1."""
    return cells.withColumn("w", c.lat_weight("lat", weighted))


def error_scores(cells: DataFrame, keys: Keys, f: str = "fcst", o: str = "obs") -> DataFrame:
    """n, rmse and bias of each group."""
    return with_weight(cells).groupBy(*keys).agg(F.count(F.col(f) - F.col(o)).alias("n"), c.rmse(f, o).alias("rmse"), c.bias(f, o).alias("bias"))


def anomaly_scores(cells: DataFrame, keys: Keys, f: str = "fcst", o: str = "obs", clim: str = "clim", compat: bool = False) -> DataFrame:
    """acc (uncentred), acc_centred, and the activity of both sides with bias and ratio."""
    rows = with_weight(cells).withColumns({"fa": F.col(f) - F.col(clim), "oa": F.col(o) - F.col(clim)})
    out = rows.groupBy(*keys).agg(
        c.acc("fa", "oa").alias("acc"),
        c.acc("fa", "oa", centred=True).alias("acc_centred"),
        c.activity("fa", "oa", compat=compat).alias("fa_pred"),
        c.activity("oa", "fa", compat=compat).alias("fa_obs"),
    )
    return out.withColumns({"fa_bias": F.col("fa_pred") - F.col("fa_obs"), "fa_ratio": c.ratio("fa_pred", "fa_obs")})


def region_scores(cells: DataFrame, regions: DataFrame, keys: Keys, f: str = "fcst", o: str = "obs") -> DataFrame:
    """error_scores of each region (name, lat0, lat1, lon0, lon1); regions may overlap and cross 0 degrees."""
    inside = cells.join(regions, c.in_region("lat", "lon", "lat0", "lat1", "lon0", "lon1"))
    return error_scores(inside, ["name", *keys], f, o)


def wind_speed(cells: DataFrame, u: str, v: str, name: str, keys: Keys, values: Keys) -> DataFrame:
    """Speed sqrt(u^2 + v^2) of each value column, from the rows of two variables."""
    both = cells.where(F.col("variable").isin(u, v)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == k, F.col(x))).alias(f"{x}_{i}") for x in values for i, k in enumerate((u, v))]
    )
    return both.select(*keys, F.lit(name).alias("variable"), *[F.sqrt(F.col(f"{x}_0") ** 2 + F.col(f"{x}_1") ** 2).alias(x) for x in values])


def deaccumulate(cells: DataFrame, keys: Keys, value: str, lead: str = "lead_h") -> DataFrame:
    """Amounts between leads from amounts since the start; the first lead goes."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(lead))
    step = F.row_number().over(W.partitionBy(*keys).orderBy(lead))
    return cells.withColumns({"__step": step, value: F.col(value) - before}).where("__step > 1").drop("__step")


def accumulate(cells: DataFrame, keys: Keys, value: str, n_steps: int, step_h: float, lead: str = "lead_h") -> DataFrame:
    """Amounts over windows of n_steps leads that end at a multiple of the window; windows with a gap go."""
    w = W.partitionBy(*keys).orderBy(lead).rowsBetween(1 - n_steps, 0)
    span = n_steps * step_h
    out = cells.withColumns({"__n": F.count(value).over(w), "__lo": F.min(lead).over(w), value: F.sum(value).over(w)})
    whole = (F.col("__n") == n_steps) & (F.col(lead) - F.col("__lo") == span - step_h) & (F.col(lead) % span == 0)
    return out.where(whole).drop("__n", "__lo")


def kept_metrics(wanted: DataFrame, allowed: DataFrame) -> DataFrame:
    """(variable, metric) of `wanted` that `allowed` lists, and all metrics of variables it does not mention."""
    known = allowed.select("variable").distinct().withColumn("__known", F.lit(True))
    listed = allowed.select("variable", "metric").distinct().withColumn("__ok", F.lit(True))
    rows = wanted.join(known, "variable", "left").join(listed, ["variable", "metric"], "left")
    return rows.where(F.col("__known").isNull() | F.col("__ok")).drop("__known", "__ok")


def weighted_region_mean(values: DataFrame, regions: DataFrame, keys: Keys, value: str) -> DataFrame:
    """cos(lat)-weighted mean of a gridded score in each region, missing cells skipped."""
    inside = values.join(regions, c.in_region("lat", "lon", "lat0", "lat1", "lon0", "lon1"))
    return with_weight(inside).groupBy("name", *keys).agg(c.weighted_mean(value, "w").alias(value))


