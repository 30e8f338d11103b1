"""Sub-seasonal verification: calendars without leap days, weekly means, and skill along start dates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import columns as c

Keys = Sequence[str]

# fixed values: first and last lead day of each group
WEEKS = (
    ("week1", 1, 7), ("week2", 8, 14), ("week3", 15, 21), ("week4", 22, 28), ("week5", 29, 35), ("week6", 36, 42),
    ("week7", 43, 49), ("week8", 50, 56), ("week9", 57, 60), ("week34", 15, 28), ("week56", 29, 42),
)


def calendar(spark: SparkSession, first: str, last: str, leap_days: bool = False) -> DataFrame:
    """Days from first to last with mmdd, and their place in a calendar of 365-day years."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    days = days.withColumn("mmdd", F.date_format("day", "MMdd"))
    if not leap_days:
        days = days.where("mmdd != '0229'")
    shift = F.when(c.is_leap(F.year("day")) & (F.dayofyear("day") > 59), 1).otherwise(0)
    return days.withColumns({"doy": F.dayofyear("day") - shift, "ordinal": F.year("day") * 365 + F.dayofyear("day") - shift})


def odd_day_starts(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    """The 183 start dates of a year with odd day of year, for each year."""
    out = calendar(spark, f"{min(years)}-01-01", f"{max(years)}-12-31").where((F.col("doy") % 2 == 1) & F.year("day").isin(*years))
    return out.select(F.col("day").alias("init_date"), "mmdd", "doy")


def daily_climatology(daily: DataFrame, keys: Keys, value: str = "value", member: str | None = None) -> DataFrame:
    """Mean over years by mmdd; members are averaged first."""
    x = daily.withColumns({"mmdd": F.date_format("day", "MMdd"), "__y": F.year("day")}).where("mmdd != '0229'")
    if member:
        x = x.groupBy(*keys, "mmdd", "__y").agg(F.avg(value).alias(value))
    return x.groupBy(*keys, "mmdd").agg(F.avg(value).alias("clim"))


def daily_anomaly(daily: DataFrame, clim: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    return daily.withColumn("mmdd", F.date_format("day", "MMdd")).join(clim, [*keys, "mmdd"]).withColumn("anomaly", F.col(value) - F.col("clim"))


def assemble_leads(starts: DataFrame, daily: DataFrame, keys: Keys, n_leads: int = 60, value: str = "anomaly", dense: bool = True) -> DataFrame:
    """Each start date's days +1 to +n_leads, leap days passed over; a missing day is NULL if dense, else it has no row."""
    ordinal = lambda d: F.year(d) * 365 + F.dayofyear(d) - F.when(c.is_leap(F.year(d)) & (F.dayofyear(d) > 59), 1).otherwise(0)
    days = daily.where(F.date_format("day", "MMdd") != "0229").withColumn("ordinal", ordinal("day"))
    want = starts.withColumn("lead_day", F.explode(F.sequence(F.lit(1), F.lit(n_leads)))).withColumn("ordinal", ordinal("init_date") + F.col("lead_day"))
    if not dense:
        return want.join(days.select(*keys, "ordinal", value), "ordinal").select("init_date", "lead_day", *keys, value)
    if keys:  # the result has each start, lead and cell: that many rows are asked for
        want = want.join(daily.select(*keys).distinct(), how="cross")
    return want.join(days.select(*keys, "ordinal", value), [*keys, "ordinal"], "left").select("init_date", "lead_day", *keys, value)


def weekly_means(daily: DataFrame, keys: Keys, value: str = "value", weeks: Sequence[tuple[str, int, int]] = WEEKS) -> DataFrame:
    """Means over the overlapping groups of lead days; a day goes to each group it is in."""
    table = F.explode(F.array_compact(F.array(*[F.when(F.col("lead_day").between(a, b), F.lit(n)) for n, a, b in weeks])))
    return daily.withColumn("week", table).groupBy(*keys, "week").agg(F.avg(value).alias(value))


def temporal_skill(pairs: DataFrame, keys: Keys, f: str = "fcst", o: str = "obs") -> DataFrame:
    """tcc (Pearson along start dates), rmse and n of each group, over pairs with both sides."""
    x = pairs.where(F.col(f).isNotNull() & F.col(o).isNotNull())
    flat = (F.min(f) == F.max(f)) | (F.min(o) == F.max(o))
    return x.groupBy(*keys).agg(F.when(~flat, c.ratio(F.covar_pop(f, o), F.stddev_pop(f) * F.stddev_pop(o))).alias("tcc"), F.sqrt(F.avg((F.col(f) - F.col(o)) ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def derived_weeks(scores: DataFrame, keys: Keys, values: Keys) -> DataFrame:
    """week34 and week56 as means of their weeks' scores, where they are not there themselves."""
    out = scores
    for name, parts in (("week34", ("week3", "week4")), ("week56", ("week5", "week6"))):
        mean = scores.where(F.col("week").isin(*parts)).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]).withColumn("week", F.lit(name))
        mean = mean.join(scores.where(F.col("week") == name).select(*keys).distinct(), list(keys), "left_anti")
        out = out.unionByName(mean.select(*keys, "week", *values), allowMissingColumns=True)
    return out


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c_, d = np.ones_like(x), 1 / fix(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / fix(1 + num * d)
            c_ = fix(1 + num / c_)
            h = h * d * c_
        if np.all(np.abs(d * c_ - 1) < 1e-14):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t."""
    from math import lgamma

    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    front = np.exp(np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b, strict=True)]) + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    near = x < (a + 1) / (a + b + 2)
    lo = front * beta_fraction(a, b, np.where(near, x, 0.5)) / a
    hi = 1 - front * beta_fraction(b, a, np.where(near, 0.5, 1 - x)) / b
    return np.clip(np.where(x >= 1, 1.0, np.where(near, lo, hi)), 0, 1)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation r of n pairs; NaN (clean() makes it NULL) for n <= 2."""
    ok = r.notna() & (n > 2)
    out = pd.Series(np.nan, index=r.index)
    if ok.any():
        x = np.clip(r[ok].to_numpy(float), -0.999999, 0.999999)
        df = n[ok].to_numpy(float) - 2
        out[ok] = student_two_sided(x * np.sqrt(df / (1 - x * x)), df)
    return out
