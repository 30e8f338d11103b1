"""Streaming forms of the accumulating scores: the same rows as in batch, as data arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c


def rain_windows(hours: DataFrame, n_hours: int, step_hours: int | None = None, lateness: str = "6 hours") -> DataFrame:
    """station_id, end, total of windows (end - n_hours, end] that have every hour; late hours are waited for.

    Windows of the engine hold their start and not their end, so hours are moved
    back by a microsecond.  Hours of a station that come twice count once, with the
    greater amount.
    """
    x = hours.withColumn("obs_time", F.timestamp_micros(F.unix_micros("obs_time") - 1)).withWatermark("obs_time", lateness)
    by = F.window("obs_time", f"{n_hours} hours", f"{step_hours or n_hours} hours")
    sums = x.where("rain is not null").groupBy("station_id", by.alias("w")).agg(F.array_sort(F.collect_set(F.struct("obs_time", "rain"))).alias("h"))
    # of one hour's entries, which stand together by amount, the last
    last = F.filter("h", lambda v, i: (i + 1 == F.size("h")) | (F.get("h", i + 1)["obs_time"] != v["obs_time"]))
    sums = sums.withColumn("h", last)
    total = F.aggregate("h", F.lit(0.0), lambda s, v: s + v["rain"])
    return sums.where(F.size("h") == n_hours).select("station_id", F.col("w.end").alias("end"), total.alias("total"))


def contingency_stream(pairs: DataFrame, thresholds: Sequence[float], window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Counts of each window of valid time and threshold; scores follow from them at the sink."""
    x = pairs.withWatermark("valid_time", lateness).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return x.groupBy(F.window("valid_time", window).alias("w"), "threshold").agg(*c.contingency("fcst", "obs", "threshold")).select(F.col("w.start").alias("start"), "threshold", "hits", "misses", "false_alarms", "n_pairs")


def newest_archive(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The greatest archive stamp of each valid time, as archives arrive."""
    return files.withWatermark("valid_time", lateness).groupBy("valid_time").agg(F.max_by("path", "archive_stamp").alias("path"))


def to_archive(scores: DataFrame, path: str, checkpoint: str, date: str = "start"):
    """Write finished windows to a partitioned archive; a restarted query goes on where it stopped."""
    return scores.withColumn("init_date", F.to_date(date)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("init_date").outputMode("append")
