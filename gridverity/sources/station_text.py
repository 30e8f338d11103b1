"""Text formats of station rain, reference probabilities and best tracks, read by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | Sequence[str]


def _lines(spark: SparkSession, paths: Paths, encoding: str = "ISO-8859-1") -> DataFrame:
    """file, line number from 0, and fields of each line; a file is one record, so lines keep their order.

    Numbers are ASCII in all encodings in use; names in others keep their bytes as Latin-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths) if not isinstance(paths, str) else paths)
    lines = F.split(F.decode("content", encoding), r"\r?\n")
    out = raw.select(F.col("path").alias("file"), F.posexplode(lines).alias("n", "line"))
    return out.withColumn("fields", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).where(F.size("fields") > 0)


def _number(field: int) -> Column:
    return F.get("fields", F.lit(field)).try_cast("double")


def hourly_stations(spark: SparkSession, paths: Paths, strict: bool = True) -> DataFrame:
    """station_id, obs_time, lon, lat, alt, rain of hourly files (a header, a line with time and count, rows).

    strict: a file of another kind, with another number of rows than it declares,
    or with rain that is no number, is an error; else such rows are left out.
    """
    lines = _lines(spark, paths)
    head = lines.where("n = 1").select(
        "file",
        F.make_timestamp(2000 + _number(0).cast("int"), _number(1).cast("int"), _number(2).cast("int"), _number(3).cast("int"), F.lit(0), F.lit(0)).alias("obs_time"),
        F.element_at("fields", -1).try_cast("double").cast("long").alias("declared"),
    )
    kind = lines.where("n = 0").select("file", F.lower("line").contains("diamond").alias("known"))
    rows = lines.where("n >= 2").select("file", _number(0).cast("long").alias("station_id"), _number(1).alias("lon"), _number(2).alias("lat"), _number(3).alias("alt"), _number(4).alias("rain"))
    rows = rows.join(head, "file").join(kind, "file")
    good = F.col("known") & F.col("station_id").isNotNull() & F.col("rain").isNotNull() & ~F.isnan("rain") & (F.abs("rain") < float("inf"))
    if not strict:
        return rows.where(good).select("station_id", "obs_time", "lon", "lat", "alt", "rain", "file")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("found"), F.bool_and(F.coalesce(good, F.lit(False))).alias("whole"))
    rows = rows.join(counts, "file")
    fine = F.col("whole") & (F.col("found") == F.col("declared"))
    checked = F.when(fine, F.col("rain")).otherwise(F.raise_error(F.concat(F.lit("station file is damaged: "), F.col("file"))).cast("double"))
    return rows.select("station_id", "obs_time", "lon", "lat", "alt", checked.alias("rain"), "file")


def station_index(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files whose stem is YYYYMMDDHH (or that are parts of a folder of that name), with their hour; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("file"))
    return files.withColumn("obs_time", F.try_to_timestamp(F.regexp_extract("file", r"[/=](\d{10})(\.[^/]*)?(/part-[^/]*)?$", 1), F.lit("yyyyMMddHH"))).where("obs_time is not null")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Station ids: the first column of a text."""
    return _lines(spark, path, "UTF-8").select(_number(0).cast("long").alias("station_id")).where("station_id is not null").distinct()


def keep_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of listed stations."""
    return rows.join(listed, "station_id", "left_semi")


def reference_probabilities(spark: SparkSession, paths: Paths) -> DataFrame:
    """mmddhh (from the file's name), station_id and its probabilities."""
    rows = _lines(spark, paths, "UTF-8").select(F.regexp_extract("file", r"[/=](\d{6})\.000(/part-[^/]*)?$", 1).alias("mmddhh"), _number(0).cast("long").alias("station_id"), F.transform(F.slice("fields", 2, 4), lambda x: x.try_cast("double")).alias("probs"))
    return rows.where("station_id is not null")


def with_reference(rows: DataFrame, reference: DataFrame, time: str = "valid_time") -> DataFrame:
    """Rows with the probabilities of their hour and station, NULL if there is none."""
    return rows.withColumn("mmddhh", F.date_format(time, "MMddHH")).join(reference, ["mmddhh", "station_id"], "left")


def best_track(spark: SparkSession, paths: Paths) -> DataFrame:
    """tcid, tcname, obs_time, lat, lon, pmin_hpa, vmax_ms: the analysis rows (lead 000) of best-track files."""
    lines = _lines(spark, paths)
    head = lines.where("n = 1").select("file", F.get("fields", F.lit(0)).alias("tcname"), F.get("fields", F.lit(1)).alias("tcid"))
    rows = lines.where("n >= 3").where(F.round(_number(4)) == 0)
    time = F.make_timestamp(_number(0).cast("int"), _number(1).cast("int"), _number(2).cast("int"), _number(3).cast("int"), F.lit(0), F.lit(0))
    rows = rows.select("file", time.alias("obs_time"), _number(5).alias("lon"), _number(6).alias("lat"), _number(7).alias("pmin_hpa"), _number(8).alias("vmax_ms"))
    return rows.join(head, "file").select("tcid", "tcname", "obs_time", "lat", "lon", "pmin_hpa", "vmax_ms")
