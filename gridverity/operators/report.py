"""Tables of a field report: validated long tables, curves, gaps, choice of variables and models, and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compare, summary

Keys = Sequence[str]

# fixed values: the columns of a field table and of a threat score table, and the variable that leads a report
FIELD_COLUMNS = ("variable", "metric", "lead_h", "value")
TS_COLUMNS = ("grade", "lead_h", "TS")
PREFERRED = "z500"


def _checked(table: DataFrame, columns: Keys) -> DataFrame:
    table = table.select(*[F.col(f"`{c}`").alias(c.strip()) for c in table.columns])
    if lacking := [c for c in columns if c not in table.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}; there are {', '.join(table.columns)}")
    return table


def field_table(table: DataFrame) -> DataFrame:
    """A long table of field scores with numbers as numbers, unit and status; rows without a lead are left out, failed ones stay."""
    x = _checked(table, FIELD_COLUMNS)
    x = x.withColumns({c: F.col(c).try_cast("double") for c in ("lead_h", "value")}).where("lead_h is not null")
    x = x.withColumns({c: F.col(c).cast("string") for c in ("variable", "metric")})
    unit = F.coalesce(F.col("unit").cast("string"), F.lit("")) if "unit" in x.columns else F.lit("")
    status = F.coalesce(F.col("status").cast("string"), F.lit("success")) if "status" in x.columns else F.lit("success")
    return x.withColumns({"unit": unit, "status": status})


def ts_table(table: DataFrame) -> DataFrame:
    """A table of threat scores with numbers as numbers; the threshold comes from the grade, the miss rate from POD, where they are missing."""
    x = _checked(table, TS_COLUMNS)
    if "threshold_mm" not in x.columns:
        x = x.withColumn("threshold_mm", F.regexp_replace("grade", "≥", "").try_cast("double"))
    if "miss_rate" not in x.columns and "POD" in x.columns:
        x = x.withColumn("miss_rate", 1.0 - F.col("POD").try_cast("double"))
    numbers = [c for c in x.columns if c != "grade"]
    x = x.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return x.where("lead_h is not null and TS is not null")


def failed_groups(table: DataFrame) -> DataFrame:
    """metric, variable, n, lead_min, lead_max of rows that are no success."""
    bad = table.where("status <> 'success'")
    return bad.groupBy("metric", "variable").agg(F.count(F.lit(1)).alias("n"), F.min("lead_h").alias("lead_min"), F.max("lead_h").alias("lead_max"))


def field_curves(table: DataFrame) -> DataFrame:
    """Statistics of each metric's and variable's curve over leads (means of rows of one lead), with its unit."""
    good = table.where("status = 'success' and value is not null")
    units = good.groupBy("metric", "variable").agg(F.coalesce(F.min(F.when(F.col("unit") != "", F.col("unit"))), F.lit("")).alias("unit"))
    points = good.groupBy("metric", "variable", "lead_h").agg(F.avg("value").alias("value"))
    return summary.series_statistics(points, ["metric", "variable"]).join(units, ["metric", "variable"])


def missing_requested(table: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested (metric, variable) that have no successful value."""
    there = table.where("status = 'success' and value is not null").select("metric", "variable").distinct()
    return requested.join(there, ["metric", "variable"], "left_anti")


def leading_variable(scores: DataFrame, by: Keys = (), preferred: str = PREFERRED) -> DataFrame:
    """The variable that a report shows: the preferred one if it is there, else the first by name."""
    rank = F.struct((F.col("variable") != preferred).alias("other"), F.col("variable"))
    return scores.groupBy(*by).agg(F.min(rank).alias("x")).select(*by, F.col("x.variable").alias("variable"))


def primary_pairs(models: DataFrame, suffix: str) -> DataFrame:
    """(model, reference): each model whose name ends with the suffix, and the model that is named as the rest, or NULL."""
    names = models.select("model").distinct()
    low = F.lower("model")
    stem = F.regexp_replace(F.regexp_replace(low, f"_?{suffix}$", ""), "[_-]+$", "")
    main = names.where(low.endswith(suffix)).withColumn("__stem", stem)
    other = names.select(F.col("model").alias("reference"), F.lower("model").alias("__stem"))
    return main.join(other, "__stem", "left").select("model", "reference")


def four_score_ranks(table: DataFrame, spectrum: str = "spectrum_rms") -> DataFrame:
    """Mean rank of the relative rmse, the mean ACC (high is good), the activity deviation and a spectral score."""
    return compare.ranks(table, {"relative": True, "acc": False, "fa_deviation": True, spectrum: True})


def wave_report(spectra: DataFrame, bands: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Tables of a spectral report: zonal log errors by model and variable, band ratios and shares, and the ranks with the zonal score."""
    zonal = compare.log_spectrum_rms(spectra, ["model", "variable"])
    full = zonal.groupBy("model").agg(F.avg("log_rms").alias("zonal_rms"))
    return {
        "zonal": zonal,
        "bands": compare.band_energy_ratio(bands, ["model", "variable"]),
        "shares": compare.band_shares(bands.groupBy("model", "variable", "band").agg(F.avg("pred").alias("pred"), F.avg("obs").alias("obs")), ["model", "variable"]),
        "ranks": four_score_ranks(scores.join(full, "model"), "zonal_rms"),
    }


def grade_analysis(table: DataFrame, keys: Keys = ()) -> dict[str, DataFrame]:
    """Analyses of a threat score table by grade, by lead, of the structure of errors, and of stability."""
    by_grade = summary.ts_summary(table, [*keys, "threshold"])
    lead = table.groupBy(*keys, "lead_h").agg(F.avg("ts").alias("ts"), F.max_by("threshold", F.struct("ts", "threshold")).alias("best_threshold"))
    errors = table.groupBy(*keys, "threshold").agg(F.sum("misses").alias("misses"), F.sum("false_alarms").alias("false_alarms"))
    errors = errors.withColumn("kind", F.when(F.col("false_alarms") > F.col("misses"), "false alarms").when(F.col("false_alarms") < F.col("misses"), "misses").otherwise("even"))
    return {"grades": by_grade, "leads": lead, "structure": errors, "stability": summary.curve_changes(table, [*keys, "threshold"])}
