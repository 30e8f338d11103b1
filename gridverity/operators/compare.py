"""Comparison of models on common dates: relative scores, ranks, pair tests, anomalies and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.tests_of_rank import holm, verdict, wilcoxon

Keys = Sequence[str]

# fixed values: lead bands (lo, hi] in hours
LEAD_BANDS = ((0, 120), (120, 240), (240, 360))


def common_dates(scores: DataFrame, date: str = "init", model: str = "model") -> DataFrame:
    """Rows of dates that every model has."""
    n = scores.agg(F.count_distinct(model).alias("__n"))
    have = scores.groupBy(date).agg(F.count_distinct(model).alias("__m"))
    dates = have.join(F.broadcast(n), F.col("__m") == F.col("__n")).select(date)
    return scores.join(dates, date, "left_semi")


def shared_variables(scores: DataFrame, value: str, model: str = "model") -> DataFrame:
    """Variables that have some value in every model."""
    n = scores.agg(F.count_distinct(model).alias("__n"))
    have = scores.where(F.col(value).isNotNull()).groupBy("variable").agg(F.count_distinct(model).alias("__m"))
    return have.join(F.broadcast(n), F.col("__m") == F.col("__n")).select("variable")


def relative(scores: DataFrame, keys: Keys, value: str = "rmse", name: str = "relative") -> DataFrame:
    """100 times a value over the geometric mean of its group's models; only positive values count."""
    ln = F.when(F.col(value) > 0, F.log(value))
    return scores.withColumn(name, F.when(F.col(value) > 0, 100 * F.col(value) / F.exp(F.avg(ln).over(W.partitionBy(*keys)))))


def composite_relative(scores: DataFrame, by: Keys = (), value: str = "rmse", model: str = "model") -> DataFrame:
    """Mean over variables of the relative value, by model and `by`."""
    return relative(scores, ["variable", *by], value).groupBy(model, *by).agg(F.avg("relative").alias("relative"))


def ranks(table: DataFrame, scores: dict[str, bool], family: Keys = ()) -> DataFrame:
    """Ranks (ties share the least) of each score, True where low is good, and their mean; a missing score has no rank."""
    out = table
    names = []
    for name, low in scores.items():
        has = F.col(name).isNotNull()
        order = F.col(name).asc_nulls_last() if low else F.col(name).desc_nulls_last()
        out = out.withColumn(f"{name}_rank", F.when(has, F.rank().over(W.partitionBy(*family).orderBy(order))))
        names.append(f"{name}_rank")
    return out.withColumn("mean_rank", sum(F.col(n) for n in names) / len(names))


def activity_deviation(scores: DataFrame, model: str = "model") -> DataFrame:
    """100 times the mean distance of activity ratios from 1, over variables at each lead, then over leads."""
    leads = scores.groupBy(model, "lead_h").agg(F.avg(F.abs(F.col("fa_ratio") - 1)).alias("d"))
    return leads.groupBy(model).agg((100 * F.avg("d")).alias("fa_deviation"))


def log_spectrum_rms(spectra: DataFrame, keys: Keys, base10: bool = False, k_min: int = 1, k_max: int = 720, date: str = "init") -> DataFrame:
    """100 times the root mean square log ratio of spectra over wave numbers, by date, then over dates."""
    good = (F.col("pred") > 0) & (F.col("obs") > 0) & F.col("wavenumber").between(k_min, k_max)
    ln = F.log(F.col("pred") / F.col("obs"))
    ln = ln / F.log(F.lit(10.0)) if base10 else ln
    by_date = spectra.where(good).groupBy(*keys, date).agg(F.sqrt(F.avg(ln * ln)).alias("r"))
    return by_date.groupBy(*keys).agg((100 * F.avg("r")).alias("log_rms"))


def band_energy_ratio(bands: DataFrame, keys: Keys) -> DataFrame:
    """Mean over dates of forecast power over that of the observed: a ratio of means."""
    return bands.groupBy(*keys, "band").agg(c.ratio(F.avg("pred"), F.avg("obs")).alias("energy_ratio"))


def pooled_log_rms(samples: DataFrame, keys: Keys) -> DataFrame:
    """Log root mean square, mean ratio and bias in percent over all samples of spherical powers."""
    x = samples.where((F.col("pred") > 0) & (F.col("obs") > 0))
    ln = F.log(F.col("pred") / F.col("obs"))
    return x.groupBy(*keys).agg((100 * F.sqrt(F.avg(ln * ln))).alias("log_rms"), F.avg(F.col("pred") / F.col("obs")).alias("mean_ratio"), (100 * (F.avg(F.col("pred") / F.col("obs")) - 1)).alias("bias_pct"))


def band_shares(bands: DataFrame, keys: Keys) -> DataFrame:
    """Each band's power, ratio, share of the observed, and the ratio of totals."""
    w = W.partitionBy(*keys)
    return bands.withColumns({"energy_ratio": c.ratio("pred", "obs"), "obs_share": c.ratio("obs", F.sum("obs").over(w)), "total_ratio": c.ratio(F.sum("pred").over(w), F.sum("obs").over(w))})


def anomalies(scores: DataFrame, value: str = "rmse", model: str = "model", limit: float = 3.0) -> DataFrame:
    """By variable: the worst model, its value over the median of all models and over that of the others, and whether it is flagged."""
    by = scores.groupBy("variable").agg(F.max(value).alias("worst"), F.max_by(model, F.struct(F.col(value), F.col(model))).alias("worst_model"), F.percentile(value, 0.5).alias("median"))
    others = scores.join(by.select("variable", "worst_model"), "variable").where(F.col(model) != F.col("worst_model")).groupBy("variable").agg(F.percentile(value, 0.5).alias("median_others"))
    out = by.join(others, "variable", "left").withColumns({"times_median": c.ratio("worst", "median"), "times_others": c.ratio("worst", "median_others")})
    return out.withColumn("flagged", F.coalesce(F.col("times_median") >= limit, F.lit(False)))


def without_variable(scores: DataFrame, variable: str, value: str = "rmse", model: str = "model") -> DataFrame:
    """Composite with and without a variable, and both orders."""
    full = composite_relative(scores, (), value, model).withColumnRenamed("relative", "full")
    less = composite_relative(scores.where(F.col("variable") != variable), (), value, model).withColumnRenamed("relative", "without")
    return ranks(full.join(less, model), {"full": True, "without": True}).drop("mean_rank").withColumn("moved", F.col("full_rank") != F.col("without_rank"))


def lead_bands(scores: DataFrame, value: str = "rmse", model: str = "model", bands: Sequence[tuple[int, int]] = LEAD_BANDS) -> DataFrame:
    """Composite by lead band."""
    band = F.when(F.lit(False), None)
    for lo, hi in bands:
        band = band.when((F.col("lead_h") > lo) & (F.col("lead_h") <= hi), f"{lo}_{hi}")
    x = scores.withColumn("band", band).where("band is not null").groupBy(model, "variable", "band").agg(F.avg(value).alias(value))
    return composite_relative(x, ("band",), value, model)


def model_pairs(scores: DataFrame, keys: Keys, value: str, model: str = "model", date: str = "init") -> DataFrame:
    """Values of each pair of models (model_a < model_b) on each date."""
    a = scores.select(*keys, date, F.col(model).alias("model_a"), F.col(value).alias("a"))
    b = scores.select(*keys, date, F.col(model).alias("model_b"), F.col(value).alias("b"))
    return a.join(b, [*keys, date]).where("model_a < model_b")  # as many rows as a date has pairs of models


def pair_report(scores: DataFrame, keys: Keys, value: str, lower_is_better: bool = True, family: Keys | None = None) -> DataFrame:
    """Means, difference in percent, signed-rank p, Holm-corrected p and winner of each pair of models."""
    pairs = model_pairs(scores, keys, value)
    by = [*keys, "model_a", "model_b"]
    means = pairs.groupBy(*by).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    tests = holm(wilcoxon(pairs, by), list(keys if family is None else family))
    out = means.join(tests, by).withColumn("delta_pct", 100 * c.ratio(F.col("mean_a") - F.col("mean_b"), "mean_b"))
    return out.withColumn("winner", verdict(F.col("mean_a"), F.col("mean_b"), F.col("p_holm"), lower_is_better))


def win_counts(report: DataFrame) -> DataFrame:
    """Over variables, how often each side of a pair is better at the uncorrected level."""
    v = verdict(F.col("mean_a"), F.col("mean_b"), F.col("p"))
    return report.groupBy("model_a", "model_b").agg(*[F.count(F.when(v == x, 1)).alias(f"n_{x}") for x in ("a", "b", "tie")])


def completeness(archive: DataFrame, declared: DataFrame, model: str = "model") -> DataFrame:
    """Declared (model, init, variable) that the archive lacks."""
    return declared.join(archive.select(model, "init", "variable").distinct(), [model, "init", "variable"], "left_anti")


def baseline_delta(scores: DataFrame, baseline: str, keys: Keys, value: str = "ts", model: str = "model", tie: float = 0.005) -> DataFrame:
    """Difference to a baseline model at each key, and whether it wins, loses or ties."""
    base = scores.where(F.col(model) == baseline).select(*keys, F.col(value).alias("base"))
    d = F.col(value) - F.col("base")
    x = scores.where(F.col(model) != baseline).join(base, list(keys)).withColumn("delta", d)
    return x.withColumn("outcome", F.when(F.abs("delta") < tie, "tie").when(F.col("delta") > 0, "win").otherwise("loss"))


def top(table: DataFrame, by: Keys, order, k: int) -> DataFrame:
    """The first k rows of each group."""
    return table.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
