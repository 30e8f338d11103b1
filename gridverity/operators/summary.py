"""Roll-ups of metric tables: per-date rows, means over dates, long form, curves and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]


def batch_row(scores: DataFrame, keys: Keys, value: str, lead: str = "lead_h", at: float = 24.0) -> DataFrame:
    """A value at the lead nearest to 24 h (the earlier on a tie), at the last lead, and its mean."""
    return scores.groupBy(*keys).agg(
        F.min_by(value, F.struct(F.abs(F.col(lead) - at), F.col(lead))).alias(f"{value}_24h"), F.max_by(value, lead).alias(f"{value}_last"), F.avg(value).alias(f"{value}_mean"), F.count_distinct(lead).alias("n_leads")
    )


def mean_over_dates(scores: DataFrame, keys: Keys, values: Keys, date: str = "init") -> DataFrame:
    """Means of daily values (not pooled anew), with the number of dates."""
    return scores.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count_distinct(date).alias("n_dates"))


def ratio_of_means(scores: DataFrame, keys: Keys, a: str, b: str, name: str = "ratio") -> DataFrame:
    """Mean of a over mean of b."""
    return scores.groupBy(*keys).agg(c.ratio(F.avg(a), F.avg(b)).alias(name))


def long_form(scores: DataFrame, ids: Keys, values: Keys) -> DataFrame:
    """One row for each value: ids, metric, value; missing ones go."""
    return scores.unpivot(list(ids), list(values), "metric", "value").where(F.col("value").isNotNull())


def lead_band(scores: DataFrame, keys: Keys, value: str = "value", lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """mean, linear-interpolated lower and upper percentile, and n of each group."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"), F.count(value).alias("n"))


def series_statistics(curves: DataFrame, keys: Keys, value: str = "value", lead: str = "lead_h") -> DataFrame:
    """first, middle, last, mean, rises, falls, and last over first of each lead curve."""
    by = W.partitionBy(*keys).orderBy(lead)
    x = curves.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(by), "__n": F.count(F.lit(1)).over(W.partitionBy(*keys)), "__d": F.col(value) - F.lag(value).over(by)})
    at = lambda cond: F.max(F.when(cond, F.col(value)))
    out = x.groupBy(*keys).agg(
        at(F.col("__r") == 1).alias("first"), at(F.col("__r") == F.floor(F.col("__n") / 2) + 1).alias("middle"), at(F.col("__r") == F.col("__n")).alias("last"),
        F.avg(value).alias("mean"), F.count(F.when(F.col("__d") > 0, 1)).alias("n_rise"), F.count(F.when(F.col("__d") < 0, 1)).alias("n_fall"),
    )
    return out.withColumn("last_over_first", c.ratio("last", "first"))


def box_statistics(values: DataFrame, keys: Keys, value: str = "value", label: str = "lead_h") -> DataFrame:
    """Quartiles, IQR, whiskers (farthest values inside 1.5 IQR, else the quartile), and the labels of outliers in order."""
    q = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    x = values.where(F.col(value).isNotNull()).join(q, list(keys))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    out = x.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("__lo"), F.max(F.when(inside, F.col(value))).alias("__hi"), F.array_sort(F.collect_list(F.when(~inside, F.col(label)))).alias("outliers"), F.count(F.lit(1)).alias("n")
    )
    return out.select(*keys, "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), F.coalesce("__lo", "q1").alias("whisker_lo"), F.coalesce("__hi", "q3").alias("whisker_hi"), "outliers", "n")


def ts_summary(table: DataFrame, keys: Keys) -> DataFrame:
    """Scores of counts pooled over leads, means of the leads' scores, and decay from the first lead to the last."""
    pooled = table.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("hits", "misses", "false_alarms", "n_pairs")], F.avg("ts").alias("ts_mean"), F.count_distinct("lead_h").alias("n_leads"), F.min_by("ts", "lead_h").alias("ts_first"), F.max_by("ts", "lead_h").alias("ts_last"), ((F.max("lead_h") - F.min("lead_h")) / 24).alias("days"))
    pooled = pooled.withColumns(c.skill_scores())
    return pooled.withColumn("decay_per_day", c.ratio(F.col("ts_first") - F.col("ts_last"), "days"))


def ts_diagnosis(table: DataFrame) -> DataFrame:
    """Rule columns: overforecast, weak, rare, and the mark of the threat score."""
    return table.withColumns({
        "overforecast": (F.col("bias_score") > 1.3) & (F.col("far") > 0.45),
        "weak": (F.col("ts") < 0.15) & (F.col("threshold") >= 25),
        "rare": (F.col("hits") + F.col("misses")) < 50,
        "mark": F.when(F.col("ts") >= 0.3, "good").when(F.col("ts") >= 0.2, "fair").otherwise("poor"),
    })


def curve_changes(curves: DataFrame, keys: Keys, value: str = "ts", lead: str = "lead_h", eps: float = 0.005, floor: float = 0.10) -> DataFrame:
    """Rises above eps, whether the last three leads are flat, and the first lead below a floor."""
    by = W.partitionBy(*keys).orderBy(lead)
    x = curves.withColumns({"__d": F.col(value) - F.lag(value).over(by), "__back": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(lead)))})
    return x.groupBy(*keys).agg(
        F.count(F.when(F.col("__d") > eps, 1)).alias("n_rises"),
        F.coalesce(F.max(F.when((F.col("__back") <= 2) & F.col("__d").isNotNull(), F.abs("__d"))) < eps, F.lit(False)).alias("plateau"),
        F.min(F.when(F.col(value) < floor, F.col(lead))).alias("first_below"),
    )


def winner_flips(scores: DataFrame, keys: Keys, order: str, model: str = "model", value: str = "value") -> DataFrame:
    """Winner at each step of an order (the larger value; ties to the smaller model) and whether it changed."""
    best = scores.groupBy(*keys, order).agg(F.min_by(model, F.struct(-F.col(value), F.col(model))).alias("winner"))
    last = F.lag("winner").over(W.partitionBy(*keys).orderBy(order))
    return best.withColumn("flip", F.coalesce(last != F.col("winner"), F.lit(False)))


def deterministic_summary(scores: DataFrame, keys: Keys) -> DataFrame:
    """Means over dates of rmse, acc and activity; a missing bias or ratio is derived for each date first."""
    x = scores.withColumns({"fa_bias": F.coalesce("fa_bias", F.col("fa_pred") - F.col("fa_obs")), "fa_ratio": F.coalesce("fa_ratio", c.ratio("fa_pred", "fa_obs"))})
    return mean_over_dates(x, keys, ("rmse", "acc", "fa_pred", "fa_obs", "fa_bias", "fa_ratio"))


def ensemble_summary(scores: DataFrame, keys: Keys) -> DataFrame:
    """Means over dates of crps and the spread-error ratio, with the number of leads and of dates that have a crps."""
    return scores.groupBy(*keys).agg(F.avg("crps").alias("crps"), F.avg("spread_error_ratio").alias("spread_error_ratio"), F.count_distinct(F.when(F.col("crps").isNotNull(), F.col("lead_h"))).alias("n_leads_crps"), F.count_distinct(F.when(F.col("crps").isNotNull(), F.col("init"))).alias("n_dates_crps"))
