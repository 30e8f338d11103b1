"""Ensemble scores on cells whose members are packed in an array: no shuffle before the final sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .categorical import member_shares

Keys = Sequence[str]


def pack_members(cells: DataFrame, keys: Keys, member: str = "member", value: str = "value") -> DataFrame:
    """One row for each cell, its members in the order of their names (NULL stays in its place)."""
    packed = F.array_sort(F.collect_list(F.struct(member, value)))
    return cells.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias("members"))


def ensemble_scores(cells: DataFrame, keys: Keys, members: str = "members", o: str = "obs", w: str = "w", weighted_spread: bool = False) -> DataFrame:
    """crps, its floored form over the weight of all cells, spread, the sample-variance spread, ensemble-mean rmse and their ratios.

    spread divides an unweighted sum of squares by the weights, unless weighted_spread.
    """
    o_, w_ = F.col(o), F.col(w)
    x = cells.select(
        *keys,
        w_.alias("w"),
        o_.alias("o"),
        c.crps(members, o).alias("crps"),
        c.members_std(members).alias("sd"),
        F.size(members).alias("m"),
        c.members_mean(members).alias("mean"),
    )
    # what follows from these needs no more passes over the members
    x = x.withColumns({"crps0": F.greatest("crps", F.lit(0.0)), "sd1": F.col("sd") * F.sqrt(c.ratio(F.col("m").cast("double"), F.col("m") - 1))})
    s2 = F.col("sd") * F.col("sd")
    out = x.groupBy(*keys).agg(
        c.weighted_mean("crps", "w").alias("crps"),
        c.ratio(F.sum(F.col("crps0") * F.col("w")), F.sum("w")).alias("crps_floored"),
        F.sqrt(c.ratio(F.sum(s2 * F.col("w") if weighted_spread else s2), F.sum(F.when(F.col("sd").isNotNull(), F.col("w"))))).alias("spread"),
        F.sqrt(c.weighted_mean(F.col("sd1") * F.col("sd1"), "w")).alias("spread_sample"),
        c.rmse("mean", "o").alias("rmse"),
    )
    return out.withColumns({"spread_error_ratio": c.ratio("spread", "rmse"), "sample_ratio": c.ratio("spread_sample", "rmse")})


def brier(cells: DataFrame, keys: Keys, thresholds: Sequence[float], members: str = "members", o: str = "obs", w: str = "w") -> DataFrame:
    """Weighted Brier score of each threshold."""
    x = member_shares(cells, [*keys, w], thresholds, members, o)
    return x.groupBy(*keys, "threshold").agg(c.weighted_mean((F.col("p") - F.col("event")) ** 2, w).alias("brier"))
