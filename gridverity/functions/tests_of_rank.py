"""Paired rank tests: exact and normal Wilcoxon p-values, and Holm's correction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Up to this many pairs, without ties and zeros, the distribution of the statistic is enumerated.
EXACT_PAIRS = 50
#: Two values are close if they differ by no more than this, plus this share of the second.
CLOSE = (1e-8, 1e-5)


def exact_p(w_plus: float, n: int) -> float:
    """Two-sided p-value of a signed-rank sum over n untied pairs, by counting subsets of ranks."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy()
    share = counts / 2.0**n
    w = int(round(min(w_plus, n * (n + 1) / 2 - w_plus)))
    return float(min(1.0, 2 * share[: w + 1].sum()))


def normal_p(w_plus: float, n: int, tie_term: float) -> float:
    """Two-sided p-value by the normal approximation; tie_term: sum of t^3 - t over groups of ties."""
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    if var <= 0:
        return 1.0
    return float(math.erfc(abs(w_plus - mean) / math.sqrt(var) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def signed_rank_p(w_plus: pd.Series, n: pd.Series, n_zero: pd.Series, tie_term: pd.Series, n_apart: pd.Series) -> pd.Series:
    """p-value from the statistic, pairs without zeros, dropped zeros, the tie term, and pairs that are not close; NaN for fewer than two pairs, 1 if all are close."""

    def one(w, k, z, t, apart):
        if k + z < 2:
            return float("nan")
        if apart == 0:
            return 1.0
        return exact_p(w, int(k)) if t == 0 and z == 0 and k <= EXACT_PAIRS else normal_p(w, int(k), t)

    return pd.Series([one(*x) for x in zip(w_plus, n, n_zero, tie_term, n_apart, strict=True)], dtype=float)


def signed_rank_statistics(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """w_plus, n (pairs that differ), n_zero, tie_term and n_apart (pairs that differ by more than CLOSE allows) of each group of pairs; average ranks for ties."""
    d = F.col(a) - F.col(b)
    x = pairs.where(d.isNotNull() & ~F.isnan(d)).withColumn("__d", d)
    absolute, share = CLOSE
    zeros = x.groupBy(*keys).agg(F.count(F.when(F.col("__d") == 0, 1)).alias("n_zero"), F.count(F.when(F.abs("__d") > absolute + share * F.abs(F.col(b)), 1)).alias("n_apart"))
    size = F.abs("__d")
    # rank groups of equal size, not rows: a hot group is summed up first
    t = x.where("__d != 0").groupBy(*keys, size.alias("__s")).agg(F.count(F.lit(1)).alias("__t"), F.count(F.when(F.col("__d") > 0, 1)).alias("__p"))
    before = F.coalesce(F.sum("__t").over(W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("__rank", before + (F.col("__t") + 1) / 2)
    stats = t.groupBy(*keys).agg(
        F.sum(F.col("__rank") * F.col("__p")).alias("w_plus"), F.sum("__t").alias("n"), F.sum((F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).cast("double")).alias("tie_term")
    )
    return zeros.join(stats, keys, "left").fillna({"w_plus": 0.0, "n": 0, "tie_term": 0.0})


def wilcoxon(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The statistics and p of each group of pairs (one small row for each group reaches Python)."""
    return signed_rank_statistics(pairs, keys, a, b).withColumn("p", signed_rank_p("w_plus", "n", "n_zero", "tie_term", "n_apart"))


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """tests with p_holm, step-down within each family; a missing p stays missing and does not count."""
    has = F.col(p).isNotNull() & ~F.isnan(p)
    order = W.partitionBy(*family, has).orderBy(p)
    raw = (F.count(F.lit(1)).over(W.partitionBy(*family, has)) - F.row_number().over(order) + 1) * F.col(p)
    x = tests.withColumn("__raw", raw)
    run = F.max("__raw").over(order.rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("p_holm", F.when(has, F.least(F.lit(1.0), run))).drop("__raw")


def verdict(a: Column, b: Column, p: Column, lower_is_better: bool = True, level: float = 0.05) -> Column:
    """'a', 'b' or 'tie'."""
    better = a < b if lower_is_better else a > b
    return F.when(p.isNull() | F.isnan(p) | (p >= level) | (a == b), "tie").when(better, "a").otherwise("b")
