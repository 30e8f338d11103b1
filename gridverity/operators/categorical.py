"""Threshold scores: contingency tables, event probabilities, neighbourhoods, and station accumulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]

# fixed values: thresholds in mm by use and window
THRESHOLDS = {
    "categorical": {6: (0.1, 13.0, 25.0), 24: (0.1, 10.0, 25.0, 50.0, 100.0)},
    "classic": {6: (0.1, 3.0, 10.0, 20.0, 40.0), 24: (0.1, 10.0, 25.0, 50.0, 100.0, 250.0)},
    "probability": {6: (0.1, 4.0, 13.0, 25.0), 24: (0.1, 4.0, 13.0, 25.0)},
    "rain": {6: (0.1, 13.0, 25.0), 24: (0.1, 10.0, 25.0, 50.0, 100.0)},
}
# fixed values: weights of the composite score by window, in the order of its thresholds
COMPOSITE_WEIGHTS = {6: (0.4, 0.3, 0.3), 24: (0.3, 0.2, 0.2, 0.2, 0.1)}


def at_thresholds(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each row once for each threshold."""
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def contingency_table(pairs: DataFrame, keys: Keys, thresholds: Sequence[float], f: str = "fcst", o: str = "obs", missing_as_zero: bool = False) -> DataFrame:
    """Counts and scores of each group and threshold; missing_as_zero: a missing forecast is 0."""
    if missing_as_zero:
        pairs = pairs.withColumn(f, F.coalesce(F.col(f), F.lit(0.0)))
    # pairs are counted once for all thresholds: columns, not copies of the rows
    counts = pairs.groupBy(*keys).agg(*[F.struct(F.lit(float(t)).alias("threshold"), *c.contingency(f, o, F.lit(float(t)))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    counts = counts.select(*keys, F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("x")).select(*keys, "x.*")
    return counts.withColumns(c.skill_scores())


def pooled(table: DataFrame, keys: Keys) -> DataFrame:
    """Counts summed over all else, then scores."""
    sums = table.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("hits", "misses", "false_alarms", "n_pairs")])
    return sums.withColumns(c.skill_scores())


def composite(table: DataFrame, keys: Keys, weights: dict[float, float], score: str = "ts") -> DataFrame:
    """Weighted mean of a score over the thresholds where it exists."""
    w = F.when(F.lit(False), None)
    for t, x in weights.items():
        w = w.when(F.col("threshold") == float(t), float(x))
    return table.withColumn("__w", w).groupBy(*keys).agg(c.weighted_mean(score, "__w").alias(f"{score}_composite"))


def event_histogram(rows: DataFrame, keys: Keys, thresholds: Sequence[float], members: str = "members", o: str = "obs") -> DataFrame:
    """Cells by threshold, number of members that reach it, and event; only cells with the observation and all members.

    Members are counted for all thresholds within their row, and only the counts are copied.
    """
    whole = rows.where(F.col(o).isNotNull() & ~F.exists(members, lambda x: x.isNull() | F.isnan(x)))
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.size(F.filter(members, lambda v: v >= F.lit(float(t)))).alias("k"), (F.col(o) >= float(t)).cast("int").alias("event")) for t in thresholds]
    x = whole.select(*keys, F.size(members).alias("m"), F.explode(F.array(*each)).alias("__x")).select(*keys, "m", "__x.*")
    return x.groupBy(*keys, "threshold", "m", "k").agg(F.count(F.when(F.col("event") == 0, 1)).alias("h0"), F.count(F.when(F.col("event") == 1, 1)).alias("h1"))


def member_shares(rows: DataFrame, keep: Keys, thresholds: Sequence[float], members: str = "members", o: str = "obs") -> DataFrame:
    """(keep, threshold, p, event): share of present members that reach each threshold, and whether the observation does."""
    each = [F.struct(F.lit(float(t)).alias("threshold"), c.exceed_share(members, F.lit(float(t))).alias("p"), (F.col(o) >= float(t)).cast("int").alias("event")) for t in thresholds]
    return rows.select(*keep, F.explode(F.array(*each)).alias("__x")).select(*keep, "__x.*")


def probability_scores(histogram: DataFrame, keys: Keys) -> DataFrame:
    """bs, base_rate, bs_ref, bss and aroc of each group and threshold of event_histogram()."""
    by = [*keys, "threshold"]
    p = F.col("k") / F.col("m")
    down = W.partitionBy(*by).orderBy(F.desc("k"))
    run = down.rowsBetween(W.unboundedPreceding, 0)
    x = histogram.withColumns({"__h": F.sum("h1").over(run), "__f": F.sum("h0").over(run), "__n1": F.sum("h1").over(W.partitionBy(*by)), "__n0": F.sum("h0").over(W.partitionBy(*by))})
    x = x.withColumns({"__pod": c.ratio("__h", "__n1"), "__pofd": c.ratio("__f", "__n0")})
    x = x.withColumn("__area", (F.col("__pofd") - F.coalesce(F.lag("__pofd").over(down), F.lit(0.0))) * (F.col("__pod") + F.coalesce(F.lag("__pod").over(down), F.lit(0.0))) / 2)
    out = x.groupBy(*by).agg(
        c.ratio(F.sum(F.col("h0") * p * p + F.col("h1") * (1 - p) * (1 - p)), F.sum(F.col("h0") + F.col("h1"))).alias("bs"),
        c.ratio(F.sum("h1").cast("double"), F.sum(F.col("h0") + F.col("h1"))).alias("base_rate"),
        F.when((F.max("__n1") > 0) & (F.max("__n0") > 0), F.sum("__area")).alias("aroc"),
        F.sum(F.col("h0") + F.col("h1")).alias("n_points"),
    )
    out = out.withColumn("bs_ref", F.col("base_rate") * (1 - F.col("base_rate")))
    return out.withColumn("bss", 1 - c.ratio("bs", "bs_ref"))


def with_average(scores: DataFrame, keys: Keys) -> DataFrame:
    """scores (threshold, aroc, bs, bss) and a row of their means over thresholds (threshold NULL); bs counts only where bss exists."""
    mean = scores.groupBy(*keys).agg(F.avg("aroc").alias("aroc"), F.avg(F.when(F.col("bss").isNotNull(), F.col("bs"))).alias("bs"), F.avg("bss").alias("bss"), F.count("aroc").alias("n_used"))
    return scores.unionByName(mean, allowMissingColumns=True)


def reference_brier(rows: DataFrame, keys: Keys, p: str = "p", event: str = "event", ref: str = "p_ref") -> DataFrame:
    """bs, bs_ref and bss against reference probabilities; a missing one is 0."""
    r = F.coalesce(F.col(ref), F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.avg((F.col(p) - F.col(event)) ** 2).alias("bs"), F.avg((r - F.col(event)) ** 2).alias("bs_ref"))
    return out.withColumn("bss", F.when(F.col("bs_ref") > 0, 1 - F.col("bs") / F.col("bs_ref")))


def weighted_brier_skill(rows: DataFrame, keys: Keys, p: str = "p", event: str = "event", w: str = "w") -> DataFrame:
    """Weighted bs, and bss against the weighted base rate; NULL where the event is certain."""
    out = rows.groupBy(*keys).agg(c.weighted_mean((F.col(p) - F.col(event)) ** 2, w).alias("bs"), c.weighted_mean(F.col(event).cast("double"), w).alias("__rate"))
    ref = F.col("__rate") * (1 - F.col("__rate"))
    return out.withColumn("bss", F.when(ref > 0, 1 - F.col("bs") / ref)).drop("__rate")


def weighted_roc(rows: DataFrame, keys: Keys, p: str = "p", event: str = "event", w: str = "w", undefined: float | None = None) -> DataFrame:
    """Area under the ROC of weighted points: thresholds are the distinct positive probabilities; closed at (1, 1).

    Where the event always or never happens there is no curve: `undefined`, NULL by default.
    """
    at = rows.groupBy(*keys, p).agg(F.sum(F.when(F.col(event) == 1, F.col(w)).otherwise(0.0)).alias("h"), F.sum(F.when(F.col(event) == 0, F.col(w)).otherwise(0.0)).alias("f"))
    down = W.partitionBy(*keys).orderBy(F.desc(p))
    run = down.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    x = at.withColumns({"__pod": c.ratio(F.sum("h").over(run), F.sum("h").over(whole)), "__pofd": c.ratio(F.sum("f").over(run), F.sum("f").over(whole))})
    area = (F.col("__pofd") - F.coalesce(F.lag("__pofd").over(down), F.lit(0.0))) * (F.col("__pod") + F.coalesce(F.lag("__pod").over(down), F.lit(0.0))) / 2
    total = F.sum("__a")
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))  # these skip NULL
    return x.withColumn("__a", area).groupBy(*keys).agg(F.when(total.isNotNull(), within).otherwise(F.lit(undefined).cast("double")).alias("aroc"))


def fractions_skill(cells: DataFrame, keys: Keys, threshold: float, windows: Sequence[int], f: str = "fcst", o: str = "obs", lat_i: str = "lat_i", lon_i: str = "lon_i") -> DataFrame:
    """Fractions skill score for square windows of n cells, over the cells that are there; those that are not count as 0.

    Two passes of moving sums, along each axis, on the full grid of each field's rows
    and columns: a missing cell hides none of its neighbours.
    """
    base = cells.select(*keys, lat_i, lon_i, (F.col(f) >= threshold).cast("double").alias("__f"), (F.col(o) >= threshold).cast("double").alias("__o"), F.lit(True).alias("__there"))
    axes = base.groupBy(*keys).agg(F.collect_set(lat_i).alias("__rows"), F.collect_set(lon_i).alias("__cols"))  # as long as the grid's sides
    grid = axes.select(*keys, F.explode("__rows").alias(lat_i), "__cols").select(*keys, lat_i, F.explode("__cols").alias(lon_i))
    base = grid.join(base, [*keys, lat_i, lon_i], "left")
    names = [(n, f"__f{n}", f"__o{n}") for n in windows]
    row = lambda n: W.partitionBy(*keys, lat_i).orderBy(lon_i).rangeBetween(-(n // 2), n // 2)
    col = lambda n: W.partitionBy(*keys, lon_i).orderBy(lat_i).rangeBetween(-(n // 2), n // 2)
    x = base.withColumns({y: F.sum(v).over(row(n)) for n, yf, yo in names for y, v in ((yf, "__f"), (yo, "__o"))})
    x = x.withColumns({y: F.sum(y).over(col(n)) / (n * n) for n, yf, yo in names for y in (yf, yo)}).where("__there")
    p = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    scores = [F.struct(F.lit(n).alias("window"), (1 - c.ratio(F.sum((p(yf) - p(yo)) ** 2), F.sum(p(yf) ** 2 + p(yo) ** 2))).alias("fss")).alias(f"__w{n}") for n, yf, yo in names]
    x = x.groupBy(*keys).agg(*scores)
    return x.select(*keys, F.explode(F.array(*[f"__w{n}" for n, _, _ in names])).alias("__x")).select(*keys, "__x.fss", "__x.window")


def complete_windows(hours: DataFrame, n_hours: int, station: str = "station_id", time: str = "obs_time", value: str = "rain") -> DataFrame:
    """Sums over (t - n_hours, t] at each station hour whose window has every hour."""
    seconds = F.col(time).cast("timestamp").cast("long")
    w = W.partitionBy(station).orderBy("__s").rangeBetween(-(n_hours - 1) * 3600, 0)
    out = hours.withColumn("__s", seconds).withColumns({"__n": F.count(value).over(w), "total": F.sum(value).over(w)})
    return out.where(F.col("__n") == n_hours).drop("__s", "__n")


def hourly_sums(hours: DataFrame, ends: DataFrame, n_hours: int, keys: Keys, time: str = "obs_time", value: str = "rain") -> DataFrame:
    """Sums over (end - n_hours, end] for each end, with the hours found and missing; missing hours count as nothing, negative amounts as 0.

    An end without any hour has no row.
    """
    seconds = lambda x: F.col(x).cast("timestamp").cast("long")
    back = F.explode(F.sequence(F.lit(0), F.lit(n_hours - 1)))
    slots = ends.withColumn("__h", back).withColumn("__s", seconds("end") - F.col("__h") * 3600).drop("__h")
    x = hours.withColumn("__s", seconds(time)).withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    out = slots.join(x.select(*keys, "__s", value), "__s").groupBy("end", *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n_found"))
    return out.where("n_found > 0").withColumn("n_missing", F.lit(n_hours) - F.col("n_found"))


def latest_station_sums(hours: DataFrame, ends: DataFrame, n_hours: int, station: str = "station_id", time: str = "obs_time", value: str = "rain") -> DataFrame:
    """Sums over (end - n_hours, end] of the stations that the window's latest hour has; their missing hours and negative amounts are 0.

    A window of which a single hour is there gives that hour's amounts.
    """
    seconds = lambda x: F.col(x).cast("timestamp").cast("long")
    slots = ends.select("end", F.explode(F.sequence(F.lit(0), F.lit(n_hours - 1))).alias("__h")).select("end", (seconds("end") - F.col("__h") * 3600).alias("__s"))
    x = slots.join(hours.select(station, seconds(time).alias("__s"), F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)).alias(value)), "__s")
    latest = x.groupBy("end").agg(F.max("__s").alias("__last"), F.count_distinct("__s").alias("n_hours"))
    out = x.join(latest, "end").groupBy("end", station, "n_hours").agg(F.sum(value).alias("total"), F.max(F.col("__s") == F.col("__last")).alias("__there"))
    return out.where("__there").drop("__there")


def lenient_windows(hours: DataFrame, n_hours: int, station: str = "station_id", time: str = "obs_time", value: str = "rain") -> DataFrame:
    """Sums over (t - n_hours, t] at each station hour; missing hours and negative amounts are 0."""
    seconds = F.col(time).cast("timestamp").cast("long")
    w = W.partitionBy(station).orderBy("__s").rangeBetween(-(n_hours - 1) * 3600, 0)
    x = hours.withColumns({"__s": seconds, value: F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))})
    return x.withColumns({"total": F.sum(value).over(w), "n_hours": F.count(F.lit(1)).over(w)}).drop("__s")
