"""Configurations and capabilities: a dict names a capability and its data, a plan of DataFrames comes out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import align, categorical, compare, deterministic, ensemble, spectra, subseasonal, summary, tropical
from ..sources import archive, gridded, station_text

Result = dict[str, DataFrame]
CAPABILITIES: dict[str, Callable] = {}
#: Tables of a batch that have rows by start date; the others follow from them.
DATED = ("rmse", "anomaly", "spectrum_fcst", "spectrum_obs", "bands_fcst", "bands_obs", "spherical_fcst", "spherical_obs", "summary", "long")


@dataclass
class Config:
    """What to verify.  Paths are Parquet tables; metrics and variables None mean all."""

    type: str
    pred: str | None = None
    obs: str | None = None
    climo: str | None = None
    stations: str | None = None
    ref: str | None = None
    out: str | None = None
    name: str = "run"
    metrics: tuple[str, ...] = ("rmse",)
    variables: tuple[str, ...] | None = None
    var_metrics: dict[str, list[str]] = field(default_factory=dict)
    periods: tuple[tuple[str, str], ...] = ()
    bbox: tuple[float, float, float, float] | None = None
    pred_shift: int = 0
    lead_step: float = 6.0
    tz_shift: float = 8.0
    tp_scale: float = 1.0
    scales: dict[str, float] = field(default_factory=dict)
    interp: str = "bilinear"
    grid: tuple[int, int, float, float] = (721, 1440, -90.0, 0.25)
    clim_days: int = 365
    clim_per_day: int = 4
    acc_centred: bool = False
    ens_agg: str = "B"
    resume: bool = False
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict) -> Config:
        """From a plain dict; unknown names are an error, lists become tuples."""
        known = {f for f in cls.__dataclass_fields__}
        if extra := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        if given.get("type") not in CAPABILITIES:
            raise ValueError(f"unknown type {given.get('type')!r}; there are {', '.join(sorted(CAPABILITIES))}")
        return cls(**{k: tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, v)) if isinstance(v, list) else v for k, v in given.items()})


def capability(name: str):
    def add(f):
        CAPABILITIES[name] = f
        return f

    return add


def run(spark: SparkSession, config: dict | Config) -> Result:
    """Tables by name, lazily; with `out` set they are written below its fingerprint as well, and read from there.

    Tables by start date are written by date, so a resumed run adds the dates that are not there yet.
    """
    cfg = config if isinstance(config, Config) else Config.of(config)
    if not cfg.out:
        return CAPABILITIES[cfg.type](spark, cfg)
    root = archive_root(cfg)
    started = time.time()
    tables = CAPABILITIES[cfg.type](spark, cfg)
    dated = [name for name, df in tables.items() if cfg.type == "batch" and name in DATED and "init" in df.columns]
    for name in dated:
        archive.write_scores(tables[name].withColumn("init_date", F.to_date("init")), f"{root}/{name}")
    later = rolled_up(spark, root) if "rmse" in dated else {}
    for name in tables:
        if name not in dated:
            later.get(name, tables[name]).write.mode("overwrite").parquet(f"{root}/{name}")
    archive.write_meta(spark, f"{root}/meta", vars(cfg))
    archive.write_log(spark, f"{root}/log", [{"run": cfg.name, "type": cfg.type, "tables": sorted(tables), "seconds": round(time.time() - started, 3)}])
    return {name: spark.read.parquet(f"{root}/{name}") for name in tables}


def archive_root(cfg: Config) -> str:
    """Where a run's tables go: its name, and the fingerprint of all that decides its results."""
    return archive.archive_path(cfg.out, cfg.name, {k: v for k, v in vars(cfg).items() if k not in ("out", "resume")})


def run_all(spark: SparkSession, configs: list[dict]) -> dict[str, str | None]:
    """Run several; one that fails does not stop the others.  Name -> error or None."""
    out: dict[str, str | None] = {}
    for cfg in configs:
        try:
            run(spark, cfg)
            out[cfg.get("name", "run")] = None
        except Exception as e:
            out[cfg.get("name", "run")] = str(e).splitlines()[0]
    return out


# --- shared pieces ------------------------------------------------------------


def _fields(spark: SparkSession, cfg: Config, path: str) -> DataFrame:
    df = gridded.cells(spark, path, cfg.variables)
    if cfg.periods and "init" in df.columns:
        inside = F.lit(False)
        for a, b in cfg.periods:
            inside = inside | ((F.col("init") >= F.lit(a).cast("timestamp")) & (F.col("init") < F.date_add(F.lit(b).cast("date"), 1).cast("timestamp")))
        df = df.where(inside)
    if cfg.bbox:
        df = df.where(c.in_box("lat", "lon", *cfg.bbox))
    return df.withColumn("value", c.scaled("variable", "value", cfg.scales)) if cfg.scales else df


def _paired(spark: SparkSession, cfg: Config) -> DataFrame:
    pred = _fields(spark, cfg, cfg.pred).withColumnRenamed("value", "fcst")
    truth = gridded.cells(spark, cfg.obs, cfg.variables).select("variable", "valid_time", "lat_i", "lon_i", F.col("value").alias("obs"))
    out = align.at_valid_time(pred, truth, shift_h=cfg.pred_shift * cfg.lead_step)
    if cfg.climo:
        clim = spark.read.parquet(cfg.climo)
        out = align.climatology_at(out, clim, cfg.clim_days, cfg.clim_per_day)
    return out


def _keys(pairs: DataFrame) -> list[str]:
    """Groups of field scores: members are scored each, where there are any."""
    return ["init", "lead_h", "variable", *(["member"] if "member" in pairs.columns else [])]


@capability("weather_field_scores")
def field_scores(spark: SparkSession, cfg: Config) -> Result:
    pairs = _paired(spark, cfg)
    keys = _keys(pairs)
    out: Result = {}
    if "rmse" in cfg.metrics:
        out["rmse"] = deterministic.error_scores(pairs, keys)
    if cfg.climo and {"acc", "fa"} & set(cfg.metrics):
        out["anomaly"] = deterministic.anomaly_scores(pairs, keys)
    if "spectrum" in cfg.metrics:
        out |= _spectra(spark, pairs, keys, cfg)
    return {k: _listed(df, cfg, "rmse" if k == "rmse" else "spectrum" if k[:2] in ("sp", "ba") else "acc") for k, df in out.items()}


def _spectra(spark: SparkSession, pairs: DataFrame, keys: list[str], cfg: Config) -> Result:
    """Zonal spectra and band powers of both sides, and spherical powers and bands of fields that reach both poles."""
    out: Result = {}
    degrees = int(cfg.options.get("degrees", 128))
    for side in ("fcst", "obs"):
        ring = pairs.groupBy(*keys, "lat_i", "lat").agg(F.array_sort(F.collect_list(F.struct("lon_i", side))).alias("values"))
        ring = ring.withColumn("values", F.col(f"values.{side}"))
        whole = ring.where(~F.exists("values", lambda v: v.isNull()))
        power = spectra.ring_spectrum(whole, [*keys, "lat_i", "lat"])
        bands = spectra.band_table(spark)
        out[f"spectrum_{side}"] = spectra.zonal_spectrum(power, keys)
        out[f"bands_{side}"] = spectra.band_power(out[f"spectrum_{side}"], keys, bands)
        degree = spectra.spherical_spectrum(whole, keys, degrees)
        out[f"spherical_{side}"] = spectra.band_power(degree.withColumnRenamed("degree", "wavenumber"), keys, bands, "power")
    return out


def _listed(df: DataFrame, cfg: Config, metric: str) -> DataFrame:
    """Rows of variables whose metrics include this one."""
    banned = [v for v, m in cfg.var_metrics.items() if metric not in m]
    return df.where(~F.col("variable").isin(*banned)) if banned else df


@capability("weather_ens_crps")
def ens_crps(spark: SparkSession, cfg: Config) -> Result:
    cells = _paired(spark, cfg)
    keys = ["init", "lead_h", "variable"]
    packed = ensemble.pack_members(cells.withColumnRenamed("fcst", "value"), [*keys, "lat_i", "lon_i", "lat", "obs"])
    out = {"scores": ensemble.ensemble_scores(deterministic.with_weight(packed), keys)}
    if thresholds := cfg.options.get("thresholds"):
        out["brier"] = ensemble.brier(deterministic.with_weight(packed), keys, thresholds)
    return out


@capability("weather_ens_field_scores")
def ens_field_scores(spark: SparkSession, cfg: Config) -> Result:
    pairs = _paired(spark, cfg)
    keys = ["init", "lead_h", "variable"]
    mean = pairs.groupBy(*keys, "lat_i", "lon_i", "lat", "obs", *(["clim"] if cfg.climo else [])).agg(F.avg("fcst").alias("fcst"))
    out = {"member_rmse": deterministic.error_scores(pairs, [*keys, "member"]), "rmse": deterministic.error_scores(mean, keys)}
    if cfg.climo:
        out["anomaly"] = deterministic.anomaly_scores(mean, keys)
    if "spectrum" in cfg.metrics:
        out |= _spectra(spark, mean, keys, cfg)
    return out | ens_crps(spark, cfg)


def _at_stations(spark: SparkSession, cfg: Config, cells: DataFrame, keys: list[str]) -> DataFrame:
    stations = spark.read.parquet(cfg.stations).select("station_id", "lat", "lon").distinct()
    n_lat, n_lon, lat0, step = cfg.grid
    if cfg.interp == "nearest":
        at = align.nearest_cell(stations, n_lat, n_lon, lat0, step).select("station_id", "lat_i", "lon_i")
        return cells.join(at, ["lat_i", "lon_i"]).select("station_id", *keys, "value")
    weights = align.corner_weights(stations, n_lat, n_lon, lat0, step).select("station_id", "lat_i", "lon_i", "weight")
    return align.to_stations(cells, weights, keys, "value")


def _rain(spark: SparkSession, cfg: Config, thresholds: tuple[float, ...], window_h: int, members: bool) -> Result:
    keys = ["init", "lead_h", "member"]
    pred = _fields(spark, cfg, cfg.pred).withColumn("value", F.col("value") * cfg.tp_scale)
    if not members:
        pred = pred.groupBy("init", "lead_h", "lat_i", "lon_i").agg(F.avg("value").alias("value")).withColumn("member", F.lit("mean"))
    at = deterministic.accumulate(_at_stations(spark, cfg, pred, keys), ["station_id", "init", "member"], "value", int(window_h / cfg.lead_step), cfg.lead_step)
    obs = categorical.complete_windows(spark.read.parquet(cfg.obs), window_h).select("station_id", F.col("obs_time").alias("valid_time"), F.col("total").alias("obs"))
    pairs = at.withColumn("valid_time", c.valid_time("init", "lead_h", cfg.tz_shift)).join(obs, ["station_id", "valid_time"]).withColumnRenamed("value", "fcst")
    if not members:
        return {"ts": categorical.contingency_table(pairs, ["lead_h"], thresholds)}
    # only stations with all members of their start are counted
    members_of = pred.groupBy("init").agg(F.count_distinct("member").alias("n_members"))
    packed = ensemble.pack_members(pairs, ["station_id", "init", "lead_h", "valid_time", "obs"], value="fcst").join(members_of, "init").where(F.size("members") == F.col("n_members"))
    scores = categorical.probability_scores(categorical.event_histogram(packed, ["lead_h"], thresholds), ["lead_h"])
    if cfg.ref:
        scores = _against_reference(spark, cfg, packed, scores, thresholds)
    return {"aroc_bss": categorical.with_average(scores, ["lead_h"])}


def _against_reference(spark: SparkSession, cfg: Config, packed: DataFrame, scores: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """scores with bs, bs_ref and bss against the reference probabilities in cfg.ref (Parquet, or their text files)."""
    reference = spark.read.parquet(cfg.ref) if cfg.ref.rstrip("/").endswith(".parquet") else station_text.reference_probabilities(spark, cfg.ref)
    whole = packed.where(F.col("obs").isNotNull() & ~F.exists("members", lambda x: x.isNull() | F.isnan(x)))
    rows = station_text.with_reference(whole, reference)
    shares = categorical.member_shares(rows, ["lead_h", "probs"], thresholds)
    at = F.array_position(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("threshold")).cast("int")
    external = categorical.reference_brier(shares.withColumn("p_ref", F.get("probs", at - 1)), ["lead_h", "threshold"])
    return scores.drop("bs", "bs_ref", "bss").join(external, ["lead_h", "threshold"])


@capability("weather_ts_det")
def ts_det(spark: SparkSession, cfg: Config) -> Result:
    return _rain(spark, cfg, categorical.THRESHOLDS["classic"][24], 24, False)


@capability("weather_ts_ens")
def ts_ens(spark: SparkSession, cfg: Config) -> Result:
    return _rain(spark, cfg, categorical.THRESHOLDS["classic"][24], 24, False)


@capability("weather_ts_ens_prob")
def ts_ens_prob(spark: SparkSession, cfg: Config) -> Result:
    return _rain(spark, cfg, categorical.THRESHOLDS["probability"][6], 6, True)


@capability("typhoon")
def typhoon(spark: SparkSession, cfg: Config) -> Result:
    """pred: cells (tcid, init, lead_h, member, lat, lon, msl and, for intensities, wind); obs: a best track.

    options: tcid (a list of storms), center_half, early_half, early_hours, intensity_half.
    """
    best = spark.read.parquet(cfg.obs)
    cells = spark.read.parquet(cfg.pred)
    if storms := cfg.options.get("tcid"):
        best = best.where(F.col("tcid").isin(*storms))
    starts = tropical.inits_from_best_track(best, cells, cfg.tz_shift)
    first = starts.withColumn("obs_time", c.valid_time("init", F.lit(0.0), cfg.tz_shift)).join(best, ["tcid", "obs_time"]).select("tcid", "init", "lat", "lon")
    run_id = F.concat_ws("|", "tcid", F.col("init").cast("string"), "member")
    keyed = cells.join(starts, ["tcid", "init"], "left_semi")
    labels = keyed.select("tcid", "init", "member").distinct().withColumn("run", run_id)
    at = labels.join(first, ["tcid", "init"]).select(F.col("run").alias("tcid"), "lat", "lon")
    found = tropical.track_storms(keyed.select(run_id.alias("tcid"), "lead_h", "lat", "lon", "msl"), at, cfg.options.get("center_half", 3.0), cfg.options.get("early_half", 4.0), cfg.options.get("early_hours", 12.0))
    tracks = found.withColumnRenamed("tcid", "run").join(labels, "run").drop("run")
    if "wind" in cells.columns:
        at = tracks.select("tcid", "init", "member", "lead_h", F.col("plat").alias("clat"), F.col("plon").alias("clon"))
        keys = ["tcid", "init", "member", "lead_h"]
        tracks = tracks.join(tropical.max_wind(keyed, at, keys, cfg.options.get("intensity_half", 5.0)), keys, "left")
    errors = tropical.track_errors(tropical.match_best_track(tracks, best, cfg.tz_shift), ["tcid", "init", "member"])
    if cfg.ens_agg == "A":
        return {"members": errors, "ensemble": tropical.ensemble_track_mean(errors, ["tcid", "init", "lead_h"])}
    mean = tropical.ensemble_mean_track(tracks, ["tcid", "init", "lead_h"])
    return {"members": errors, "ensemble": tropical.track_errors(tropical.match_best_track(mean, best, cfg.tz_shift), ["tcid", "init"])}


@capability("fdp_field_det")
def fdp_field_det(spark: SparkSession, cfg: Config) -> Result:
    pairs, keys = _paired(spark, cfg), ["model", "init", "lead_h", "variable"]
    out = {"scores": deterministic.error_scores(pairs, keys)}
    if cfg.climo:
        out["acc"] = deterministic.anomaly_scores(pairs.where("variable = 'z500'"), keys).select(*keys, F.col("acc_centred").alias("acc"))
    return out


@capability("fdp_ens")
def fdp_ens(spark: SparkSession, cfg: Config) -> Result:
    """Floored CRPS, spread, rmse and their ratio; with options["thresholds"] bss and aroc at each and their means, on weighted points.

    options["undefined_aroc"] stands for aroc where the event always or never happens (NULL, which the mean skips, by default).
    """
    keys = ["init", "lead_h", "variable"]
    cells = _paired(spark, cfg).withColumnRenamed("fcst", "value")
    packed = deterministic.with_weight(ensemble.pack_members(cells, [*keys, "lat_i", "lon_i", "lat", "obs"]))
    scores = ensemble.ensemble_scores(packed, keys)
    out = scores.select(*keys, F.col("crps_floored").alias("crps"), F.col("spread_sample").alias("spread"), "rmse", F.col("sample_ratio").alias("spread_error_ratio"))
    thresholds = cfg.options.get("thresholds", categorical.THRESHOLDS["probability"][6])
    whole = packed.where(F.col("obs").isNotNull() & ~F.exists("members", lambda x: x.isNull() | F.isnan(x)))
    shares = categorical.member_shares(whole, [*keys, "w"], thresholds)
    by = [*keys, "threshold"]
    skill = categorical.weighted_brier_skill(shares, by).join(categorical.weighted_roc(shares, by, undefined=cfg.options.get("undefined_aroc")), by)
    tag = lambda name, t: f"{name}_{float(t):g}mm"
    at = lambda name, t: F.max(F.when(F.col("threshold") == float(t), F.col(name))).alias(tag(name, t))
    wide = skill.groupBy(*keys).agg(F.avg("bss").alias("bss"), F.avg("aroc").alias("aroc"), *[at(n, t) for n in ("bss", "aroc") for t in thresholds])
    return {"scores": out.join(wide, keys, "left")}


@capability("fdp_activity_spectrum")
def fdp_activity_spectrum(spark: SparkSession, cfg: Config) -> Result:
    pairs, keys = _paired(spark, cfg), ["init", "lead_h", "variable"]
    n_lat, n_lon, _, _ = cfg.grid
    power = spectra.diagonal_spectrum(pairs.withColumnRenamed("fcst", "value"), keys, n_lat, n_lon, 30)
    wide = power.groupBy(*keys).pivot("k", list(range(31))).agg(F.first("p"))
    wide = wide.select(*keys, *[F.col(str(k)).alias(f"P{k}") for k in range(31)])
    return {"activity": deterministic.anomaly_scores(pairs, keys).select(*keys, "fa_ratio"), "spectrum": wide} if cfg.climo else {"spectrum": wide}


@capability("fdp_tp_det")
def fdp_tp_det(spark: SparkSession, cfg: Config) -> Result:
    """pred and obs: rain on one grid; thresholds of the window in options['window'] (6 or 24)."""
    pairs, window = _paired(spark, cfg), int(cfg.options.get("window", 24))
    keys = ["init", "lead_h"]
    thresholds = categorical.THRESHOLDS["rain"][window]
    table = categorical.contingency_table(pairs, keys, thresholds, missing_as_zero=True)
    weights = dict(zip(thresholds, categorical.COMPOSITE_WEIGHTS[window], strict=True))
    china = pairs.where(c.in_box("lat", "lon", 15, 55, 70, 140))
    return {
        "ts": table,
        "composite": categorical.composite(table, keys, weights).join(categorical.composite(table, keys, weights, "bias_score"), keys),
        "fss": categorical.fractions_skill(china, keys, cfg.options.get("fss_threshold", 13.0), cfg.options.get("fss_windows", (1, 3, 5, 15, 31, 63))),
    }


@capability("s2s_det")
def s2s_det(spark: SparkSession, cfg: Config) -> Result:
    """pred: (init_date, lead_day, member, variable, lat_i, lon_i, lat, lon, value); obs: (day, variable, lat_i, lon_i, value)."""
    cell = ["variable", "lat_i", "lon_i"]
    obs = spark.read.parquet(cfg.obs)
    clim = subseasonal.daily_climatology(obs, cell)
    anomaly = subseasonal.daily_anomaly(obs, clim, cell)
    pred = spark.read.parquet(cfg.pred).groupBy("init_date", "lead_day", *cell, "lat", "lon").agg(F.avg("value").alias("value"))
    model_clim = pred.withColumn("mmdd", F.date_format("init_date", "MMdd")).groupBy("mmdd", "lead_day", *cell).agg(F.avg("value").alias("clim"))
    model = pred.withColumn("mmdd", F.date_format("init_date", "MMdd")).join(model_clim, ["mmdd", "lead_day", *cell]).withColumn("fcst", F.col("value") - F.col("clim"))
    truth = subseasonal.assemble_leads(pred.select("init_date").distinct(), anomaly, cell, int(cfg.options.get("lead_time", 60)), dense=False)
    f = subseasonal.weekly_means(model, ["init_date", *cell, "lat", "lon"], "fcst")
    o = subseasonal.weekly_means(truth, ["init_date", *cell], "anomaly")
    skill = subseasonal.temporal_skill(f.join(o, ["init_date", "week", *cell]), ["week", *cell, "lat", "lon"], "fcst", "anomaly")
    skill = skill.withColumn("p", c.clean(subseasonal.correlation_p("tcc", "n")))
    out = {"maps": skill}
    if regions := cfg.options.get("regions"):
        table = spark.createDataFrame([tuple(r) for r in regions], "name string, lat0 double, lat1 double, lon0 double, lon1 double")
        out["regions"] = deterministic.weighted_region_mean(skill, table, ["week", "variable"], "tcc").join(deterministic.weighted_region_mean(skill, table, ["week", "variable"], "rmse"), ["name", "week", "variable"])
    return out


@capability("batch")
def batch(spark: SparkSession, cfg: Config) -> Result:
    """Field scores of all starts in the periods, and their roll-ups; a resumed run skips dates that its archive has.

    options["layout"]: "cells" (one table), "families" (pred holds the tables surface and levels, variables
    renamed by options["rename"]) or "directories" (both sides are trees of tables by date, wide or long).
    """
    scores = field_scores(spark, _laid_out(spark, cfg))
    if cfg.resume and cfg.out:
        done = archive.finished_dates(spark, f"{archive_root(cfg)}/rmse", "init_date")
        scores = {k: df.join(done.withColumnRenamed("init_date", "__d"), F.to_date("init") == F.col("__d"), "left_anti") for k, df in scores.items()}
    return scores | _roll_ups(scores["rmse"])


def _roll_ups(rmse: DataFrame) -> Result:
    keys = ["variable", "lead_h", *(["member"] if "member" in rmse.columns else [])]
    return {
        "summary": summary.batch_row(rmse, ["init", *(k for k in keys if k != "lead_h")], "rmse"),
        "mean": summary.mean_over_dates(rmse, keys, ["rmse", "bias"]),
        "long": summary.long_form(rmse, ["init", *keys], ["rmse", "bias"]),
    }


def rolled_up(spark: SparkSession, root: str) -> Result:
    """Roll-ups of all dates that an archive has, those of earlier runs included."""
    return _roll_ups(spark.read.parquet(f"{root}/rmse").drop("init_date"))


def _laid_out(spark: SparkSession, cfg: Config) -> Config:
    """The configuration with forecast and truth as cell tables, whatever the layout."""
    layout = cfg.options.get("layout", "cells")
    if layout == "cells":
        return cfg
    if layout == "families":
        pred: DataFrame | str = gridded.two_families(spark.read.parquet(f"{cfg.pred}/surface"), spark.read.parquet(f"{cfg.pred}/levels"), cfg.options.get("rename", {}))
        return replace(cfg, pred=pred)
    if layout == "directories":
        return replace(cfg, pred=gridded.dual_layout(spark.read.parquet(cfg.pred)), obs=gridded.dual_layout(spark.read.parquet(cfg.obs)))
    raise ValueError(f"unknown layout {layout!r}")


@capability("summarise")
def summarise(spark: SparkSession, cfg: Config) -> Result:
    """pred: an archive of scores with crps or rmse columns."""
    scores = spark.read.parquet(cfg.pred)
    keys = ["variable", "lead_h"]
    return {"summary": summary.ensemble_summary(scores, keys) if "crps" in scores.columns else summary.deterministic_summary(scores, keys)}


@capability("report")
def report(spark: SparkSession, cfg: Config) -> Result:
    """pred: an archive of daily rmse by model; the tables of a comparison on common dates."""
    scores = compare.common_dates(spark.read.parquet(cfg.pred))
    means = scores.groupBy("model", "variable").agg(F.avg("rmse").alias("rmse"))
    leads = scores.groupBy("model", "variable", "lead_h").agg(F.avg("rmse").alias("rmse"))
    daily = scores.groupBy("model", "variable", "init").agg(F.avg("rmse").alias("rmse"))
    pairs = compare.pair_report(daily, ["variable"], "rmse")
    return {
        "relative": compare.relative(means, ["variable"]),
        "composite": compare.ranks(compare.composite_relative(means), {"relative": True}),
        "by_lead": compare.composite_relative(leads, ["lead_h"]),
        "by_band": compare.lead_bands(leads),
        "pairs": pairs,
        "wins": compare.win_counts(pairs),
        "anomalies": compare.anomalies(means),
    }
