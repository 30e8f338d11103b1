"""Scalar and aggregate Column builders of forecast verification.

Missing is NULL throughout: `clean` turns NaN, infinities and fill values to NULL
at ingest, and every ratio is NULL where its denominator is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: C, fill: float = 1e30) -> Column:
    """NULL for NaN, infinities and fill values."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) > fill), None).otherwise(x)


def ratio(a: C, b: C) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def tidy(x: C, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0: comparable across engines and orders of summation."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


# --- grid ---------------------------------------------------------------------


def lat_weight(lat: C, weighted: bool = True) -> Column:
    """cos(latitude); 1 when unweighted; an error outside the poles."""
    lat = col(lat)
    value = F.cos(F.radians(lat)) if weighted else F.lit(1.0)
    return F.when(F.abs(lat) <= 90, value).otherwise(F.raise_error(F.lit("latitude beyond 90 degrees")).cast("double"))


def lon360(lon: C) -> Column:
    return F.pmod(col(lon), F.lit(360.0))


def grid_lon(index: C, step: float = 0.25) -> Column:
    """Longitude from its index: repairs headers whose last value wrapped or was rounded."""
    return col(index).cast("double") * step


def header_is_broken(first: C, last: C, n: C, step: C, lo: float = 0.24, hi: float = 0.26) -> Column:
    """Whether a longitude axis runs from about 0 to about 360 in steps of about 0.25 degrees: its last value wrapped or was rounded."""
    return (F.abs(col(first)) < 0.1) & (F.abs(col(last) - 360.0) < 0.1) & col(step).between(lo, hi) & (col(n) > 1)


def repaired_lon(index: C, lon: C, broken: C, step: float = 0.25) -> Column:
    """grid_lon() where the header is broken, else the longitude as it is."""
    return F.when(col(broken), grid_lon(index, step)).otherwise(col(lon))


def in_box(lat: C, lon: C, lat0: float, lat1: float, lon0: float, lon1: float) -> Column:
    """Inside an inclusive box; longitudes modulo 360, bounds as given."""
    return col(lat).between(lat0, lat1) & lon360(lon).between(lon0, lon1)


def in_region(lat: C, lon: C, lat0: C, lat1: C, lon0: C, lon1: C) -> Column:
    """Inside an inclusive region whose longitudes may cross 0 degrees."""
    x, a, b = lon360(lon), lon360(lon0), lon360(lon1)
    return col(lat).between(col(lat0), col(lat1)) & F.when(a <= b, x.between(a, b)).otherwise((x >= a) | (x <= b))


def near(lat: C, lon: C, lat0: C, lon0: C, half: C) -> Column:
    """Within `half` degrees of a point in both directions, around the globe."""
    turn = F.pmod(col(lon) - col(lon0) + 180.0, F.lit(360.0)) - 180.0
    return (F.abs(col(lat) - col(lat0)) <= col(half)) & (F.abs(turn) <= col(half))


EARTH_KM = 6371.0
CIRCLE_KM = 40075.0


def great_circle(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    """Haversine distance in km."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    """Direction of travel in radians, on a plane at the middle latitude."""
    mid = F.radians((col(lat1) + col(lat2)) / 2)
    turn = F.pmod(col(lon2) - col(lon1) + 180.0, F.lit(360.0)) - 180.0
    return F.atan2(turn * F.cos(mid), col(lat2) - col(lat1))


def along_cross(lat0: C, lon0: C, lat1: C, lon1: C, plat: C, plon: C) -> tuple[Column, Column]:
    """Along- and cross-track error (km) of a forecast position.

    The track runs from the previous observed position (0) to the present one (1).
    """
    angle = bearing(lat0, lon0, plat, plon) - bearing(lat0, lon0, lat1, lon1)
    length = great_circle(lat0, lon0, plat, plon)
    return length * F.cos(angle) - great_circle(lat0, lon0, lat1, lon1), length * F.sin(angle)


def wavelength_km(k: C) -> Column:
    """Length of a zonal wave at the equator; NULL for wave number 0."""
    return ratio(F.lit(CIRCLE_KM), k)


# --- units --------------------------------------------------------------------


def scaled(variable: C, value: C, scales: dict[str, float]) -> Column:
    """value times the scale of its variable, 1 where none is given."""
    out = F.when(F.lit(False), None)
    for name, s in scales.items():
        out = out.when(col(variable) == name, col(value) * float(s))
    return out.otherwise(col(value))


def humidity_report(metric: C, variable: C, value: C, names: Sequence[str] = ("q700", "q2m")) -> Column:
    """Humidity scores in g/kg: errors times 1e3, spectra and powers times 1e6; ratios, ACC and Brier as they are."""
    m = F.lower(col(metric))
    linear = m.rlike("^(rmse|crps|spread|fa_(pred|obs|bias))$")
    square = m.rlike("^(spectrum|band_power|(zonal|spherical)_(pred|obs))")
    return F.when(col(variable).isin(*names) & linear, col(value) * 1e3).when(col(variable).isin(*names) & square, col(value) * 1e6).otherwise(col(value))


def to_standard_unit(variable: C, unit: C, value: C, field_mean: C, lead_h: C) -> Column:
    """Standard units by a unit string, or by the field's mean where the string says nothing.

    z500 in gpm, t2m in K, msl in Pa, rain in mm over the lead.
    """
    v, u, x, m = col(variable), F.regexp_replace(F.lower(F.coalesce(col(unit), F.lit(""))), r"[\s\*\^]", ""), col(value), col(field_mean)
    hours = col(lead_h) * 3600.0
    return (
        F.when((v == "z500") & (u.isin("m2/s2", "m2s-2") | ((u == "") & (m > 10000))), x / 9.80665)
        .when((v == "t2m") & (u.isin("c", "degc", "celsius") | ((u == "") & (m < 100))), x + 273.15)
        .when((v == "msl") & (u.isin("hpa", "mbar") | ((u == "") & (m > 800) & (m < 1500))), x * 100.0)
        .when((v == "tp") & u.isin("mm/s", "mms-1", "kgm-2s-1"), x * hours)
        .when((v == "tp") & u.isin("m/s", "ms-1"), x * hours * 1000.0)
        .when((v == "tp") & (u == "m"), F.when(m < 0.01, x * 1000.0).otherwise(x))
        .when((v == "tp") & (u == "") & (m < 0.01), x * hours)
        .otherwise(x)
    )


# --- time ---------------------------------------------------------------------

INIT_FORMATS = ("yyyyMMddHH", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd")


def init_time(text: C) -> Column:
    """A start time in any of the usual spellings; NULL if it is none."""
    return F.coalesce(*[F.try_to_timestamp(col(text), F.lit(f)) for f in INIT_FORMATS])


def valid_time(init: C, lead_h: C, shift_h: float = 0) -> Column:
    """init + lead, optionally shifted to another clock."""
    return F.timestamp_micros((F.unix_micros(col(init).cast("timestamp")) + F.round((col(lead_h) + shift_h) * 3_600_000_000)).cast("long"))


def hours_from_unit(value: C, unit: C) -> Column:
    """A time axis's values in hours."""
    u = F.lower(col(unit))
    per = F.when(u.startswith("second"), 1 / 3600).when(u.startswith("minute"), 1 / 60).when(u.startswith("day"), 24.0).otherwise(1.0)
    return col(value) * per


def time_from_unit(value: C, unit: C) -> Column:
    """The time that an axis's value and unit ("hours since 2024-01-01 00:00:00") say; NULL without an epoch."""
    epoch = init_time(F.regexp_replace(F.trim(F.regexp_extract(F.lower(col(unit)), r"since\s+(\S.*)$", 1)), r"(\.0+|z|utc)$", ""))
    return F.timestamp_micros((F.unix_micros(epoch) + F.round(hours_from_unit(value, unit) * 3_600_000_000)).cast("long"))


def is_leap(year: C) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def year_slot(t: C, n_days: int) -> Column:
    """Fractional day of year from 0.  365: 29 February counts as the 28th; 366: real days, others skip the 29th."""
    t = col(t).cast("timestamp")
    doy = F.dayofyear(t)
    leap, late = is_leap(F.year(t)), F.month(t) > 2
    day = doy - F.when(leap & (late | ((F.month(t) == 2) & (F.dayofmonth(t) == 29))), 1).otherwise(0) if n_days == 365 else doy + F.when(~leap & late, 1).otherwise(0)
    hour = (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400.0
    return day - 1 + hour


def week_number(label: C) -> Column:
    """The first integer of a week label."""
    return F.regexp_extract(col(label), r"(\d+)", 1).try_cast("int")


def grade_label(threshold: C) -> Column:
    return F.concat(F.lit("≥"), F.regexp_replace(col(threshold).cast("string"), r"\.0$", ""))


def grade_threshold(label: C) -> Column:
    return F.regexp_replace(col(label), "≥", "").try_cast("double")


def band_tag(lo: C, hi: C, sep: str = "_") -> Column:
    return F.concat(col(lo).cast("string"), F.lit(sep), col(hi).cast("string"))


def lead_index_base(min_index: C, max_index: C) -> Column:
    """1 if a lead axis counts from 1, else 0."""
    return F.when((col(min_index) >= 1) & (col(max_index) <= 120), 1).otherwise(0)


# --- weighted aggregates ------------------------------------------------------


def weighted_mean(x: C, w: C) -> Column:
    x, w = col(x), col(w)
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def rmse(f: C, o: C, w: C = "w") -> Column:
    d = col(f) - col(o)
    return F.sqrt(weighted_mean(d * d, w))


def bias(f: C, o: C, w: C = "w") -> Column:
    return weighted_mean(col(f) - col(o), w)


def _joint(f: C, o: C, w: C) -> tuple[Column, Column, Column]:
    f, o, w = col(f), col(o), col(w)
    both = f.isNotNull() & o.isNotNull()
    return F.when(both, f), F.when(both, o), F.when(both, w)


def acc(fa: C, oa: C, w: C = "w", centred: bool = False) -> Column:
    """Anomaly correlation of anomalies fa and oa, uncentred by default."""
    f, o, w = _joint(fa, oa, w)
    sw, sf, so = F.sum(w), F.sum(w * f), F.sum(w * o)
    sff, soo, sfo = F.sum(w * f * f), F.sum(w * o * o), F.sum(w * f * o)
    if centred:
        sff, soo, sfo = sff - ratio(sf * sf, sw), soo - ratio(so * so, sw), sfo - ratio(sf * so, sw)
    return ratio(sfo, F.sqrt(F.greatest(sff * soo, F.lit(0.0))))


def activity(x: C, other: C, w: C = "w", compat: bool = False) -> Column:
    """Weighted standard deviation of anomalies; compat: sums over x alone, weights over both sides' cells."""
    x, o, w = col(x), col(other), col(w)
    both = F.when(x.isNotNull() & o.isNotNull(), w)
    own = w if compat else both
    mean = ratio(F.sum(own * x), F.sum(both))
    return F.sqrt(F.greatest(ratio(F.sum(own * x * x), F.sum(both)) - mean * mean, F.lit(0.0)))


# --- contingency --------------------------------------------------------------


def event(x: C, threshold: C) -> Column:
    return col(x) >= col(threshold)


def contingency(f: C, o: C, threshold: C) -> list[Column]:
    """hits, misses, false_alarms, n_pairs over pairs without a missing side."""
    both = col(f).isNotNull() & col(o).isNotNull()
    pf, po = event(f, threshold), event(o, threshold)
    count = lambda c, name: F.count(F.when(both & c, 1)).alias(name)
    return [count(pf & po, "hits"), count(~pf & po, "misses"), count(pf & ~po, "false_alarms"), count(F.lit(True), "n_pairs")]


def skill_scores(h: C = "hits", m: C = "misses", f: C = "false_alarms") -> dict[str, Column]:
    """ts, pod, far, miss_rate and bias_score of contingency counts."""
    h, m, f = (col(x).cast("double") for x in (h, m, f))
    return {"ts": ratio(h, h + m + f), "pod": ratio(h, h + m), "far": ratio(f, f + h), "miss_rate": ratio(m, m + h), "bias_score": ratio(h + f, h + m)}


# --- members in an array ------------------------------------------------------


def _present(members: C) -> Column:
    return F.filter(col(members), lambda x: x.isNotNull() & ~F.isnan(x))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def members_mean(members: C, propagate: bool = True) -> Column:
    """Ensemble mean; a missing member makes it NULL unless propagate is False."""
    m = _present(members)
    mean = ratio(_total(m), F.size(m))
    return F.when(F.size(m) == F.size(col(members)), mean) if propagate else mean


def members_std(members: C, ddof: int = 0) -> Column:
    """Standard deviation over members; NULL if one is missing.  One pass: sums of the values and squares from the first one on."""
    m = _present(members)
    n = F.size(m)
    step = lambda s, x: F.struct(
        F.coalesce(s["x0"], x).alias("x0"),
        (s["a"] + (x - F.coalesce(s["x0"], x))).alias("a"),
        (s["b"] + (x - F.coalesce(s["x0"], x)) * (x - F.coalesce(s["x0"], x))).alias("b"),
    )
    start = F.struct(F.lit(None).cast("double").alias("x0"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    ss = F.aggregate(m, start, step, lambda s: F.greatest(s["b"] - s["a"] * s["a"] / F.nullif(n, F.lit(0)), F.lit(0.0)))
    return F.when(n == F.size(col(members)), F.sqrt(ratio(ss, F.greatest(n - ddof, F.lit(0)))))


def crps(members: C, obs: C, floor: bool = False) -> Column:
    """CRPS of a cell: mean |x - o| - sum x_(k) (2k - m - 1) / m^2 over its present members.

    One pass over the sorted members: sums of |x - o|, of x and of x_(k) k.
    """
    o = col(obs)
    step = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["d"] + F.abs(x - o)).alias("d"), (s["t"] + x).alias("t"), (s["r"] + x * (s["n"] + 1)).alias("r"))
    start = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(x) for x in "dtr"])

    def close(s: Column) -> Column:
        n = F.nullif(s["n"], F.lit(0))
        value = s["d"] / n - (2 * s["r"] - (s["n"] + 1) * s["t"]) / (n * n)
        return F.greatest(value, F.lit(0.0)) if floor else value

    return F.when(o.isNotNull(), F.aggregate(F.array_sort(_present(members)), start, step, close))


def exceed_share(members: C, threshold: C) -> Column:
    """Share of present members that reach a threshold."""
    m = _present(members)
    return ratio(F.size(F.filter(m, lambda x: x >= col(threshold))).cast("double"), F.size(m))
