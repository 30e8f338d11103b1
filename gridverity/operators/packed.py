"""Scores of fields that are packed by latitude: a row holds a ring of values, not a cell.

A field of 721 x 1440 cells is 721 rows, so forecast, truth and climatology are joined
on 721 keys instead of a million.  Each task turns its rings into a dozen weighted sums
by array arithmetic on Arrow buffers; the sums of a field are added up by one
aggregation.  Results are those of `deterministic` on the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]
SUMS = ("n", "w", "ee", "e", "wa", "f", "o", "ff", "oo", "fo")


def pack(cells: DataFrame, keys: Keys, values: Keys = ("value",), n_lon: int | None = None) -> DataFrame:
    """Rings (keys, lat_i, lat, an array for each value in the order of lon_i); with n_lon missing cells are NULL in their place."""
    ring = F.array_sort(F.collect_list(F.struct("lon_i", *values)))
    out = cells.groupBy(*keys, "lat_i", "lat").agg(ring.alias("__r"))
    if n_lon is None:
        return out.select(*keys, "lat_i", "lat", *[F.col(f"__r.{v}").alias(v) for v in values])
    at = F.map_from_entries(F.transform("__r", lambda x: F.struct(x["lon_i"], x)))
    out = out.withColumn("__m", at)
    each = lambda v: F.transform(F.sequence(F.lit(0), F.lit(n_lon - 1)), lambda i: F.try_element_at("__m", i)[v])
    return out.select(*keys, "lat_i", "lat", *[each(v).alias(v) for v in values])


def paired_rings(forecast: DataFrame, truth: DataFrame, climatology: DataFrame | None = None, n_days: int = 365, per_day: int = 4, shift_h: float = 0) -> DataFrame:
    """forecast (variable, init, lead_h, lat_i, lat, value) with obs and, from slots at whole steps, clim."""
    x = forecast.withColumnRenamed("value", "fcst").withColumn("valid_time", c.valid_time("init", "lead_h", shift_h))
    x = x.join(truth.select("variable", "valid_time", "lat_i", F.col("value").alias("obs")), ["variable", "valid_time", "lat_i"])
    if climatology is not None:
        slot = (F.floor(c.year_slot("valid_time", n_days) * per_day) % (n_days * per_day)).cast("int")
        x = x.withColumn("slot", slot).join(climatology.select("variable", "slot", "lat_i", F.col("value").alias("clim")), ["variable", "slot", "lat_i"])
    return x


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Rings as float64 arrays of one shape where they have one, missing values as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    size = column.value_lengths().to_numpy()
    if len(size) and (size == size[0]).all():
        return [flat.reshape(len(size), size[0])]
    ends = np.cumsum(size)
    return [flat[a:b][None] for a, b in zip(ends - size, ends, strict=True)]


def ring_sums(rings: DataFrame, keys: Keys, spectrum: int = 0) -> DataFrame:
    """SUMS of each ring, and the powers of wave numbers 0 to `spectrum` of both sides (arrays pf, po, NULL for a ring with a gap)."""
    has_clim = "clim" in rings.columns
    fields = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    names = list(keys)
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in names), *(f"{s} double" for s in SUMS), *(("pf array<double>", "po array<double>") if spectrum else ())])

    def sums(lat: np.ndarray, f: np.ndarray, o: np.ndarray, g: np.ndarray | None) -> np.ndarray:
        w = np.cos(np.radians(lat))
        e = f - o
        there = ~np.isnan(e)
        total = lambda x: np.where(there, x, 0.0).sum(axis=1)
        n = there.sum(axis=1).astype(float)
        out = [n, n * w, total(e * e) * w, total(e) * w]
        if g is not None:
            fa, oa = f - g, o - g
            there = there & ~np.isnan(g)
            out += [there.sum(axis=1) * w, *(total(x) * w for x in (fa, oa, fa * fa, oa * oa, fa * oa))]
        return np.array(out + [np.zeros(len(f))] * (len(SUMS) - len(out)))

    def powers(x: np.ndarray) -> list:
        whole = ~np.isnan(x).any(axis=1)
        p = np.abs(np.fft.rfft(np.nan_to_num(x - x.mean(axis=1, keepdims=True)), axis=1)) ** 2 / x.shape[1] ** 2
        p[:, 0] = 0.0
        return [row[: spectrum + 1] if ok else None for row, ok in zip(p, whole, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lat = batch.column("lat").to_numpy()
            sides = [_rows(batch.column(x)) for x in ("fcst", "obs", *(("clim",) if has_clim else ()))]
            found, pf, po, at = [], [], [], 0
            for part in zip(*sides, strict=True):
                f, o, g = (*part, None)[:3]
                found.append(sums(lat[at : at + len(f)], f, o, g))
                if spectrum:
                    pf += powers(f)
                    po += powers(o)
                at += len(f)
            table = np.concatenate(found, axis=1)
            extra = [pa.array(pf, pa.list_(pa.float64())), pa.array(po, pa.list_(pa.float64()))] if spectrum else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *map(pa.array, table), *extra], names=[*names, *SUMS, *(("pf", "po") if spectrum else ())])

    return rings.select(*dict.fromkeys([*names, "lat", "fcst", "obs", *(["clim"] if has_clim else [])])).mapInArrow(run, schema)


def _scores(s: DataFrame, keys: Keys, has_clim: bool, others: Keys = ()) -> DataFrame:
    """Scores from the SUMS of each group."""
    out = s.select(*keys, F.col("n").cast("long").alias("n"), F.sqrt(c.ratio("ee", "w")).alias("rmse"), c.ratio("e", "w").alias("bias"), *SUMS[4:], *others)
    if not has_clim:
        return out.drop(*SUMS[4:])
    left = lambda a, b, ab: F.col(ab) - c.ratio(F.col(a) * F.col(b), "wa")
    spread = lambda a, aa: F.sqrt(F.greatest(c.ratio(aa, "wa") - c.ratio(a, "wa") * c.ratio(a, "wa"), F.lit(0.0)))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    out = out.withColumns({
        "acc": c.ratio("fo", root(F.col("ff") * F.col("oo"))),
        "acc_centred": c.ratio(left("f", "o", "fo"), root(left("f", "f", "ff") * left("o", "o", "oo"))),
        "fa_pred": spread("f", "ff"),
        "fa_obs": spread("o", "oo"),
    })
    return out.withColumn("fa_ratio", c.ratio("fa_pred", "fa_obs")).drop(*SUMS[4:])


def ring_scores(rings: DataFrame, keys: Keys) -> DataFrame:
    """n, rmse and bias of each group; with clim also acc, acc_centred, fa_pred, fa_obs and fa_ratio."""
    s = ring_sums(rings, keys).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in SUMS])
    return _scores(s, keys, "clim" in rings.columns)


def ring_report(rings: DataFrame, keys: Keys, waves: int) -> DataFrame:
    """ring_scores() and the latitude-weighted mean powers of wave numbers 0 to `waves` (arrays fcst_power, obs_power), in one pass over the rings."""
    p = ring_sums(rings, [*keys, "lat"], waves).withColumn("w0", F.when(F.col("pf").isNotNull() & F.col("po").isNotNull(), c.lat_weight("lat")))
    each = lambda side, k: c.ratio(F.sum(F.col("w0") * F.get(side, F.lit(k))), F.sum("w0"))
    powers = [F.array(*[each(side, k) for k in range(waves + 1)]).alias(name) for side, name in (("pf", "fcst_power"), ("po", "obs_power"))]
    total = p.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in SUMS], *powers)
    return _scores(total, keys, "clim" in rings.columns, ("fcst_power", "obs_power"))
