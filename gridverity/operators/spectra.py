"""Spectra of fields: zonal, two-dimensional and spherical.

Small rings are transformed by joins and sums (relational DFT); long ones by a
NumPy kernel on packed rings.  Both give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]

# fixed values: inclusive wave-number bands by use
BANDS = ((1, 4), (5, 20), (21, 40), (41, 64), (65, 128))
SHARE_BANDS = ((1, 5), (6, 20), (21, 60), (61, 180), (181, 720))


def ring_spectrum_sql(rings: DataFrame, keys: Keys, n: int, values: str = "values", k_max: int | None = None) -> DataFrame:
    """Power |F|^2 / n^2 at wave numbers 0 to k_max of each packed ring, its mean removed (so power 0 at 0)."""
    k_max = n // 2 if k_max is None else k_max
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    x = rings.withColumn("__mean", mean).withColumn("wavenumber", F.explode(F.sequence(F.lit(0), F.lit(k_max))))
    turn = 2 * math.pi / n

    def part(f):
        terms = F.transform(values, lambda v, i: (v - F.col("__mean")) * f(F.lit(turn) * ((F.col("wavenumber") * i) % n)))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    power = (part(F.cos) ** 2 + part(F.sin) ** 2) / float(n * n)
    return x.withColumn("psd", F.when(F.col("wavenumber") == 0, 0.0).otherwise(power)).drop("__mean", values)


def ring_spectrum(rings: DataFrame, keys: Keys, values: str = "values") -> DataFrame:
    """ring_spectrum_sql() by fast transforms, for long rings; rows of keys come back with arrays exploded."""
    fields = [f for f in rings.schema.fields if f.name in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "psd array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(values):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x) ** 2
                p[0] = 0.0
                out.append(p)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "psd"])

    rows = rings.select(*keys, values).mapInArrow(run, schema)
    return rows.select(*keys, F.posexplode("psd").alias("wavenumber", "psd"))


def zonal_spectrum(ring_power: DataFrame, keys: Keys) -> DataFrame:
    """Latitude-weighted mean power of rings (lat, wavenumber, psd), with the wave's length."""
    out = ring_power.withColumn("w", c.lat_weight("lat")).groupBy(*keys, "wavenumber").agg(c.weighted_mean("psd", "w").alias("psd"))
    return out.withColumn("wavelength_km", c.wavelength_km("wavenumber"))


def band_table(spark: SparkSession, bands: Sequence[tuple[int, int]] = BANDS) -> DataFrame:
    return spark.createDataFrame([(lo, hi, f"{lo}_{hi}") for lo, hi in bands], "lo int, hi int, band string")


def band_power(spectrum: DataFrame, keys: Keys, bands: DataFrame, value: str = "psd") -> DataFrame:
    """Power summed over each band."""
    inside = spectrum.join(F.broadcast(bands), F.col("wavenumber").between(F.col("lo"), F.col("hi")))  # a handful of bands
    return inside.groupBy(*keys, "band").agg(F.sum(value).alias(value))


def band_columns(powers: DataFrame, keys: Keys, kind: str, bands: Sequence[tuple[int, int]] = BANDS, prefix: str = "") -> DataFrame:
    """Wide table {prefix}{kind}_{pred|obs|ratio}_{lo}_{hi} from (band, pred, obs)."""
    out = []
    for lo, hi in bands:
        at = lambda x, t=f"{lo}_{hi}": F.max(F.when(F.col("band") == t, F.col(x)))
        out += [at("pred").alias(f"{prefix}{kind}_pred_{lo}_{hi}"), at("obs").alias(f"{prefix}{kind}_obs_{lo}_{hi}"), c.ratio(at("pred"), at("obs")).alias(f"{prefix}{kind}_ratio_{lo}_{hi}")]
    return powers.groupBy(*keys).agg(*out)


def diagonal_spectrum(cells: DataFrame, keys: Keys, n_lat: int, n_lon: int, k_max: int = 30, value: str = "value") -> DataFrame:
    """P(k) summed over meridional waves l of |sum z exp(i phase)|^2, phase 2 pi (l (j - i) / M + k i / N), one-sided.

    Waves l are orthogonal, so P(k) = M sum_d |sum over cells with (j - i) mod M = d|^2: each diagonal d is packed
    and transformed at once, and powers are summed over diagonals.  Missing cells take the field's mean.
    """
    mean = cells.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    x = cells.join(mean, list(keys)).withColumn("__z", F.coalesce(F.col(value), F.col("__mean")))
    x = x.withColumn("__d", F.pmod(F.col("lat_i") - F.col("lon_i"), F.lit(n_lat)))
    packed = x.groupBy(*keys, "__d").agg(F.collect_list(F.struct((F.col("lon_i") % n_lon).cast("int").alias("at"), F.col("__z").cast("double").alias("z"))).alias("__row"))
    packed = packed.select(*keys, F.col("__row.at").alias("__at"), F.col("__row.z").alias("__z"))
    names = list(keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in names), "p array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, z in zip(batch.column("__at"), batch.column("__z"), strict=True):
                ring = np.bincount(at.values.to_numpy(), z.values.to_numpy(), n_lon)
                power = np.abs(np.fft.rfft(ring)) ** 2
                k = np.arange(k_max + 1) % n_lon
                out.append(power[np.minimum(k, n_lon - k)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "p"])

    x = packed.mapInArrow(run, schema).select(*keys, F.posexplode("p").alias("k", "p"))
    fold = F.when((F.col("k") == 0) | (F.col("k") * 2 == n_lon), 1.0).otherwise(2.0)
    return x.groupBy(*keys, "k").agg((F.lit(float(n_lat)) * F.sum("p")).alias("p")).withColumn("p", F.col("p") * fold)


def quadrature(n_lat: int) -> np.ndarray:
    """Clenshaw-Curtis weights of n_lat equidistant latitudes from pole to pole; they sum to 2."""
    n = n_lat - 1
    theta = np.pi * np.arange(n_lat) / n
    w = np.ones(n_lat)
    for j in range(1, n // 2 + 1):
        w -= (1.0 if 2 * j == n else 2.0) / (4 * j * j - 1) * np.cos(2 * j * theta)
    w *= 2.0 / n
    w[[0, -1]] /= 2
    return w


def legendre(l_max: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions [degree, order, i] for 0 <= order <= degree <= l_max at x[i].

    The integral of a square over x is 1 / 2 pi.  Each degree follows from the two before it, for all orders
    at once: sqrt((d^2 - m^2) / (4 d^2 - 1)) y(d) = x y(d-1) - sqrt(((d-1)^2 - m^2) / (4 (d-1)^2 - 1)) y(d-2);
    the order that is new with a degree is the sectoral function, a multiple of (1 - x^2)^(d/2).
    """
    coupling = lambda degree, order: np.sqrt((degree**2 - order**2) / (4.0 * degree**2 - 1))
    table = np.zeros((l_max + 1, l_max + 1, len(x)))
    height = np.sqrt(np.clip(1 - x**2, 0, None))
    sectoral = np.full(len(x), 0.5 / math.sqrt(math.pi))
    for degree in range(l_max + 1):
        if degree:
            orders = np.arange(degree)[:, None]
            lower = x * table[degree - 1, :degree]
            if degree > 1:
                lower = lower - coupling(degree - 1, orders) * table[degree - 2, :degree]
            table[degree, :degree] = lower / coupling(degree, orders)
            sectoral = sectoral * height * math.sqrt(1 + 0.5 / degree)
        table[degree, degree] = sectoral
    return table


def spherical_power(field: np.ndarray, l_max: int) -> np.ndarray:
    """Power by total degree of a field (lat from pole to pole, lon), its global mean removed."""
    n_lat, n_lon = field.shape
    w = quadrature(n_lat)
    field = field - (w[:, None] * field).sum() / (w.sum() * n_lon)
    f = np.fft.rfft(field, axis=1)[:, : l_max + 1] * (2 * np.pi / n_lon)
    p = legendre(l_max, np.sin(np.linspace(-np.pi / 2, np.pi / 2, n_lat)))
    out = np.zeros(l_max + 1)
    for m in range(min(l_max, n_lon // 2) + 1):
        coef = (p[:, m, :] * w[None, :]) @ f[:, m]
        out += (1 if m == 0 else 2) * np.abs(coef) ** 2
    return out


def is_global(lats: np.ndarray) -> bool:
    """Equidistant latitudes that reach both poles: what the spherical transform needs."""
    lats = np.sort(np.asarray(lats, float))
    return len(lats) > 2 and np.allclose(np.diff(lats), lats[1] - lats[0]) and np.isclose(lats[0], -90) and np.isclose(lats[-1], 90)


def spherical_spectrum(rings: DataFrame, keys: Keys, l_max: int, values: str = "values") -> DataFrame:
    """(keys, degree, power) of each field, given as rings (lat, values); fields that aren't global have no row.

    A field is one group: its size is that of the grid, whatever the number of fields.
    """
    fields = [f for f in rings.schema.fields if f.name in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "degree int, power double"])

    def run(table: pa.Table) -> pa.Table:
        lat = table.column("lat").to_numpy()
        order = np.argsort(lat)
        out_keys = {k: [table.column(k)[0].as_py()] for k in keys}
        if is_global(lat):
            grid = np.array([table.column(values)[int(i)].as_py() for i in order], float)
            power = spherical_power(grid, l_max)
        else:
            power = np.zeros(0)
        n = len(power)
        cols = [pa.array(v * n, table.schema.field(k).type) for k, v in out_keys.items()]
        return pa.table([*cols, pa.array(np.arange(n, dtype=np.int32)), pa.array(power)], names=[*keys, "degree", "power"])

    return rings.select(*keys, "lat", values).groupBy(*keys).applyInArrow(run, schema)
