"""Spectra queries read all vectors: brute force on a small fixture and on the whole table."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridverity.operators import spectra
from gridverity.plans.queries import QUERIES


@pytest.fixture(scope="module", params=["sf0.001", "made"])
def vectors(request, spark, sf_dir, tmp_path_factory):
    if request.param == "sf0.001":
        d = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
        return sf_dir, d.vec_id.to_numpy(), np.stack(d.embedding).astype(float)
    root, rng = tmp_path_factory.mktemp("spectra"), np.random.default_rng(6)
    x = rng.normal(size=(420, 64))
    x[200:] *= 3  # the rest has more power
    spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{root}/embeddings.parquet")
    return str(root), np.arange(420), x


def mean_power(ids, x):
    w = np.cos(np.radians(ids % 13 * 14.0 - 84.0))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(33), np.arange(64)) / 64)
    p = np.abs((x - x.mean(1, keepdims=True)) @ turn.T) ** 2 / 64**2
    return (w[:, None] * p).sum(0) / w.sum()


def test_zonal_spectrum_of_all_vectors(spark, vectors):
    folder, ids, x = vectors
    got = {r.wavenumber: r.psd for r in QUERIES["zonal_spectrum"](spark, folder).collect()}
    assert len(ids) > 200 and [got[k] for k in range(33)] == pytest.approx(mean_power(ids, x).tolist(), abs=2e-9)


def test_band_power_of_all_vectors(spark, vectors):
    folder, ids, x = vectors
    want = mean_power(ids, x)
    got = {r.band: r.psd for r in QUERIES["band_power"](spark, folder).collect()}
    assert got == pytest.approx({f"{a}_{b}": want[a : b + 1].sum() for a, b in ((1, 4), (5, 20), (21, 40))}, abs=2e-9)


def test_spherical_spectrum_of_all_fields(spark, vectors):
    folder, ids, x = vectors
    by_id = dict(zip(ids.tolist(), x))
    fields = [f for f in range(int(ids.max()) // 13 + 1) if all(13 * f + i in by_id for i in range(13))]
    got = {}
    for r in QUERIES["spherical_spectrum"](spark, folder).collect():
        got.setdefault(r.field, {})[r.degree] = r.power
    assert sorted(got) == fields and len(fields) > 30
    for f in fields:
        want = spectra.spherical_power(np.stack([by_id[13 * f + i] for i in range(13)]), 6)
        assert [got[f][k] for k in range(7)] == pytest.approx(want.tolist(), abs=2e-9)  # powers are rounded to nine digits
