"""Analytic facts of the scores, on small inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridverity.functions import columns as c
from gridverity.functions.tests_of_rank import exact_p, holm
from gridverity.operators import align, categorical, ensemble, spectra, subseasonal, tropical


def one(df):
    return df.first().asDict()


def test_crps_is_the_pairwise_form(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), [float(x) for x in rng.normal(size=n)]) for n in (1, 2, 5, 9)]
    got = [r[0] for r in spark.createDataFrame(rows, "o double, m array<double>").select(c.crps("m", "o")).collect()]
    want = [np.mean(np.abs(np.array(m) - o)) - np.abs(np.subtract.outer(m, m)).sum() / (2 * len(m) ** 2) for o, m in rows]
    assert got == pytest.approx(want)


def test_missing_members_and_cells(spark):
    df = spark.createDataFrame([(1.0, [1.0, None, 3.0]), (None, [1.0, 2.0, 3.0])], "o double, members array<double>")
    got = df.select(c.members_mean("members").alias("a"), c.members_mean("members", False).alias("b"), c.crps("members", "o").alias("x")).collect()
    assert got[0].a is None and got[0].b == 2.0 and got[0].x is not None and got[1].x is None
    assert spark.createDataFrame([(float("nan"),), (1e31,), (2.0,)], "x double").select(c.clean("x")).toPandas().iloc[:, 0].isna().sum() == 2


def test_score_identities(spark):
    df = spark.createDataFrame([(1053429, 45439, 929900)], "hits long, misses long, false_alarms long").withColumns(c.skill_scores())
    r = one(df)
    assert r["ts"] == pytest.approx(0.519246, abs=1e-6) and r["pod"] == pytest.approx(0.958649, abs=1e-6) and r["far"] == pytest.approx(0.468858, abs=1e-6) and r["bias_score"] == pytest.approx(1.80488, abs=1e-5)
    assert r["ts"] == pytest.approx(1 / (1 / r["pod"] + 1 / (1 - r["far"]) - 1)) and r["pod"] == pytest.approx(r["bias_score"] * (1 - r["far"]))


def test_perfect_and_constant_probabilities(spark):
    rows = [(1, 5.0, [5.0, 6.0, 7.0]), (1, 0.0, [0.0, 0.0, 0.0]), (2, 5.0, [5.0, 0.0, 0.0]), (2, 0.0, [5.0, 0.0, 0.0]), (2, None, [5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, obs double, members array<double>")
    got = {r.g: r for r in categorical.probability_scores(categorical.event_histogram(df, ["g"], [1.0]), ["g"]).collect()}
    assert got[1].aroc == 1.0 and got[1].bss == 1.0
    assert got[2].aroc == 0.5 and got[2].bss == pytest.approx(-1 / 9) and got[2].n_points == 2


def test_great_circle_and_tracks(spark):
    df = spark.createDataFrame([(39.9, 116.4, 31.2, 121.5)], "a double, b double, c double, d double")
    assert one(df.select(c.great_circle("a", "b", "c", "d").alias("x")))["x"] == pytest.approx(1068, abs=5)
    perfect = spark.createDataFrame([(0.0, 10.0, 100.0, 10.0, 100.0), (6.0, 10.0, 101.0, 10.0, 101.0), (12.0, 10.0, 102.0, 10.0, 103.0)], "lead_h double, lat double, lon double, plat double, plon double").withColumn("tcid", F.lit(1))
    got = tropical.track_errors(perfect, ["tcid"]).orderBy("lead_h").collect()
    assert got[0].along_km is None and got[1].along_km == pytest.approx(0, abs=1e-6) and got[1].cross_km == pytest.approx(0, abs=1e-6)
    assert got[2].along_km == pytest.approx(got[2].distance_km, rel=1e-2) and abs(got[2].cross_km) < 1


def test_search_wraps_at_zero_longitude(spark):
    cells = [(1, float(lead), float(lat), float(lon % 360), 1000.0 + abs(lat - 10) + abs((lon - 359 - lead / 6) % 360 if (lon - 359 - lead / 6) % 360 < 180 else 360 - (lon - 359 - lead / 6) % 360)) for lead in (6, 12, 18) for lat in range(5, 16) for lon in range(354, 368)]
    df = spark.createDataFrame(cells, "tcid int, lead_h double, lat double, lon double, msl double")
    start = spark.createDataFrame([(1, 10.0, 359.0)], "tcid int, lat double, lon double")
    assert [(r.plat, r.plon) for r in tropical.track_storms(df, start).orderBy("lead_h").collect()] == [(10.0, 0.0), (10.0, 1.0), (10.0, 2.0)]


def test_signed_rank_by_enumeration():
    for n in range(2, 11):
        sums = [sum(k + 1 for k in range(n) if s >> k & 1) for s in range(2**n)]
        for w in range(n * (n + 1) // 2 + 1):
            lo = min(w, n * (n + 1) // 2 - w)
            assert exact_p(w, n) == pytest.approx(min(1.0, 2 * sum(x <= lo for x in sums) / 2**n))


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double").withColumn("f", F.lit(1))
    assert [r.p_holm for r in holm(df, ["f"]).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06, None])


def test_student_tail():
    # exact tails: one degree of freedom is Cauchy, two have a closed form
    for t in (0.1, 1.0, 3.0, 12.0):
        got = subseasonal.student_two_sided(np.array([t, t]), np.array([1.0, 2.0]))
        assert got == pytest.approx([2 * (0.5 - math.atan(t) / math.pi), 1 - t / math.sqrt(2 + t * t)], abs=1e-10)


def test_parseval_and_kernels_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 16))
    rings = spark.createDataFrame([(i, 0.0, [float(v) for v in row]) for i, row in enumerate(x)], "i int, lat double, values array<double>")
    a = spectra.ring_spectrum_sql(rings, ["i", "lat"], 16).orderBy("i", "wavenumber").select("psd").toPandas().psd.to_numpy()
    b = spectra.ring_spectrum(rings, ["i", "lat"]).orderBy("i", "wavenumber").select("psd").toPandas().psd.to_numpy()
    assert a == pytest.approx(b, abs=1e-12)
    p = b.reshape(5, 9)
    assert 2 * p[:, 1:8].sum(1) + p[:, 8] == pytest.approx(x.var(axis=1))


def test_spherical_power_of_one_harmonic():
    lat = np.radians(np.linspace(-90, 90, 37))
    lon = 2 * np.pi * np.arange(72) / 72
    p = spectra.legendre(6, np.sin(lat))
    for degree, m in ((1, 0), (3, 0), (4, 2), (6, 5)):
        power = spectra.spherical_power(p[degree, m][:, None] * np.cos(m * lon)[None, :], 6)
        assert power.argmax() == degree and power[degree] == pytest.approx(power.sum(), rel=1e-6)
    assert spectra.quadrature(37).sum() == pytest.approx(2)


def test_interpolation_is_exact_for_planes(spark):
    cells = spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i, j in itertools.product(range(5), range(8))], "lat_i int, lon_i int, z double").withColumn("v", F.lit("a"))
    points = spark.createDataFrame([(1, 1.25, 2.5), (2, 9.0, 0.0), (3, -9.0, 6.5)], "station_id int, lat double, lon double")
    w = align.corner_weights(points, 5, 8, 0.0, 1.0)
    got = {r.station_id: r.z for r in align.to_stations(cells, w, ["v"], "z").collect()}
    assert got == pytest.approx({1: 10.0, 2: 8.0, 3: 19.5})


def test_year_slots(spark):
    rows = [("2023-02-28",), ("2023-03-01",), ("2024-02-28",), ("2024-02-29",), ("2024-03-01",), ("2024-12-31",), ("2023-12-31",)]
    df = spark.createDataFrame(rows, "d string").select(F.to_timestamp("d").alias("t"))
    got = df.select(c.year_slot("t", 365).alias("a"), c.year_slot("t", 366).alias("b")).toPandas()
    assert got.a.tolist() == [58, 59, 58, 58, 59, 364, 364] and got.b.tolist() == [58, 60, 58, 59, 60, 365, 365]


def test_lead_assembly_passes_over_leap_day(spark):
    daily = spark.createDataFrame([("2024-02-28", 1.0), ("2024-02-29", 99.0), ("2024-03-01", 2.0)], "d string, anomaly double").select(F.to_date("d").alias("day"), "anomaly", F.lit("x").alias("v"))
    starts = spark.createDataFrame([("2024-02-27",)], "d string").select(F.to_date("d").alias("init_date"))
    got = {r.lead_day: r.anomaly for r in subseasonal.assemble_leads(starts, daily, ["v"], 3).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None}


def test_units_and_times(spark):
    df = spark.createDataFrame([("z500", "m**2 s**-2", 98066.5, 50000.0), ("t2m", "", 10.0, 12.0), ("msl", "hPa", 1000.0, 1000.0), ("tp", "", 0.001, 0.001), ("tp", "mm", 4.0, 3.0)], "v string, u string, x double, m double")
    got = [r[0] for r in df.select(c.to_standard_unit("v", "u", "x", "m", F.lit(6.0))).collect()]
    assert got[1:] == pytest.approx([283.15, 100000.0, 21.6, 4.0])
    t = spark.createDataFrame([("2024010206",), ("20240102",), ("2024-01-02",), ("x",)], "t string").select(c.init_time("t")).toPandas().iloc[:, 0]
    assert t.isna().tolist() == [False, False, False, True] and str(t[0]) == "2024-01-02 06:00:00"


def test_regions_cross_zero(spark):
    df = spark.createDataFrame([(0.0, 350.0), (0.0, 10.0), (0.0, -5.0), (0.0, 100.0)], "lat double, lon double")
    got = [r[0] for r in df.select(c.in_region("lat", "lon", F.lit(-1.0), F.lit(1.0), F.lit(340.0), F.lit(20.0))).collect()]
    assert got == [True, True, True, False]


def test_completeness_drops_a_window_with_a_gap(spark):
    hours = [(1, f"2024-01-01 {h:02d}:00:00", 1.0) for h in range(6)] + [(2, f"2024-01-01 {h:02d}:00:00", 1.0) for h in range(6) if h != 3]
    df = spark.createDataFrame(hours, "station_id int, t string, rain double").select("station_id", F.to_timestamp("t").alias("obs_time"), "rain")
    assert [(r.station_id, r.total) for r in categorical.complete_windows(df, 6).collect()] == [(1, 6.0)]
    late = categorical.lenient_windows(df, 6).groupBy("station_id").agg(F.max("total").alias("m")).orderBy("station_id").collect()
    assert [r.m for r in late] == [6.0, 5.0]


def test_member_offsets(spark):
    cells = [(k, 10.0, [10.0 + o for o in (-0.3, 0.1, 0.5)]) for k in range(4)]
    df = spark.createDataFrame(cells, "k int, obs double, members array<double>").withColumns({"w": F.lit(1.0), "v": F.lit("a")})
    r = one(ensemble.ensemble_scores(df, ["v"]))
    assert r["rmse"] == pytest.approx(0.1) and r["spread"] == pytest.approx(np.std([-0.3, 0.1, 0.5]))


def test_fractions_skill_sees_past_missing_cells(spark):
    rng = np.random.default_rng(2)
    there = {(i, j): (float(rng.integers(0, 2)), float(rng.integers(0, 2))) for i in range(20) for j in range(20) if rng.random() < 0.3}
    df = spark.createDataFrame([(1, i, j, f, o) for (i, j), (f, o) in there.items()], "g int, lat_i int, lon_i int, fcst double, obs double")
    got = {r.window: r.fss for r in categorical.fractions_skill(df, ["g"], 1.0, [1, 3, 5]).collect()}
    for n in (1, 3, 5):
        h = n // 2
        sums = [[sum(there.get((i + a, j + b), (0, 0))[s] for a in range(-h, h + 1) for b in range(-h, h + 1)) / n**2 for s in (0, 1)] for i, j in there]
        want = 1 - sum((p - q) ** 2 for p, q in sums) / sum(p * p + q * q for p, q in sums)
        assert got[n] == pytest.approx(want)


def test_member_kernels(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), [float(x) for x in rng.normal(size=n) + 1e6]) for n in (1, 2, 7, 40)] + [(1.0, []), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "o double, m array<double>")
    got = df.select(c.members_std("m").alias("s"), c.members_std("m", 1).alias("s1"), c.crps("m", "o").alias("x"), c.crps("m", "o", floor=True).alias("x0")).collect()
    for r, (o, m) in zip(got, rows):
        assert r.s is None if not m else r.s == pytest.approx(np.std(m), rel=1e-6, abs=1e-6)
        assert r.s1 is None if len(m) < 2 else r.s1 == pytest.approx(np.std(m, ddof=1), rel=1e-6)
        assert (r.x is None) == (o is None or not m)


def test_pairs_that_are_close_are_no_difference(spark):
    from gridverity.functions.tests_of_rank import wilcoxon

    rows = [(1, 10.0 + 1e-6 * i, 10.0) for i in range(1, 8)] + [(2, 10.0 + i, 10.0) for i in range(1, 8)]
    got = {r.g: r.p for r in wilcoxon(spark.createDataFrame(rows, "g int, a double, b double"), ["g"]).collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(2 / 2**7)


def test_headers_and_time_units(spark):
    df = spark.createDataFrame([(0.0, 360.0, 1440), (0.0, 359.75, 1440), (-180.0, 179.75, 1440)], "a double, b double, n int")
    got = df.select(c.header_is_broken("a", "b", "n", F.lit(0.25)).alias("x"), c.repaired_lon(F.lit(1439), "b", c.header_is_broken("a", "b", "n", F.lit(0.25))).alias("y")).collect()
    assert [r.x for r in got] == [True, False, False] and [r.y for r in got] == [359.75, 359.75, 179.75]
    df = spark.createDataFrame([(36.0, "hours since 2024-01-01"), (1.5, "Days since 2024-01-01 00:00:00.0"), (5400.0, "seconds since 1970-01-01T00:00:00Z"), (1.0, "hours")], "v double, u string")
    assert [None if r.t is None else str(r.t) for r in df.select(c.time_from_unit("v", "u").alias("t")).collect()] == ["2024-01-02 12:00:00", "2024-01-02 12:00:00", "1970-01-01 01:30:00", None]


def test_no_roc_where_an_event_is_certain(spark):
    rows = [("always", 1.0, 1, 0.5), ("always", 0.5, 1, 1.0), ("never", 0.5, 0, 1.0), ("never", 0.0, 0, 1.0), ("both", 1.0, 1, 1.0), ("both", 0.0, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, p double, event int, w double")
    assert {r.g: r.aroc for r in categorical.weighted_roc(df, ["g"]).collect()} == {"always": None, "never": None, "both": 1.0}
    assert {r.g: r.aroc for r in categorical.weighted_roc(df, ["g"], undefined=0.0).collect()} == {"always": 0.0, "never": 0.0, "both": 1.0}
