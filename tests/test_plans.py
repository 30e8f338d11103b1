import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridverity.operators import categorical
from gridverity.plans import config
from gridverity.streaming import rain


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A 5 x 8 grid, two starts, two leads, two members; truth is 10, members are off by -1 and 2."""
    root = tmp_path_factory.mktemp("data")
    grid = spark.range(40).select((F.col("id") / 8).cast("int").alias("lat_i"), (F.col("id") % 8).cast("int").alias("lon_i"))
    grid = grid.withColumns({"lat": (F.col("lat_i") * 45.0 - 90), "lon": F.col("lon_i") * 45.0})
    steps = spark.createDataFrame([(dt.datetime(2024, 1, d), 6.0 * k, m, off) for d in (1, 2) for k in (1, 2) for m, off in (("a", -1.0), ("b", 2.0))], "init timestamp, lead_h double, member string, off double")
    cells = steps.crossJoin(grid).select(F.lit("z").alias("variable"), "init", "lead_h", "member", "lat_i", "lon_i", "lat", "lon", (10 + F.col("off") + F.col("lon_i")).alias("value"))
    cells.write.parquet(f"{root}/pred")
    truth = cells.select("variable", F.expr("init + make_interval(0,0,0,0,int(lead_h))").alias("valid_time"), "lat_i", "lon_i", (10.0 + F.col("lon_i")).alias("value")).distinct()
    truth.write.parquet(f"{root}/obs")
    grid.select(F.lit("z").alias("variable"), "lat_i", "lon_i").crossJoin(spark.range(365).select(F.col("id").cast("int").alias("slot"))).withColumn("value", F.lit(9.0)).write.parquet(f"{root}/climo")
    return root


def test_field_scores(spark, data):
    out = config.run(spark, {"type": "weather_ens_field_scores", "pred": f"{data}/pred", "obs": f"{data}/obs", "climo": f"{data}/climo", "clim_per_day": 1, "metrics": ["rmse", "acc"], "out": f"{data}/out", "name": "t"})
    by = {(r.member, r.lead_h): r.rmse for r in out["member_rmse"].collect()}
    assert by[("a", 6.0)] == pytest.approx(1.0) and by[("b", 12.0)] == pytest.approx(2.0)
    assert {round(r.rmse, 9) for r in out["rmse"].collect()} == {0.5}
    crps = {round(r.crps, 9) for r in out["scores"].collect()}
    assert crps == {0.75}  # (1 + 2) / 2 - 3 / 4
    written = [p.name for p in (data / "out" / "t").glob("*/*")]
    assert {"rmse", "scores", "meta"} <= set(written)


def test_spectrum_and_bbox(spark, data):
    out = config.run(spark, {"type": "weather_field_scores", "pred": f"{data}/pred", "obs": f"{data}/obs", "bbox": [-60, 60, 0, 90]})
    assert {(r.n, r.member) for r in out["rmse"].collect()} == {(3 * 3, "a"), (3 * 3, "b")}  # members are scored each
    with pytest.raises(ValueError, match="unknown type"):
        config.Config.of({"type": "nothing"})
    with pytest.raises(ValueError, match="unknown settings"):
        config.Config.of({"type": "batch", "x": 1})


def test_spherical_bands_of_global_fields(spark, sf_dir, tmp_path):
    """The bands of the capability are those of the kernel on each field; a regional field has zonal bands only."""
    import numpy as np

    from gridverity.operators import spectra
    from gridverity.plans.capability_queries import ring_fields

    given = {"type": "weather_field_scores", "metrics": ["spectrum"], "options": {"degrees": 6}, **ring_fields(spark, sf_dir, str(tmp_path))}
    out = config.run(spark, given)
    got = {(r.init.day - 1 + 31 * (r.init.month - 1), r.band): r.power for r in out["spherical_fcst"].collect()}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    whole = [f for f in range(len(vectors) // 13) if all(13 * f + i in vectors for i in range(13))]
    assert len(whole) > 3 and {f for f, _ in got} == set(whole)
    for f in whole[:4]:
        power = spectra.spherical_power(np.array([vectors[13 * f + i] for i in range(13)]), 6)
        assert got[f, "1_4"] == pytest.approx(power[1:5].sum()) and got[f, "5_20"] == pytest.approx(power[5:].sum())
    twice = {(r.init.day - 1 + 31 * (r.init.month - 1), r.band): r.power for r in out["spherical_obs"].collect()}
    assert all(twice[k] == pytest.approx(4 * v) for k, v in got.items())
    regional = config.run(spark, {**given, "bbox": [-60, 60, 0, 360]})
    assert regional["spherical_fcst"].count() == 0 and regional["bands_fcst"].count() > 0


def test_typhoon_intensities_and_storms(spark, sf_dir, tmp_path):
    from gridverity.plans.capability_queries import _storm_tables

    out = config.run(spark, {"type": "typhoon", **_storm_tables(spark, sf_dir, str(tmp_path), tcid=[3])})
    rows = out["members"].collect()
    assert rows and {r.tcid for r in rows} == {3} and all(r.vmax is not None for r in rows)


def test_batch_and_several(spark, data):
    cfg = {"type": "batch", "pred": f"{data}/pred", "obs": f"{data}/obs", "periods": [["2024-01-01", "2024-01-01"]]}
    out = config.run(spark, cfg)
    assert {r.init for r in out["rmse"].collect()} == {dt.datetime(2024, 1, 1)}
    assert out["summary"].count() == 2 and out["long"].count() == 8  # of each member
    assert list(config.run_all(spark, [{**cfg, "name": "a"}, {**cfg, "name": "b", "pred": f"{data}/none"}]).values())[0] is None


def test_rain_capabilities(spark, data, tmp_path):
    grid = spark.read.parquet(f"{data}/pred").select("lat_i", "lon_i", "lat", "lon").distinct()
    steps = spark.createDataFrame([(dt.datetime(2024, 1, 1), 6.0 * k, m, v) for k in (1, 2) for m, v in (("a", 0.0), ("b", 9.0))], "init timestamp, lead_h double, member string, value double")
    steps.crossJoin(grid).withColumn("variable", F.lit("tp")).write.parquet(f"{tmp_path}/pred")
    spark.createDataFrame([(1, 10.0, 20.0), (2, 0.0, 350.0)], "station_id long, lat double, lon double").write.parquet(f"{tmp_path}/stations")
    hours = [(s, dt.datetime(2024, 1, 1, 9) + dt.timedelta(hours=h), float(s == 1)) for s in (1, 2) for h in range(12)]
    spark.createDataFrame(hours, "station_id long, obs_time timestamp, rain double").write.parquet(f"{tmp_path}/obs")
    cfg = {"type": "weather_ts_ens_prob", "pred": f"{tmp_path}/pred", "obs": f"{tmp_path}/obs", "stations": f"{tmp_path}/stations", "grid": [5, 8, -90.0, 45.0]}
    rows = {(r.lead_h, r.threshold): r for r in config.run(spark, cfg)["aroc_bss"].collect()}
    assert rows[(6.0, 4.0)].n_points == 2 and rows[(6.0, 4.0)].aroc == 0.5 and rows[(6.0, 4.0)].base_rate == 0.5


def test_streams_equal_batch(spark, tmp_path):
    hours = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0 * h) for s in (1, 2) for h in range(1, 31) if (s, h) != (2, 3)]
    df = spark.createDataFrame(hours, "station_id long, obs_time timestamp, rain double")
    df.coalesce(1).write.parquet(f"{tmp_path}/h")
    spark.createDataFrame([(9, dt.datetime(2024, 1, 9), 0.0)], df.schema).write.mode("append").parquet(f"{tmp_path}/h")  # moves the watermark
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/h")
    q = rain.rain_windows(stream, 6).writeStream.format("memory").queryName("rain_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.station_id, r.end, r.total) for r in spark.sql("select * from rain_out").collect()}
    want = {(r.station_id, r.obs_time, r.total) for r in categorical.complete_windows(df, 6).where("hour(obs_time) % 6 = 0").collect()}
    assert got == want and len(got) == 9


def test_command_line(spark, data, tmp_path, capsys):
    import json

    from gridverity.__main__ import main

    good = {"type": "batch", "name": "good", "pred": f"{data}/pred", "obs": f"{data}/obs", "out": f"{tmp_path}/out"}
    (tmp_path / "a.json").write_text(json.dumps([good, {**good, "name": "bad", "pred": f"{tmp_path}/none"}]))
    assert main(["run", f"{tmp_path}/a.json"]) == 1
    assert "good: done" in capsys.readouterr().out
    root = next((tmp_path / "out" / "good").glob("fingerprint=*"))
    assert {"rmse", "mean", "summary", "long", "meta", "log"} <= {x.name for x in root.iterdir()}
    assert main(["report", "--model", f"a={root}/rmse", "--model", f"b={root}/rmse", "--out", f"{tmp_path}/report", "--title", "Two of one"]) == 0
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report/report", wholetext=True).collect())
    assert text.startswith("# Two of one") and "| a |" in text
    assert main(["report", "--model", "a=x", "--out", f"{tmp_path}/r"]) == 2
