import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridverity.sources import archive, gridded, station_text


@pytest.fixture
def stations(tmp_path):
    for hour, n in ((1, 2), (2, 3)):
        rows = "\n".join(f"{50000 + i} 1{i}.5 4{i}.0 10 {i * 0.5}" for i in range(2))
        (tmp_path / f"240101{hour:02d}.000").write_bytes(f"diamond 3 rain\n24 01 01 {hour:02d} 0 0 {n}\n{rows}\n".encode("gbk"))
    return tmp_path


def test_hourly_stations(spark, stations):
    good = station_text.hourly_stations(spark, f"{stations}/24010101.000").orderBy("station_id").collect()
    assert [(r.station_id, r.obs_time, r.rain) for r in good] == [(50000, dt.datetime(2024, 1, 1, 1), 0.0), (50001, dt.datetime(2024, 1, 1, 1), 0.5)]
    with pytest.raises(Exception, match="damaged"):  # it declares three rows and has two
        station_text.hourly_stations(spark, f"{stations}/24010102.000").collect()
    assert station_text.hourly_stations(spark, f"{stations}/24010102.000", strict=False).count() == 2


def test_whitelist_and_reference(spark, tmp_path):
    (tmp_path / "list.txt").write_text("50001 a\n50009 b\n")
    (tmp_path / "010106.000").write_text("50001 0.5 0.4 0.3 0.2\n")
    rows = spark.createDataFrame([(50001, dt.datetime(2024, 1, 1, 6)), (50002, dt.datetime(2024, 1, 1, 6))], "station_id long, valid_time timestamp")
    assert station_text.keep_listed(rows, station_text.whitelist(spark, f"{tmp_path}/list.txt")).count() == 1
    got = station_text.with_reference(rows, station_text.reference_probabilities(spark, f"{tmp_path}/010106.000")).orderBy("station_id").collect()
    assert got[0].probs == [0.5, 0.4, 0.3, 0.2] and got[1].probs is None


def test_best_track_keeps_analyses(spark, tmp_path):
    (tmp_path / "b.dat").write_text("diamond 7\nNAME 2401 x\nheader\n2024 7 1 8 0 120.5 20.5 980 30\n2024 7 1 8 24 121 21 970 35\n")
    got = station_text.best_track(spark, f"{tmp_path}/b.dat").collect()
    assert len(got) == 1 and got[0].tcid == "2401" and got[0].lat == 20.5 and got[0].vmax_ms == 30.0


def test_trees_and_targets(spark):
    files = [(f"/r/20240101/member_{m}/{k:03d}.nc",) for m in "ab" for k in (1, 2)] + [("/r/2024-01-02/001.nc",), ("/r/2024-01-03/002.nc",)]
    tree = gridded.file_tree(spark.createDataFrame(files, "path string"))
    got = {(str(r.init)[:10], r.member, r.lead_h) for r in tree.collect()}
    assert ("2024-01-01", "member_a", 12.0) in got and ("2024-01-02", "det", 6.0) in got
    assert gridded.between_dates(tree, "2024-01-02", "2024-01-02").count() == 1
    a = spark.createDataFrame([("z_500", 1.0)], "variable string, value double")
    b = spark.createDataFrame([("z500", 2.0), ("t2m", 3.0)], "variable string, value double")
    assert {(r.variable, r.value) for r in gridded.composite_target([a, b]).collect()} == {("z_500", 1.0), ("t2m", 3.0)}
    leads = spark.createDataFrame([("a", 6.0), ("a", 12.0), ("a", 19.0)], "variable string, lead_h double")
    assert gridded.lead_step_faults(leads).count() == 1
    assert gridded.latitude_faults(spark.createDataFrame([(-1.57,), (0.0,), (100.0,)], "lat double")).count() == 1


def test_archive_round_trip(spark, tmp_path):
    assert archive.fingerprint({"a": 1, "b": 2}) == archive.fingerprint({"b": 2, "a": 1}) != archive.fingerprint({"a": 2, "b": 2})
    path = f"{tmp_path}/scores"
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d string").select(F.to_date("d").alias("init_date"))
    assert archive.pending(days, spark, path).count() == 2
    archive.write_scores(days.limit(1).withColumn("rmse", F.lit(1.0)), path)
    assert archive.pending(days, spark, path).count() == 1
    versions = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "k int, v int, p string")
    assert {r.p for r in archive.newest(versions, ["k"], ["v"]).collect()} == {"y", "z"}


def test_metric_files_by_priority(spark, tmp_path):
    for name, v in (("rmse_20240101_det", 1.0), ("rmse_20240101", 2.0), ("rmse_20240102_ensmean", 3.0)):
        (tmp_path / f"{name}.csv").write_text(f"lead_h,z500\n6,{v}\n")
    got = archive.read_csv_metrics(spark, [f"{tmp_path}/*.csv"], "lead_h double, z500 double").orderBy("init_date").collect()
    assert [r.z500 for r in got] == [1.0, 3.0]


def test_array_reader_says_what_it_needs(spark):
    gridded.register(spark)
    with pytest.raises(Exception, match="xarray"):
        spark.read.format("array_files").option("paths", "/x.nc").load().count()
