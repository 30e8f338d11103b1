"""Classic NetCDF files and chunked stores: exact round trips, odd headers, and errors."""

import json
import struct
import zlib

import numpy as np
import pytest
import zstandard

from gridverity.sources import netcdf


def test_round_trip_of_bytes():
    rng = np.random.default_rng(0)
    names = np.array([list("z500"), list("t2m ")], "S1")
    given = {"time": (("time",), {"units": "hours since 2024-01-01"}, np.array([6.0, 12.0])), "level": (("level", "chars"), {}, names), "n": (("lat",), {}, np.arange(3, dtype="i4")), "data": (("time", "level", "lat", "lon"), {"_FillValue": 9e30, "long name": "x"}, rng.normal(size=(2, 2, 3, 5)).astype("f4"))}
    dims, got = netcdf.read_classic(netcdf.write_classic({"time": 2, "level": 2, "lat": 3, "lon": 5, "chars": 4}, given))
    assert dims == {"time": 2, "level": 2, "lat": 3, "lon": 5, "chars": 4} and list(got) == list(given)
    for k, (ds, attrs, values) in given.items():
        assert got[k][0] == tuple(ds) and (got[k][2] == values).all()
        assert all(got[k][1][a] == v for a, v in attrs.items())
    with pytest.raises(ValueError, match="classic"):
        netcdf.read_classic(b"\x89HDF\r\n")


def test_record_dimension():
    """A file of the first kind with an unlimited axis: two variables, interleaved by record and padded."""
    n = lambda x: struct.pack(">i", x)
    name = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + n(3) + n(10) + n(2) + name("time") + n(0) + name("x") + n(3) + n(0) + n(0) + n(11) + n(2)
    sizes = [len(name(k)) + 4 + 8 + 8 + 4 + 4 + 4 for k in ("a", "b")]
    begin = len(head) + sum(sizes)
    head += name("a") + n(2) + n(0) + n(1) + n(0) + n(0) + n(3) + n(8) + n(begin)
    head += name("b") + n(2) + n(0) + n(1) + n(0) + n(0) + n(6) + n(24) + n(begin + 8)
    a, b = np.arange(9, dtype=">i2").reshape(3, 3), (np.arange(9).reshape(3, 3) / 7).astype(">f8")
    raw = head + b"".join(a[r].tobytes() + b"\0\0" + b[r].tobytes() for r in range(3))
    dims, got = netcdf.read_classic(raw)
    assert dims == {"time": 3, "x": 3} and (got["a"][2] == a).all() and (got["b"][2] == b).all()


def test_cubes_and_headers(spark, tmp_path):
    lat, lon = np.array([-10.0, 0.0, 10.0]), np.arange(1440) * 0.25
    lon[-1] = 360.0  # wrapped
    data = np.arange(2 * 3 * 1440, dtype="f8").reshape(2, 3, 1440)
    data[0, 0, 0] = 9.96e36
    raw = netcdf.write_classic({"time": 2, "lat": 3, "lon": 1440}, {"time": (("time",), {"units": "days since 2024-01-01"}, np.array([0.25, 0.5])), "lat": (("lat",), {}, lat), "lon": (("lon",), {}, lon), "msl": (("time", "lat", "lon"), {}, data)})
    netcdf.put(spark, f"{tmp_path}/a.nc", raw)
    x = netcdf.classic_files(spark, str(tmp_path)).cache()
    assert x.count() == data.size and x.where("value is null").count() == 1
    r = x.where("lat_i = 2 and lon_i = 1439").orderBy("time_h").collect()
    assert [(v.time_h, str(v.time), v.lon, v.value) for v in r] == [(6.0, "2024-01-01 06:00:00", 359.75, data[0, 2, 1439]), (12.0, "2024-01-01 12:00:00", 359.75, data[1, 2, 1439])]
    bad = netcdf.write_classic({"lat": 1, "lon": 1}, {"lat": (("lat",), {}, np.array([91.0])), "lon": (("lon",), {}, np.array([0.0])), "z": (("lat", "lon"), {}, np.zeros((1, 1)))})
    netcdf.put(spark, f"{tmp_path}/bad/b.nc", bad)
    with pytest.raises(Exception, match="beyond the globe"):
        netcdf.classic_files(spark, f"{tmp_path}/bad").collect()


@pytest.mark.parametrize("packed", [None, "zlib", "zstd"])
def test_chunked_store(spark, tmp_path, packed):
    data = np.arange(5 * 2 * 4 * 6, dtype="<f4").reshape(5, 2, 4, 6)
    data[4, 1, 3, 5] = -1
    root = tmp_path / "s.zarr" / "data"
    root.mkdir(parents=True)
    chunks = (2, 1, 4, 4)
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": "<f4", "order": "C", "fill_value": -1, "compressor": packed and {"id": packed}, "filters": None}))
    pack = {None: bytes, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress}[packed]
    for t in range(3):
        for k in range(2):
            for j in range(2):
                block = np.full(chunks, -1, "<f4")
                part = data[2 * t : 2 * t + 2, k : k + 1, :, 4 * j : 4 * j + 4]
                block[tuple(slice(n) for n in part.shape)] = part
                (root / f"{t}.{k}.0.{j}").write_bytes(pack(block.tobytes()))
    x = netcdf.chunked_store(spark, str(tmp_path / "s.zarr"), where={"time": (1, 5), "channel": (1, 2)})
    got = {(r.time_i, r.channel_i, r.lat_i, r.lon_i): r.value for r in x.collect()}
    want = {(t, 1, i, j): None if (t, i, j) == (4, 3, 5) else float(data[t, 1, i, j]) for t in range(1, 5) for i in range(4) for j in range(6)}
    assert got == want


def test_written_grid(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(j), i * 10.0 + j) for i in range(3) for j in range(4)], "lat double, lon double, value double")
    netcdf.write_grid(spark, df, f"{tmp_path}/g.nc", "tcc")
    got = {(r.lat, r.lon): r.value for r in netcdf.classic_files(spark, str(tmp_path)).collect()}
    assert got == {(r.lat, r.lon): r.value for r in df.collect()}
