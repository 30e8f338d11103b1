"""Classic NetCDF files and chunked array stores, read from bytes that Spark's own file source gives.

A file (or chunk) is one record of `binaryFile`, so any store that Spark reads will
do, and each is parsed in the task that has it.  Formats: the classic format and its
64-bit variants (magic CDF 1, 2 and 5); chunked stores of version 2 whose chunks are
plain, zlib, gzip or zstd.  Files of the HDF5 kind need the reader of `gridded`.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from . import gridded

# fixed values: type numbers of the classic format, and tags of its lists
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
LAT, LON, TIME, LEVEL = ("lat", "latitude", "y"), ("lon", "longitude", "x"), ("time", "step", "lead", "lead_time"), ("level", "channel", "isobaricInhPa", "plev")
_RAW = "path string, variable string, level string, time double, unit string, lat_i int, lon_i int, lat double, lon double, n_lon int, first_lon double, last_lon double, value double"


class _Bytes:
    """A cursor over the header."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 4
        self.version = raw[3]

    def number(self, wide: bool = False) -> int:
        n = 8 if wide else 4
        self.at += n
        return int.from_bytes(self.raw[self.at - n : self.at], "big")

    def count(self) -> int:
        return self.number(self.version == 5)

    def padded(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        self.at += n + -n % 4
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def attributes(self) -> dict:
        self.number()
        out = {}
        for _ in range(self.count()):
            name, kind = self.name(), self.number()
            n = self.count()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\x00") if kind == 2 else np.frombuffer(raw, TYPES[kind])[:n]
        return out


def read_classic(raw: bytes) -> tuple[dict[str, int], dict[str, tuple[tuple[str, ...], dict, np.ndarray]]]:
    """Lengths of dimensions, and (dimensions, attributes, values) of each variable."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    h = _Bytes(raw)
    records = h.count()
    h.number()
    dims = [(h.name(), h.count()) for _ in range(h.count())]
    h.attributes()
    h.number()
    listed = []
    for _ in range(h.count()):
        name = h.name()
        ids = [h.count() for _ in range(h.count())]
        attrs, kind = h.attributes(), h.number()
        size, begin = h.count(), h.number(h.version > 1)
        listed.append((name, ids, attrs, np.dtype(TYPES[kind]), size, begin))
    moving = [v for v in listed if v[1] and dims[v[1][0]][1] == 0]  # variables along the record dimension
    stride = sum(v[4] for v in moving)
    if len(moving) == 1:  # a single one is not padded
        stride = math.prod(dims[i][1] for i in moving[0][1][1:]) * moving[0][3].itemsize
    if records >= (1 << 64) - 1 or (h.version != 5 and records == (1 << 32) - 1):
        records = (len(raw) - min(v[5] for v in moving)) // stride if moving else 0
    lengths = {n: k or records for n, k in dims}
    out = {}
    for v in listed:
        name, ids, attrs, kind, _, begin = v
        shape = [dims[i][1] or records for i in ids]
        if v in moving:
            each = math.prod(shape[1:])
            data = np.concatenate([np.frombuffer(raw, kind, each, begin + r * stride) for r in range(records)]) if records else np.zeros(0, kind)
        else:
            data = np.frombuffer(raw, kind, math.prod(shape), begin)
        out[name] = (tuple(dims[i][0] for i in ids), attrs, data.reshape(shape))
    return lengths, out


def write_classic(dims: dict[str, int], variables: dict[str, tuple[Sequence[str], dict, np.ndarray]]) -> bytes:
    """A file of the 64-bit offset kind, all dimensions fixed; values are stored as int32, float32, float64 or characters."""
    number = lambda n: struct.pack(">i", n)
    fill = lambda b: b + b"\x00" * (-len(b) % 4)
    name = lambda s: number(len(s.encode())) + fill(s.encode())
    kinds = {np.dtype("i4"): 4, np.dtype("f4"): 5, np.dtype("f8"): 6, np.dtype("S1"): 2}

    def attributes(given: dict) -> bytes:
        out = (number(ATTRIBUTES) if given else number(0)) + number(len(given))
        for key, value in given.items():
            raw = value.encode() if isinstance(value, str) else np.asarray(value, ">f8").tobytes()
            out += name(key) + number(2 if isinstance(value, str) else 6) + number(len(raw) if isinstance(value, str) else len(raw) // 8) + fill(raw)
        return out

    order = list(dims)
    head = b"CDF\x02" + number(0) + number(DIMENSIONS) + number(len(dims)) + b"".join(name(d) + number(n) for d, n in dims.items()) + attributes({})
    bodies = {k: fill(np.ascontiguousarray(v[2]).astype(v[2].dtype.newbyteorder(">")).tobytes()) for k, v in variables.items()}
    size = lambda k, v: len(name(k)) + 4 + 4 * len(v[0]) + len(attributes(v[1])) + 16
    at = len(head) + 8 + sum(size(k, v) for k, v in variables.items())
    head += number(VARIABLES) + number(len(variables))
    for k, (ds, attrs, values) in variables.items():
        head += name(k) + number(len(ds)) + b"".join(number(order.index(d)) for d in ds) + attributes(attrs) + number(kinds[values.dtype]) + number(len(bodies[k])) + struct.pack(">q", at)
        at += len(bodies[k])
    return head + b"".join(bodies.values())


def _axis(names: Sequence[str], wanted: Sequence[str]) -> str | None:
    return next((n for w in wanted for n in names if n.lower() == w.lower()), None)


def _texts(values: np.ndarray) -> list[str]:
    """Labels of a level axis: rows of characters, or numbers."""
    if values.dtype.kind == "S":
        return [b"".join(r).decode("utf-8", "replace").strip("\x00 ") for r in values.reshape(len(values), -1)]
    return [f"{v:g}" for v in values.tolist()]


def _fields(path: str, variables: dict) -> Iterator[pa.RecordBatch]:
    """A batch of cells for each two-dimensional field of a file."""
    axes = {n for ds, _, _ in variables.values() for n in ds}
    lat, lon, time, level = (_axis(sorted(axes), w) for w in (LAT, LON, TIME, LEVEL))
    if lat is None or lon is None:
        raise ValueError(f"{path} has no latitudes or longitudes; its dimensions are {', '.join(sorted(axes))}")
    la, lo = (np.asarray(variables[n][2], float).ravel() for n in (lat, lon))
    times = np.asarray(variables[time][2], float).ravel() if time in variables else None
    unit = variables[time][1].get("units", "") if time in variables else ""
    levels = _texts(variables[level][2]) if level in variables else None
    i, j = np.divmod(np.arange(len(la) * len(lo)), len(lo))
    same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(len(i), np.int64)))
    for name, (ds, attrs, values) in variables.items():
        if lat not in ds or lon not in ds:
            continue
        rest = [d for d in ds if d not in (lat, lon)]
        if extra := [d for d in rest if d not in (time, level) and values.shape[ds.index(d)] > 1]:
            raise ValueError(f"{path}: {name} has unknown dimensions {', '.join(extra)}")
        grid = np.moveaxis(values, [ds.index(lat), ds.index(lon)], [-2, -1])
        scale, offset = (float(np.asarray(attrs[k]).ravel()[0]) if k in attrs else v for k, v in (("scale_factor", 1.0), ("add_offset", 0.0)))
        missing = [float(np.asarray(attrs[k]).ravel()[0]) for k in ("_FillValue", "missing_value") if k in attrs and not isinstance(attrs[k], str)]
        for place in itertools.product(*(range(n) for n in grid.shape[:-2])):
            at = dict(zip(rest, place, strict=True))
            x = grid[place].astype(float).ravel()
            x = np.where(np.isin(x, missing), np.nan, x * scale + offset)
            label = levels[at[level]] if levels and level in at else None
            yield pa.RecordBatch.from_arrays(
                [same(path, pa.string()), same(name, pa.string()), same(label, pa.string()), same(None if times is None or time not in at else times[at[time]], pa.float64()), same(unit, pa.string()),
                 pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(la[i]), pa.array(lo[j]), same(len(lo), pa.int32()), same(float(lo[0]), pa.float64()), same(float(lo[-1]), pa.float64()), pa.array(x)],
                names=[f.split()[0] for f in _RAW.split(", ")],
            )


def _checked(raw: DataFrame, step: float) -> DataFrame:
    """Raw fields as cells: names from levels, repaired longitudes, latitudes on the globe, times, missing values as NULL."""
    mean = (F.col("last_lon") - F.col("first_lon")) / F.greatest(F.col("n_lon") - 1, F.lit(1))
    broken = c.header_is_broken("first_lon", "last_lon", "n_lon", mean, step * 0.96, step * 1.04)
    lat = F.when(F.abs("lat") <= 90, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("latitudes beyond the globe in "), F.col("path"))).cast("double"))
    name = F.when(F.col("level").isNull(), F.col("variable")).when(F.col("variable").isin("data", "__xarray_dataarray_variable__"), F.col("level")).otherwise(F.concat_ws("", "variable", "level"))
    return raw.select("path", name.alias("variable"), c.hours_from_unit("time", "unit").alias("time_h"), c.time_from_unit("time", "unit").alias("time"), "lat_i", "lon_i", lat.alias("lat"), c.repaired_lon("lon_i", "lon", broken, step).alias("lon"), c.clean("value").alias("value"))


def classic_files(spark: SparkSession, paths: str | Sequence[str], step: float = 0.25) -> DataFrame:
    """Cells (path, variable, time_h, time, lat_i, lon_i, lat, lon, value) of all classic files below the paths; step: the grid's, in degrees."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from _fields(path.as_py(), read_classic(content.as_py())[1])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nc").load([paths] if isinstance(paths, str) else list(paths))
    return _checked(files.select("path", "content").mapInArrow(parse, _RAW), step)


def forecast_tree(spark: SparkSession, root: str, first_h: float = 6, step_h: float = 6, step: float = 0.25, members: Sequence[str] | None = None) -> DataFrame:
    """Cells of a tree of starts, members and numbered leads: init, member and lead come from each file's path.

    members: suffixes of the member folders that are wanted.
    """
    x = gridded.file_tree(classic_files(spark, root, step), "path", first_h, step_h)
    if members:
        wanted = F.lit(False)
        for m in members:
            wanted = wanted | F.col("member").endswith(m)
        x = x.where(wanted)
    return x.select("variable", "init", "lead_h", "member", "lat_i", "lon_i", "lat", "lon", "value")


# --- chunked stores -----------------------------------------------------------


def _unpacked(raw: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return raw
    if kind in ("zlib", "gzip"):
        return zlib.decompress(raw) if kind == "zlib" else gzip.decompress(raw)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"chunks are packed by {kind}")


def chunked_store(spark: SparkSession, path: str, array: str = "data", dims: Sequence[str] = ("time", "channel", "lat", "lon"), where: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(time_i, channel_i, lat_i, lon_i, value), or as dims are called, of one array of a chunked store of version 2.

    where: index ranges [start, stop) by dimension; chunks beyond them are not read.  A chunk that is not
    there holds the fill value, and has no rows.
    """
    spec = json.loads(take(spark, f"{path}/{array}/.zarray"))
    shape, chunks, kind, order = spec["shape"], spec["chunks"], np.dtype(spec["dtype"]), spec.get("order", "C")
    if spec.get("zarr_format") != 2 or spec.get("filters"):
        raise ValueError("a store of version 2 without filters is needed")
    mark = spec.get("dimension_separator", ".")
    fill = spec.get("fill_value")
    ranges = [(where or {}).get(d, (0, n)) for d, n in zip(dims, shape, strict=True)]
    names = [f"{d}_i" for d in dims]
    schema = ", ".join([*(f"{n} int" for n in names), "value double"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path"), batch.column("content"), strict=True):
                index = [int(x) for x in p.as_py().split(f"/{array}/", 1)[1].replace("/", mark).split(mark)]
                data = np.frombuffer(_unpacked(content.as_py(), spec.get("compressor")), kind).reshape(chunks, order=order)
                at = np.stack([g.ravel() for g in np.indices(data.shape)]) + np.array([a * b for a, b in zip(index, chunks, strict=True)])[:, None]
                keep = np.ones(at.shape[1], bool)
                for row, (lo, hi), n in zip(at, ranges, shape, strict=True):
                    keep &= (row >= lo) & (row < min(hi, n))
                x = data.astype(float).ravel()[keep]
                if isinstance(fill, (int, float)):
                    x = np.where(x == fill, np.nan, x)
                yield pa.RecordBatch.from_arrays([*(pa.array(row[keep].astype(np.int32)) for row in at), pa.array(x)], names=[*names, "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{array}")
    tail = F.replace(F.regexp_extract("path", rf"/{array}/([0-9./]+)$", 1), F.lit("/"), F.lit(mark))
    files = files.where(tail != "")
    for k, ((lo, hi), size) in enumerate(zip(ranges, chunks, strict=True)):
        number = F.element_at(F.split(tail, "[.]" if mark == "." else mark), k + 1).cast("int")
        files = files.where((number * size < hi) & ((number + 1) * size > lo))
    out = files.select("path", "content").mapInArrow(parse, schema)
    return out.withColumn("value", c.clean("value"))


def take(spark: SparkSession, path: str) -> bytes:
    """One small file; Spark's own readers pass over names that start with a dot."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through the file system that Spark has for its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


def write_grid(spark: SparkSession, grid: DataFrame, path: str, name: str = "data", most: int = 10_000_000) -> None:
    """One field (lat, lon, value) as a classic file; a table of more than `most` cells is an error."""
    rows = grid.select("lat", "lon", "value").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("that is more than one field")
    wide = rows.pivot(index="lat", columns="lon", values="value")
    put(spark, path, write_classic({"lat": len(wide.index), "lon": len(wide.columns)}, {"lat": (("lat",), {"units": "degrees_north"}, wide.index.to_numpy(float)), "lon": (("lon",), {"units": "degrees_east"}, wide.columns.to_numpy(float)), name: (("lat", "lon"), {}, wide.to_numpy(float))}))
