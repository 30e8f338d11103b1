"""Gridded fields: cell tables in Parquet, file trees, and array files through an optional reader.

Cells are long rows (variable, init, lead_h, member, lat_i, lon_i, lat, lon, value).
Array formats need their libraries on the executors; where these are missing the
reader says so, and fields are ingested as Parquet.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import columns as c

CELL_SCHEMA = "variable string, init timestamp, lead_h double, member string, lat_i int, lon_i int, lat double, lon double, value double"


def cells(spark: SparkSession, path: str | DataFrame, variables: Sequence[str] | None = None, leads: tuple[float, float] | None = None) -> DataFrame:
    """A cell table (its path, or itself); variables and leads are pushed to the scan, fill values become NULL."""
    df = spark.read.parquet(path) if isinstance(path, str) else path
    if variables:
        df = df.where(F.col("variable").isin(*variables))
    if leads:
        df = df.where(F.col("lead_h").between(*leads))
    return df.withColumn("value", c.clean("value"))


# --- places of files ----------------------------------------------------------


def init_in_path(path: Column) -> Column:
    """The start date in a path: a part YYYYMMDD, YYYYMMDDHH or YYYY-MM-DD."""
    text = F.coalesce(F.nullif(F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2}|\d{10}|\d{8})/", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"_(\d{10}|\d{8})(?:00)?_", 1), F.lit("")))
    return c.init_time(text)


def member_in_path(path: Column) -> Column:
    """The member folder of a path, 'det' if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/(member_?\w+)/", 1), F.lit("")), F.lit("det"))


def lead_in_path(path: Column, first_h: float = 6, step_h: float = 6) -> Column:
    """Lead of files that are numbered from 1."""
    return first_h + (F.regexp_extract(path, r"/(\d+)\.\w+$", 1).try_cast("int") - 1) * float(step_h)


def file_tree(files: DataFrame, path: str = "path", first_h: float = 6, step_h: float = 6) -> DataFrame:
    """init, member and lead_h of each file of an ensemble or daily tree."""
    p = F.col(path)
    return files.withColumns({"init": init_in_path(p), "member": member_in_path(p), "lead_h": lead_in_path(p, first_h, step_h)})


def tree_faults(tree: DataFrame) -> DataFrame:
    """Starts whose leads have a gap, or whose number of leads or members is not that of most starts."""
    by = tree.groupBy("init").agg(F.count_distinct("lead_h").alias("n_leads"), F.count_distinct("member").alias("n_members"), ((F.max("lead_h") - F.min("lead_h"))).alias("span"), F.count(F.lit(1)).alias("n"))
    usual = by.agg(F.mode("n_leads").alias("u_leads"), F.mode("n_members").alias("u_members"), F.mode("span").alias("u_span"))
    bad = (F.col("n_leads") != F.col("u_leads")) | (F.col("n_members") != F.col("u_members")) | (F.col("span") != F.col("u_span")) | (F.col("n") != F.col("n_leads") * F.col("n_members"))
    return by.join(F.broadcast(usual), how="cross").where(bad).select("init", "n_leads", "n_members", "n")  # one row


def between_dates(df: DataFrame, first: str, last: str, column: str = "init") -> DataFrame:
    """Starts from first to last, whole days."""
    return df.where((F.col(column) >= F.lit(first).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")))


def two_families(surface: DataFrame, levels: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Both families of files, at the leads that both have, under common variable names."""
    keys = ["init", "lead_h"]
    common = surface.select(*keys).distinct().intersect(levels.select(*keys).distinct())
    both = surface.unionByName(levels, allowMissingColumns=True).join(common, keys, "left_semi")
    name = F.col("variable")
    for old, new in rename.items():
        name = F.when(F.col("variable") == old, F.lit(new)).otherwise(name)
    return both.withColumn("variable", name)


def dual_layout(table: DataFrame, ids: Sequence[str] = ("init", "lead_h", "member", "valid_time", "lat_i", "lon_i", "lat", "lon")) -> DataFrame:
    """Cells from either layout: a channel axis (rows with variable and value) or a column for each variable."""
    if {"variable", "value"} <= set(table.columns):
        return table
    keys = [c for c in table.columns if c in ids]
    names = [c for c in table.columns if c not in ids]
    if not names:
        raise ValueError("a table without variables")
    return table.unpivot(keys, names, "variable", "value")


def first_key(fields: DataFrame, wanted: Sequence[tuple], columns: Sequence[str] = ("short_name", "level"), by: Sequence[str] = ()) -> DataFrame:
    """Rows of the first key of an ordered list that a group has; a part of a key that is None matches anything."""
    rank = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(wanted))):
        same = F.lit(True)
        for name, part in zip(columns, key, strict=True):
            same = same & (F.col(name) == F.lit(part) if part is not None else F.lit(True))
        rank = F.when(same, F.lit(i)).otherwise(rank)
    x = fields.withColumn("__rank", rank).where("__rank is not null")
    if not by:
        best = x.agg(F.min("__rank").alias("__best"))  # one row
        return x.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")
    best = x.groupBy(*by).agg(F.min("__rank").alias("__rank"))
    return x.join(best, [*by, "__rank"], "left_semi").drop("__rank")


def resolved_files(files: DataFrame, keys: Sequence[str] = ("model", "init", "lead_h"), path: str = "path", name: str = "name") -> DataFrame:
    """The files that stand for each key: its exact name, else a loose match in the deterministic folder, else all members.

    files has keys, path and name (what an exact file is called).  source is exact, loose or members;
    members are to be averaged.
    """
    p = F.col(path)
    base = F.element_at(F.split(p, "/"), -1)
    members = p.contains("/ens/")
    rank = F.when(~members & (base == F.col(name)), 0).when(~members & base.contains(F.regexp_replace(F.col(name), r"\.[^.]*$", "")), 1).when(members, 2)
    x = files.withColumn("__rank", rank).where("__rank is not null")
    order = F.dense_rank().over(W.partitionBy(*keys).orderBy("__rank"))
    x = x.withColumn("__first", order).where("__first = 1")
    # one file for a field, the first by name; all files for members
    one = F.row_number().over(W.partitionBy(*keys).orderBy(path))
    x = x.withColumn("__one", one).where("__rank = 2 or __one = 1")
    source = F.element_at(F.array(F.lit("exact"), F.lit("loose"), F.lit("members")), F.col("__rank") + 1)
    return x.withColumn("source", source).drop("__rank", "__first", "__one")


def member_mean(cells: DataFrame, value: str = "value", member: str = "member") -> DataFrame:
    """Cells with their members averaged."""
    return cells.groupBy(*[c for c in cells.columns if c not in (member, value)]).agg(F.avg(value).alias(value))


def model_field(table: DataFrame, variable: str, channel: str | None = None, unit: str = "", lead_h: Column | None = None) -> DataFrame:
    """One variable of a model's table in standard units: its own rows, or those of its channel; latitudes from the north.

    lat_i counts from the northernmost latitude.
    """
    x = table.where(F.col("variable") == (channel or variable)).withColumn("variable", F.lit(variable))
    mean = F.avg("value").over(W.partitionBy(*[c for c in ("model", "init", "lead_h") if c in x.columns]))
    x = x.withColumn("__mean", mean)
    x = x.withColumn("value", c.to_standard_unit("variable", F.lit(unit), "value", "__mean", F.col("lead_h") if lead_h is None else lead_h)).drop("__mean")
    return x.withColumn("lat_i", (F.dense_rank().over(W.partitionBy(*[c for c in ("model", "init", "lead_h") if c in x.columns]).orderBy(F.desc("lat"))) - 1).cast("int"))


def rain_truth(fields: DataFrame, wanted: Sequence[tuple] = (("tp", None), ("apcp", None), ("precip", None)), by: Sequence[str] = ()) -> DataFrame:
    """Gridded rain: the first key that is there, negative amounts as 0."""
    return first_key(fields, wanted, by=by).withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))


def climatology_layouts(tables: Sequence[DataFrame]) -> DataFrame:
    """Climatology from either layout (channel axis, or one table or column for each variable) as variable, slot, cells, value."""
    out = None
    for t in tables:
        t = dual_layout(t, ("slot", "lat_i", "lon_i", "lat", "lon"))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def found_columns(columns: Sequence[str], wanted: dict[str, Sequence[str]]) -> dict[str, str]:
    """Which column stands for each wanted one: by name, then by alias, whatever the case; a missing one is an error."""
    lower = {c.lower(): c for c in columns}
    out = {}
    for name, aliases in wanted.items():
        hit = next((lower[a.lower()] for a in (name, *aliases) if a.lower() in lower), None)
        if hit is None:
            raise ValueError(f"no column for {name}; there are {', '.join(columns)}")
        out[name] = hit
    return out


def structured(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """df with its columns under the wanted names: found_columns()."""
    return df.select(*[F.col(f"`{hit}`").alias(name) for name, hit in found_columns(df.columns, wanted).items()])


def chosen_variables(requested: Sequence[str], sides: Sequence[Sequence[str]], derivable: dict[str, tuple[str, str]], same_rain_grid: bool = False) -> list[str]:
    """Requested variables that all sides have or can derive; rain only on one common grid."""
    have = set(sides[0]).intersection(*map(set, sides[1:]))
    can = have | {name for name, parts in derivable.items() if set(parts) <= have}
    return [v for v in requested if v in can and (v != "tp" or same_rain_grid)]


def aligned_cells(df: DataFrame, lat0: float, step: float, n_lat: int, n_lon: int, tolerance: float = 1e-6) -> DataFrame:
    """lat_i and lon_i from latitudes and longitudes, whatever their direction or first column; off-grid cells are an error."""
    y, x = (F.col("lat") - lat0) / step, c.lon360("lon") / step
    i, j = F.rint(y), F.rint(x)
    fine = (F.abs(y - i) <= tolerance) & (F.abs(x - j) <= tolerance) & i.between(0, n_lat - 1)
    i = F.when(fine, i).otherwise(F.raise_error(F.lit("a cell that is not on the grid")).cast("double"))
    return df.withColumns({"lat_i": i.cast("int"), "lon_i": (j % n_lon).cast("int")})


def calendar_scan(days: DataFrame, files: DataFrame, keys: Sequence[str], skip: bool) -> DataFrame:
    """Days with the rows of their files; a day without a file is missing (NULL), or left out if skip."""
    return days.join(files, list(keys), "inner" if skip else "left")


def alias_key(variable: Column) -> Column:
    """Spelling-independent name: lower case, no underscores."""
    return F.regexp_replace(F.lower(variable), "_", "")


def composite_target(stores: Sequence[DataFrame]) -> DataFrame:
    """Several stores as one: each variable from the first store that has it, whatever its spelling."""
    out = None
    for rank, df in enumerate(stores):
        df = df.withColumn("__rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out = out.withColumn("__key", alias_key(F.col("variable")))
    first = out.groupBy("__key").agg(F.min("__rank").alias("__rank"))  # a row for each variable
    return out.join(first, ["__key", "__rank"], "left_semi").drop("__key", "__rank")


# --- checks -------------------------------------------------------------------


def lead_step_faults(df: DataFrame, allowed: Sequence[float] = (1, 3, 6, 12, 24)) -> DataFrame:
    """Leads whose distance from the one before is none of the usual steps."""
    steps = df.select("variable", "lead_h").distinct().withColumn("step", F.col("lead_h") - F.lag("lead_h").over(W.partitionBy("variable").orderBy("lead_h")))
    ok = F.lit(False)
    for a in allowed:
        ok = ok | (F.abs(F.col("step") - a) < 0.01)
    return steps.where(F.col("step").isNotNull() & ~ok)


def latitude_faults(df: DataFrame) -> DataFrame:
    """One row if latitudes leave the globe or look like radians, else none."""
    lats = df.agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"), F.count_distinct("lat").alias("n"))
    step = (F.col("hi") - F.col("lo")) / F.nullif(F.col("n") - 1, F.lit(0))
    return lats.where((F.col("lo") < -90) | (F.col("hi") > 90) | (step < 0.005))


def standardised(value: Column, mean: Column, std: Column, variable: Column) -> Column:
    """A stored normalised value in its own unit; precipitation is kept as the logarithm of 1 + x."""
    x = value * std + mean
    return c.clean(F.when(variable == "tp", F.expm1(F.greatest(F.lit(0.0), F.least(F.lit(7.0), x)))).otherwise(x))


# --- array files --------------------------------------------------------------


class ArrayPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ArrayReader(DataSourceReader):
    """One partition for each file; rows are cells."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [ArrayPartition(p) for p in self.options["paths"].split(",")]

    def read(self, partition: ArrayPartition) -> Iterator[tuple]:
        import numpy as np
        import xarray as xr

        with xr.open_dataset(partition.path, engine=self.options.get("engine")) as ds:
            lat, lon = (next(n for n in names if n in ds.coords) for names in (("lat", "latitude"), ("lon", "longitude")))
            for name, field in ds.data_vars.items():
                for lead, part in [(None, field)] if "time" not in field.dims else [(t, field.isel(time=i)) for i, t in enumerate(field["time"].values)]:
                    grid = part.transpose(..., lat, lon).values.reshape(-1, ds[lat].size, ds[lon].size)
                    for member, values in enumerate(grid):
                        for i, j in np.ndindex(values.shape):
                            yield (name, None, None if lead is None else float(lead), str(member), i, j, float(ds[lat][i]), float(ds[lon][j]), float(values[i, j]))


class ArrayFiles(DataSource):
    """spark.read.format("array_files").option("paths", "a.nc,b.nc"): NetCDF, HDF5, Zarr or GRIB by xarray's engines."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if importlib.util.find_spec("xarray") is None:
            raise ImportError("array files need xarray and an engine for their format; ingest them as Parquet cells instead")
        return ArrayReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)
