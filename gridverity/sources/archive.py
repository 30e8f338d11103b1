"""Metric archives: versioned and prioritised reads, fingerprinted writes, long form, and resume."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]


def newest(rows: DataFrame, keys: Keys, version: Keys) -> DataFrame:
    """The row of the greatest version of each key."""
    order = [F.desc(v) for v in version]
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def fingerprint(config: dict) -> str:
    """Sixteen hexadecimal digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def archive_path(root: str, name: str, config: dict) -> str:
    return f"{root}/{name}/fingerprint={fingerprint(config)}"


def write_scores(scores: DataFrame, path: str, date: str = "init_date") -> None:
    """Write metric rows by date; dates that are written again replace their partition only."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def finished_dates(spark: SparkSession, path: str, date: str = "init_date") -> DataFrame:
    """Dates that an archive has; none if it is not there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{date} date")
    return spark.read.parquet(path).select(date).distinct()


def pending(wanted: DataFrame, spark: SparkSession, path: str, date: str = "init_date") -> DataFrame:
    """Wanted dates that a resumed run still has to do."""
    return wanted.join(finished_dates(spark, path, date), date, "left_anti")


def write_csv(table: DataFrame, path: str, keys: Keys, column: str | None = None, value: str = "value") -> None:
    """A small table as one CSV with a header; wide by `column` if given."""
    out = table.groupBy(*keys).pivot(column).agg(F.first(value)) if column else table
    out.coalesce(1).orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def write_date_csv(scores: DataFrame, path: str, metric: str, date: str = "init_date", member: str = "member") -> None:
    """CSVs of one metric by date and member, named <metric>_<date>_<member>; numbers have six significant digits."""
    name = F.concat_ws("_", F.lit(metric), F.date_format(date, "yyyyMMdd"), F.col(member))
    kinds = dict(scores.dtypes)
    digits = [F.format_string("%.6g", c).alias(c) if kinds[c] == "double" else F.col(c) for c in scores.columns if c not in (date, member)]
    scores.select(*digits, name.alias("file")).write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Run metadata as one JSON document."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_log(spark: SparkSession, path: str, events: Sequence[dict]) -> None:
    """Append a run's events as JSON lines."""
    spark.createDataFrame([(json.dumps(e, sort_keys=True, default=str),) for e in events], "value string").coalesce(1).write.mode("append").text(path)


def load_archive(spark: SparkSession, root: str, table: str = "rmse", date: str = "init_date") -> tuple[DataFrame, dict]:
    """A table of an archive by date, and the run's metadata."""
    meta = [json.loads(r.value) for r in spark.read.text(f"{root}/meta").limit(1).collect()]
    return spark.read.parquet(f"{root}/{table}"), (meta[0] if meta else {})


def strict_dates(scores: DataFrame, dates: DataFrame, models: Sequence[str], date: str = "init", model: str = "model") -> DataFrame:
    """Rows of the dates; an error if a model lacks one of them."""
    names = F.explode(F.array(*[F.lit(m).cast(scores.schema[model].dataType) for m in models]))
    wanted = dates.select(date).distinct().withColumn(model, names)
    lacking = wanted.join(scores.select(date, model).distinct(), [date, model], "left_anti").limit(1).collect()
    if lacking:
        raise ValueError(f"model {lacking[0][model]} has no scores of {lacking[0][date]}")
    return scores.join(dates.select(date).distinct(), date, "left_semi")


def with_means(scores: DataFrame, keys: Keys, member: str = "member") -> DataFrame:
    """Rows read back for a resumed run: a deterministic member also stands for the ensemble mean where there is none."""
    has = scores.where(F.col(member) == "ensmean").select(*keys).distinct()
    det = scores.where(F.col(member) == "det").join(has, list(keys), "left_anti")
    return scores.unionByName(det.withColumn(member, F.lit("ensmean")))


def wavenumber_rows(table: DataFrame) -> DataFrame:
    """(variable, wavenumber, field, value): rows of a summary table whose scope is a wave number."""
    x = table.where(F.col("scope") == "wavenumber").select("variable", F.col("wavenumber").try_cast("int").alias("wavenumber"), "field", F.col("value").try_cast("double").alias("value"))
    return x.where("wavenumber is not null and value is not null")


def spectrum_details(table: DataFrame, variable: str | None = None, lead_h: float | None = None) -> DataFrame:
    """(variable, lead_h, wavenumber, value): rows of a detail table whose group is k=<number>."""
    x = table.where(F.col("group").rlike(r"^k=\d+$"))
    if variable is not None:
        x = x.where(F.col("variable") == variable)
    if lead_h is not None:
        x = x.where(F.col("lead_h") == lead_h)
    return x.select("variable", "lead_h", F.regexp_extract("group", r"(\d+)", 1).cast("int").alias("wavenumber"), "value")


def merged_csv(spark: SparkSession, path: str, schema: str, accum_hours: int) -> DataFrame:
    """CSVs of many starts as one table with init_date, from a file's or folder's name, and accum_hours."""
    x = spark.read.schema(schema).option("header", True).csv(path).withColumn("__p", F.input_file_name())
    day = F.regexp_extract("__p", r"(\d{4}-\d{2}-\d{2}|\d{8})[^/]*(/part[^/]*)?$", 1)
    return x.withColumns({"init_date": F.to_date(F.regexp_replace(day, "-", ""), "yyyyMMdd"), "accum_hours": F.lit(accum_hours)}).drop("__p")


def tagged(tables: dict[str, DataFrame], column: str = "table") -> DataFrame:
    """Several tables as one, each row with its table's name."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def markdown(table: DataFrame, order: Keys, most: int = 1_000) -> str:
    """A small table as Markdown; one of more than `most` rows is an error, as a report should not be cut."""
    rows = table.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no report")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def read_csv_metrics(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Metric CSVs with their file's date and kind; of one date's files `_det` comes first, a bare one next, ensembles last."""
    x = spark.read.schema(schema).option("header", True).csv(list(paths)).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]*?)(/part-[^/]*)?$", 1)  # a file, or a folder of parts
    kind = F.when(name.contains("_det"), 0).when(~name.rlike("_(ensmean|ens)"), 1).otherwise(2)
    x = x.withColumns({"init_date": F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date"), "priority": kind})
    return x.withColumn("__b", F.min("priority").over(W.partitionBy("init_date"))).where("priority = __b").drop("__b")
