"""Command line: run configurations, summarise an archive, compare models.

    python -m gridverity run a.json b.json
    python -m gridverity summarise ARCHIVE --out FOLDER
    python -m gridverity report --model NAME=ARCHIVE --model NAME=ARCHIVE --out FOLDER [--title TEXT]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import config
from .session import builder, scratch, ship
from .sources import archive


def run(spark: SparkSession, files: list[str]) -> int:
    """Each file is a configuration or a list of them; 1 if any of them failed."""
    found: list[dict] = []
    for f in files:
        text = "\n".join(r.value for r in spark.read.text(f, wholetext=True).collect())  # one small document
        given = json.loads(text)
        found += given if isinstance(given, list) else [given]
    failed = 0
    for name, error in config.run_all(spark, found).items():
        print(f"{name}: {error or 'done'}")
        failed += error is not None
    return int(failed > 0)


def summarise(spark: SparkSession, path: str, out: str) -> int:
    config.run(spark, {"type": "summarise", "pred": path, "out": out, "name": "summary"})
    return 0


def report(spark: SparkSession, models: list[str], out: str, title: str) -> int:
    """Tables of a comparison, as Parquet and as one Markdown text."""
    if len(models) < 2:
        print("a comparison needs two models", file=sys.stderr)
        return 2
    scores = None
    for m in models:
        name, _, path = m.partition("=")
        x = spark.read.parquet(path).drop("model").withColumn("model", F.lit(name)).select("model", "init", "variable", "lead_h", "rmse")
        scores = x if scores is None else scores.unionByName(x)
    joined = f"{scratch(spark)}/scores"
    scores.write.parquet(joined)
    tables = config.run(spark, {"type": "report", "pred": joined})
    parts = [f"# {title}\n"]
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        keys = [c for c in ("band", "lead_h", "variable", "model", "model_a", "model_b") if c in df.columns]
        parts.append(f"## {name}\n\n{archive.markdown(df, keys)}")
    spark.createDataFrame([("\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("gridverity")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("run").add_argument("files", nargs="+")
    v = verbs.add_parser("summarise")
    v.add_argument("archive")
    v.add_argument("--out", required=True)
    v = verbs.add_parser("report")
    v.add_argument("--model", action="append", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--title", default="Comparison of models")
    given = p.parse_args(args)
    spark = builder("gridverity").getOrCreate()
    ship(spark)
    if given.verb == "run":
        return run(spark, given.files)
    if given.verb == "summarise":
        return summarise(spark, given.archive, given.out)
    return report(spark, given.model, given.out, given.title)


if __name__ == "__main__":
    sys.exit(main())
