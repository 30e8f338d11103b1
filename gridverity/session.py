"""Session set-up: a builder with the settings the engine expects, and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def builder(app: str = "gridverity", master: str | None = None) -> SparkSession.Builder:
    """A session builder with UTC time and adaptive execution; sizes stay with the cluster's own settings."""
    out = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return out.master(master) if master else out


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one where a local session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a shared folder")
        named = tempfile.mkdtemp(prefix="gridverity-scratch-")
        atexit.register(shutil.rmtree, named, True)
    return f"{named}/scratch-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path already has it."""
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if str(ROOT.parent) in on_path or getattr(sc, "_gridverity_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        archive = os.path.join(folder, f"{ROOT.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(ROOT.rglob("*.py")):
                out.write(path, f"{ROOT.name}/{path.relative_to(ROOT)}")
        sc.addPyFile(archive)
    sc._gridverity_shipped = True
