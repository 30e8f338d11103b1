"""Session helpers that every operator of this subpackage shares.

Rules kept here once:

* the folder for cut lineage comes from ``spark.checkpoint.dir``; a temporary
  folder is used only on one machine (local master) where the session names none;
* the number of shuffle partitions comes from the session, so a cluster sizes it;
* operators read only the columns they need, so extra columns of any name are harmless.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts after every other id.
NO_ID = 2**63 - 1
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder, or at a temporary one if none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a shared folder")
        named = tempfile.mkdtemp(prefix="gridverity-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def doc_key() -> Column:
    """doc_id as a non-null long that orders documents."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def whole_text() -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def public_id(key: str) -> Column:
    """The doc_id of an internal key: the stand-in for null becomes null again."""
    return F.when(F.col(key) != NO_ID, F.col(key)).alias("doc_id")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_small(df: DataFrame) -> bool:
    """Whether a table has BROADCAST_ROWS rows at most; it should be checkpointed."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def look_up(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """left joined with right, which has one row at most for each key; both should be checkpointed.

    A right side of BROADCAST_ROWS rows at most is broadcast.  Otherwise keys with
    more rows than a quarter of a mean partition are hot: there are fewer than 4 of
    them for each partition, so their rows of `right` are broadcast, and no key's
    rows have to meet in one task.
    """
    keys = list(keys)
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    most = left.count() // (4 * partitions(left.sparkSession)) + 1
    hot = cut(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*keys))
    cold = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    warm = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return cold.unionByName(warm)
