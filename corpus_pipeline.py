"""The training-data pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridverity.llm.common import ensure_checkpoint_dir, free_name, table
from gridverity.llm.near_duplicates import keep_one
from gridverity.llm.packing import pack_documents
from gridverity.llm.quality import keep_good
from gridverity.llm.suffixes import deduplicate
from gridverity.llm.toxicity import THRESHOLD, add_score


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not; the others go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the others go."""
    score = free_name(docs, "toxicity")
    return add_score(docs, table(spark, sf_dir, "labels"), score).where(F.col(score) < THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more: that of the smallest doc_id."""
    return keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that a smaller doc_id has too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = deduplicate(docs, others=others).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]

#: Trained classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is a table in the shared folder.

    The last table is what the result is read from, so it stays there; the tables
    before it are removed.  Null and empty texts, repeated rows, an empty table and
    columns of any names are as the stages' operators describe them.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k in range(len(STAGES) - 1):
        gone = path(f"{folder}/{k}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
