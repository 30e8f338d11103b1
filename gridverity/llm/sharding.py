"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards.  A row descends it: at each level every
child draws ``-ln(u) / weight`` from a hash of the row's key and the child's
name, and the least draw wins, so a child gets rows in proportion to its weight.
A draw depends on nothing but the key, the child and its weight.  If a weight
grows, rows move only into that child's subtree; if it shrinks, only out of it.

All of it is built from SQL functions; a row is never compared with another row,
so there is nothing to skew and no group to keep together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, table

#: Two regions of two racks of two shards, of equal weights.
BASE = (((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0)))


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard]; shards are numbered from 0 in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...] = BASE

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: no older subtree changes its weight.

        Rows then move only into the new shard.
        """
        return Tree((*self.weights, ((weight,),)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the upper 53 bits of a hash of child and key."""
    if weight <= 0:
        return F.lit(float("inf"))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
    return -F.log((bits + 0.5) / float(2**53)) / float(weight)


def _least(key: Column, children: Sequence[tuple[str, float, int]]) -> Column:
    """The number of the child with the least draw; ties go to the smaller number."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(n).alias("n")) for name, w, n in children]))["n"]


def place(key: Column, tree: Tree) -> Column:
    """The shard (int) of a key."""
    number = 0
    regions = []
    for r, region in enumerate(tree.weights):
        racks = []
        for k, rack in enumerate(region):
            shards = [(f"shard/{r}/{k}/{s}", w, number + s) for s, w in enumerate(rack)]
            number += len(rack)
            racks.append((f"rack/{r}/{k}", sum(rack), k, _least(key, shards)))
        chosen = _least(key, [(name, w, k) for name, w, k, _ in racks])
        shard = racks[-1][3]
        for _, _, k, below in racks[:-1]:
            shard = F.when(chosen == k, below).otherwise(shard)
        regions.append((f"region/{r}", sum(map(sum, region)), r, shard))
    chosen = _least(key, [(name, w, r) for name, w, r, _ in regions])
    out = regions[-1][3]
    for _, _, r, below in regions[:-1]:
        out = F.when(chosen == r, below).otherwise(out)
    return out.cast("int")


def with_slots(df: DataFrame, shard: str, cell: str, order: Sequence[Column], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are ranked in (shard, cell) groups, whose sizes are summed up over the
    cells before them; no task gets a whole shard.
    """
    sizes = df.groupBy(shard, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(shard, cell).orderBy(*order)) - 1)
    return ranked.join(starts, [shard, cell]).withColumn(slot, (F.col("__start") + F.col("__rank")).cast("long")).drop("__start", "__rank")


def shard_documents(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """Each document's shard, its slot there, and its shard when there is one more.

    The law is `key`: doc_id and the tree decide.  Equal texts need not stay
    together under it.  A null text has no bytes (size 1, CRC of nothing); null
    doc_ids are one key and share a shard; repeated rows each get a slot of
    their own; an empty table gives an empty one.  Columns other than doc_id and
    text are not read.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")
    cells = partitions(spark) * 8
    placed = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree).alias("shard"),
        place(key, tree.grown()).alias("grown_shard"),
        # rows without a doc_id are spread by their text
        F.pmod(F.xxhash64(F.lit("cell"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(cells)).cast("int").alias("__cell"),
    )
    out = with_slots(placed, "shard", "__cell", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
