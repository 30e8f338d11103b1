"""SimHash fingerprints, and near-duplicates by pivot distance tables.

Fingerprints: a bit is 1 if more than half of a document's shingle hashes have it.

Links: distinct fingerprints meet in buckets so that each pair within the radius
r shares a bucket (of b blocks of bits, b - r stay equal), then within a bucket in
slabs of their distance to a first pivot.  A bucket's fingerprints have a table of
Hamming distances to all pivots.  By the triangle inequality two of them cannot be
within r if a coordinate differs by more than r; such pairs are discarded and the
others are verified.  A bucket that is still large is split again, by narrower
blocks of which pairs within r share some, so its pairs are never tried all.  A
bucket gives a spanning forest of its links, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, ragged, words
from .common import NO_ID, cut, doc_key, free_name, look_up, partitions, table, whole_text
from .components import components, unite
from .xxh import xxh64

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
N_PIVOTS = 24
#: Rows of a bucket that is not split; blocks of bits, beyond the radius, that a larger one is split by.
SPLIT_ROWS = 4_096
SPLIT_BLOCKS = 3

#: Byte value -> its bits as eight byte-wide counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes h[first[d] : first[d + 1]] have each bit: a row of 64 for each d; none may be empty."""
    n = np.diff(first)
    runs = -(-n // 255)  # byte-wide counters hold 255
    at = ragged(np.zeros(len(n), np.int64), runs) * 255 + np.repeat(first[:-1], runs)
    run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((len(n), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], at)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
    return out


def fingerprints(block: Block, width: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 SimHash of each document of a block."""
    w = words(block, lower=True)
    n = np.diff(w.first)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = ragged(w.first[:-1], shingles)
    last = start + np.repeat(np.minimum(n, width) - 1, shingles)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        h = xxh64(w.norm, w.start[start], w.end[last], SEED)
        counts = bit_counts(h, np.concatenate([[0], np.cumsum(shingles[some])]))
        ones = counts * 2 > shingles[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """n reference fingerprints from a counter and a mixing function."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def distance_table(fp: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each reference."""
    return np.stack([np.bitwise_count(fp ^ p).astype(np.int16) for p in reference])


def _bit_keys(n_blocks: int, radius: int) -> list[int]:
    """Masks of all choices of n_blocks - radius of n_blocks blocks of bits: a pair within the radius is equal under one."""
    edges = np.linspace(0, 64, n_blocks + 1).astype(int)
    masks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(n_blocks), n_blocks - radius)]


def linked_labels(key: np.ndarray, home: np.ndarray, fp: np.ndarray, radius: int, reference: np.ndarray) -> np.ndarray:
    """label[i]: the least row that row i reaches by links; rows of equal keys stand together.

    Rows of one key, if there are more than SPLIT_ROWS, are split by keys of narrow blocks of bits.
    """
    label = np.arange(len(fp))
    if not len(fp):
        return label
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    hot = np.repeat(sizes > SPLIT_ROWS, sizes)
    rows = np.flatnonzero(~hot)
    label = _linked(label, rows, key, home, fp, radius, reference)
    for s, n in zip(starts[sizes > SPLIT_ROWS].tolist(), sizes[sizes > SPLIT_ROWS].tolist(), strict=True):
        rows = np.arange(s, s + n)
        for mask in _bit_keys(radius + SPLIT_BLOCKS, radius):
            part = fp[rows] & np.uint64(mask)
            order = np.lexsort((fp[rows], part))
            label = _linked(label, rows[order], part[order], home, fp, radius, reference, own_keys=True)
    return label


def _linked(label: np.ndarray, rows: np.ndarray, key: np.ndarray, home: np.ndarray, fp: np.ndarray, radius: int, reference: np.ndarray, own_keys: bool = False) -> np.ndarray:
    """Joins the labels of linked rows; keys stand in the order of `rows` (own_keys) or are indexed by them."""
    k = key if own_keys else key[rows]
    h, f = home[rows], fp[rows]
    coordinate = distance_table(f, reference)
    i = np.arange(len(f) - 1)
    step = 1
    while True:
        i = i[: np.searchsorted(i, len(f) - step)]
        i = i[k[i] == k[i + step]]
        if not len(i):
            return label
        a = i[h[i] | h[i + step]]
        for row in coordinate:
            if not len(a):
                break
            a = a[np.abs(row[a] - row[a + step]) <= radius]
        if len(a):
            a = a[np.bitwise_count(f[a] ^ f[a + step]) <= radius]
            label = unite(label, rows[a], rows[a + step])
        step += 1


def _layout(n: int, radius: int) -> int:
    """Blocks of bits: more of them, and so longer keys, the more fingerprints there are."""
    return radius + (1 if n <= 1 << 22 else 2 if n <= 1 << 32 else 3)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius of each other.

    prints has distinct fp (long) and the least key k of each; a and b are structs (k, fp).
    """
    spark = prints.sparkSession
    n_blocks = _layout(prints.count(), radius)
    reference = pivots()
    keys = _bit_keys(n_blocks, radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d0 = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(reference[0])))))
    slab = F.floor(d0 / (radius + 1)).cast("int")
    rows = prints.select("fp", "k", d0.alias("d0"), slab.alias("slab"))
    rows = rows.select("fp", "k", "d0", "slab", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for t, m in enumerate(keys)])).alias("x"))
    at_home = rows.select(F.xxhash64("x.t", "x.bits", "slab").alias("key"), F.lit(True).alias("home"), "fp", "k")
    # a pair in neighbouring slabs is compared in the lower one
    guests = rows.where(F.col("d0") % (radius + 1) < radius).select(F.xxhash64(F.col("x.t"), F.col("x.bits"), F.col("slab") - 1).alias("key"), F.lit(False).alias("home"), "fp", "k")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # rows of the last key so far: it may go on in the next batch

        def found(parts: list[tuple]) -> pa.RecordBatch:
            key, home, fp, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            label = linked_labels(key, home, fp.view(np.uint64), radius, reference)
            rows = np.flatnonzero(label != np.arange(len(label)))
            to = label[rows]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[rows], k[rows], fp[to], k[to])], names=["fp_a", "k_a", "fp_b", "k_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "home", "fp", "k"))
            key = new[0]
            done = int(np.searchsorted(key, key[-1]))
            if done or (kept and kept[-1][0][-1] != key[0]):
                yield found([*kept, tuple(x[:done] for x in new)])
                kept = []
            kept.append(tuple(x[done:] for x in new))
        if kept:
            yield found(kept)

    met = at_home.unionByName(guests).repartition(partitions(spark), "key").sortWithinPartitions("key")
    out = met.mapInArrow(links, "fp_a long, k_a long, fp_b long, k_b long")
    return out.select(F.struct(F.col("k_a").alias("k"), F.col("fp_a").alias("fp")).alias("a"), F.struct(F.col("k_b").alias("k"), F.col("fp_b").alias("fp")).alias("b"))


def fingerprint_documents(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(k, row, fp): key, hash of the text and fingerprint of each document; k stands in for a null doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.rows.column("k"), block.rows.column("row"), pa.array(fingerprints(block, width).view(np.int64))], names=["k", "row", "fp"])

    return docs.select(doc_key().alias("k"), F.xxhash64(whole_text()).alias("row"), "text").mapInArrow(run, "k long, row long, fp long")


def _grouped(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """k, row, fp and root (a struct, k being the component's least key) of each document."""
    prints = cut(fingerprint_documents(docs, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("k").alias("k")))
    # nodes are in the order of their least keys, so a component's root has the least of all
    roots = components(fingerprint_links(distinct, radius))
    named = roots.where("node != root").select(F.col("node.fp").alias("fp"), "root")
    own = distinct.select("fp", F.struct("k", "fp").alias("own"))
    named = cut(own.join(named, "fp", "left").select("fp", F.coalesce("root", "own").alias("root")))
    return look_up(prints, named, ["fp"], "inner")


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document.

    Texts are whole; a null one has no words, hence fingerprint zero, which is
    linked like any other.  Equal fingerprints are one node, so copies cost
    nothing.  Rows without a doc_id get the component of the others that they
    link to; a component of such rows alone has no id.  Repeated rows stay.  An
    empty table gives an empty result; extra columns are not read.
    """
    return _grouped(docs, width, radius).select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("root.k") != NO_ID, F.col("root.k")).alias("component_id"),
    )


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of each root in grouped (k, row, root): that of the least doc_id (null comes last), all columns as they were."""
    k, row = free_name(docs, "__k"), free_name(docs, "__row")
    first = grouped.groupBy("root").agg(F.min(F.struct("k", "row")).alias("x")).select(F.col("x.k").alias(k), F.col("x.row").alias(row))
    rows = docs.withColumns({k: doc_key(), row: F.xxhash64(whole_text())})
    return rows.join(first, [k, row], "left_semi").dropDuplicates([k, row]).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component of fingerprints: keep_first()."""
    return keep_first(docs, _grouped(docs, width, radius))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
