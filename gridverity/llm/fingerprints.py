"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the ascending array of the k least distinct hashes of a text's
shingles.  The sketch of a union is the k least of both sketches, so sketches of
parts (pages, shards, months) merge to that of the whole, and two sketches
estimate resemblance (Jaccard), containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, doc_key, partitions, table, whole_text

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
_SPACES = " \t\n\x0b\x0c\r"
#: Cells of equal numbers of ids, at most; they are divided further where there are more partitions.
MAX_CELLS = 2_048


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words (runs of bytes other than 0x20 and 0x09-0x0D), in order."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: Column, width: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> Column:
    """The sketch of a text by its word_hashes(), which should be a column (it is read often).

    A text of fewer than `width` words has one shingle, its words; one of none has none.
    """
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    shingles = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(shingles)), 1, k))


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both; 1 for two empty ones."""
    union = merge(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_count(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(sketches: DataFrame, key: str, column: str = "sketch", k: int = SKETCH_SIZE, salts: int = 64) -> DataFrame:
    """(key, sketch) merged over all rows of each key; a hot key is cut to `salts` parts first.

    Null sketches count as empty ones; a key of empty ones only has no row.
    """
    hashes = sketches.select(key, F.explode(column).alias("h")).distinct()
    for by in ([key, F.pmod("h", F.lit(salts))], [key]):
        hashes = hashes.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("h"))).where(F.col("__r") <= k).drop("__r")
    return hashes.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def with_cells(rows: DataFrame, key: str, tie: str, cell: str) -> DataFrame:
    """rows with the number of an interval of (key, tie); intervals are in that order and about equally full.

    Bounds are approximate quantiles of the key (MAX_CELLS numbers at most); where the
    session has more partitions, each interval is divided evenly.  A key that several
    quantiles fall on is divided by its ties (hashes) into as many intervals.
    """
    wanted = partitions(rows.sparkSession) * 8
    cells = min(MAX_CELLS, wanted)
    shares = [i / cells for i in range(cells + 1)]
    quantiles = rows.agg(F.percentile_approx(key, shares, 20 * cells).alias("q")).first()[0]
    if not quantiles:
        return rows.withColumn(cell, F.lit(0).cast("long"))
    bounds = sorted(set(quantiles))
    parts = -(-wanted // cells)
    all_bounds = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.greatest(F.size(F.filter(all_bounds, lambda b: b <= F.col(key))), F.lit(1))
    rows = rows.withColumn("__at", at)
    lo = F.element_at(all_bounds, F.col("__at"))
    hi = F.element_at(all_bounds, F.least(F.col("__at") + 1, F.lit(len(bounds))))
    share = (F.col(key).cast("double") - lo) / F.greatest(hi.cast("double") - lo, F.lit(1.0))
    inner = F.least(F.floor(share * parts), F.lit(parts - 1))
    # a hot key is a bound itself, the least of its interval: its own parts come before the others
    many = {b: n * parts for b in bounds if (n := quantiles.count(b)) > 1}
    most = max(many.values(), default=0)
    own = F.lit(None)
    if many:
        times = F.element_at(F.create_map(*[F.lit(x) for b, n in many.items() for x in (b, n)]), F.col(key))
        place = (F.col(tie).cast("double") + 2.0**63) / 2.0**64
        own = F.least(F.floor(place * times), times - 1)
    inner = F.coalesce(own, inner + most)
    return rows.withColumn(cell, (F.col("__at") * (parts + most) + inner).cast("long")).drop("__at")


def fingerprint_documents(docs: DataFrame, width: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to each other and to the next document.

    The next document is that of the next smaller doc_id, after the smallest the
    largest; null ids come before all others, and rows of one id are in the order
    of a hash of their texts.  The edited text has the last floor(n_chars / 2) code
    points replaced by the first as many of the next document, or all of it if
    it has fewer.  A single document is its own next one.  A null text is empty; an
    empty text has an empty fingerprint, and two empty ones are alike (1).  An
    empty table gives an empty result; extra columns are not read.

    Documents are shuffled once, by intervals of doc_id; each interval also gets
    the first document of the interval after it.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(doc_key().alias("k"), whole_text().alias("text"))
    rows = with_cells(rows.withColumn("h", F.xxhash64("text")), "k", "h", "cell")
    # each interval's first document goes to the interval before it as well (in descending order)
    heads = rows.groupBy("cell").agg(F.max(F.struct("k", "h")).alias("x"))
    after = W.orderBy("cell")
    heads = heads.select("x", F.coalesce(F.lead("cell").over(after), F.min("cell").over(W.partitionBy())).alias("to"))
    heads = heads.select(F.col("x.k").alias("hk"), F.col("x.h").alias("hh"), "to")
    guests = rows.join(F.broadcast(heads), (F.col("k") == F.col("hk")) & (F.col("h") == F.col("hh")))  # a row for each interval
    rows = rows.select("cell", F.lit(0).alias("guest"), "k", "h", "text").unionByName(guests.select(F.col("to").alias("cell"), F.lit(1).alias("guest"), "k", "h", "text"))
    rows = rows.repartition(n, "cell").withColumn("w", word_hashes(F.col("text")))
    rows = rows.select("cell", "guest", "k", "h", "text", sketch(F.col("w"), width, k).alias("sketch"))
    order = W.partitionBy("cell").orderBy("guest", F.desc("k"), F.desc("h"))
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select("k", size.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", "next_sketch", word_hashes(F.col("edited")).alias("w"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("w"), width, k))
    return rows.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
