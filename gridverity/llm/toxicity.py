"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its lower-cased text, hashed to
slots.  A slot's log-count ratio compares how many toxic and other documents of
the training sample have it; a logistic regression is fitted on the presences
times these ratios.  A feature is any slot whose counts in the two classes differ
by more than chance (of those chosen, FALSE_SHARE are expected to be there without
cause).  The labelled sample decides how many they are; there is no other bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks
from .common import table
from .learning import base_rate, fit_sparse, held_out, sigmoid, training_rows

ORDERS = (3, 4, 5)
SLOT_BITS = 21
#: Training documents of each class, at most; and training documents that a feature has, at least.
MAX_SAMPLE = 2_000
MIN_DOCUMENTS = 3
FALSE_SHARE = 0.1
THRESHOLD = 0.3
BLOCK = 1 << 19

_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """Lower case of each code point below 2**16 that has one of one character; white space becomes a space."""
    global _lower
    if _lower is None:
        out = np.arange(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            if not 0xD800 <= i < 0xE000:
                c = chr(i)
                if c.isspace():
                    out[i] = 32
                elif len(low := c.lower()) == 1 and ord(low) < 1 << 16:
                    out[i] = ord(low)
        _lower = out
    return _lower


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a block, separators included, and each document's first."""
    points = np.frombuffer(block.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    small = points < 1 << 16
    points = np.where(small, lower_table()[np.where(small, points, 0)], points)
    lead = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
    return points, lead[block.off]


def gram_slots(points: np.ndarray, order: int) -> np.ndarray:
    """The slot of the n-gram from each position on (as far as there are n code points)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def presences(block: Block, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each distinct n-gram; n-grams hold one separator at most, at their end.

    wanted: which slots to look at.
    """
    points, first = code_points(block)
    found = []
    for order in ORDERS:
        slot = gram_slots(points, order)
        at = np.arange(len(slot)) if wanted is None else np.flatnonzero(wanted[slot])
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + order <= first[doc + 1]
        found.append(doc[inside] << SLOT_BITS | slot[at[inside]])
    both = np.unique(np.concatenate(found))
    return both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1)


def chance_bound(surprise: np.ndarray) -> float:
    """The least number of standard deviations beyond which at most FALSE_SHARE of the slots are expected to be there by chance."""
    ordered = np.sort(surprise)
    for z in np.arange(2.0, 8.0, 0.05).tolist():
        beyond = len(ordered) - int(np.searchsorted(ordered, z, "right"))
        if len(ordered) * erfc(z / 2**0.5) <= FALSE_SHARE * beyond:
            return z
    return 8.0


def fit(texts: Iterator[pa.RecordBatch], rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights, and the intercept, from batches of (y, text); rate: share of label 1 beyond the sample."""
    size = 1 << SLOT_BITS
    counts = np.zeros((2, size), np.int32)  # documents of each class that have a slot
    held, labels = [], []
    for block in blocks(texts, limit=BLOCK):
        y = block.column("y").astype(np.int64)
        doc, slot = presences(block)
        for c in (0, 1):
            counts[c] += np.bincount(slot[y[doc] == c], minlength=size).astype(np.int32)
        held.append(block)
        labels.append(y)
    y = np.concatenate(labels).astype(np.float64) if labels else np.zeros(0)
    rate = min(max(rate, 1e-4), 1 - 1e-4)
    prior = float(np.log(rate / (1 - rate)))
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    if not n1 or not n0:
        return np.zeros(0, np.int64), np.zeros(0), prior
    q, p = counts
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    # how far the counts are from those of a slot that says nothing, in standard deviations
    share = (p + q + 1) / (n + 2)
    surprise = np.abs(p / n1 - q / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    seen = p + q >= MIN_DOCUMENTS
    chosen = np.flatnonzero(seen & (surprise > chance_bound(surprise[seen])))
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    sizes, cols = [], []
    for block in held:
        doc, slot = presences(block, place >= 0)
        sizes.append(np.bincount(doc, minlength=block.rows.num_rows))
        cols.append(place[slot])
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    w, b = fit_sparse(first, np.concatenate(cols), ratio[chosen], y)
    return chosen, w * ratio[chosen], b + prior - float(np.log(n1 / n0))


def fit_distributed(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, fitted in one task on a sample of `most` documents of each class at most."""
    rate = base_rate(labels, "toxic")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, intercept = fit(batches, rate)
        yield pa.RecordBatch.from_arrays([pa.array([slots.astype("<i8").tobytes()]), pa.array([weights.astype("<f8").tobytes()]), pa.array([intercept])], names=["slots", "weights", "intercept"])

    row = training_rows(docs, labels, "toxic", most).mapInArrow(train, "slots binary, weights binary, intercept double").first()
    if row is None:  # there was nothing to run on
        return fit(iter(()), rate)
    return np.frombuffer(row.slots, "<i8"), np.frombuffer(row.weights, "<f8"), row.intercept


def add_score(docs: DataFrame, labels: DataFrame, score: str = "score", most: int = MAX_SAMPLE) -> DataFrame:
    """docs with a column `score`: the probability (0 to 1) that a document is toxic.

    Whole texts are scored; a null or empty one gets the score of no features.
    Without labels of both classes all scores are the base rate.  No other column
    is an input of a score.  Repeated rows get equal scores; an empty table stays
    empty.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_distributed(docs, labels, most))  # 2**SLOT_BITS weights at most
    fields = [f for f in docs.schema.fields if f.name != score]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, intercept = model.value
        wanted = np.zeros(1 << SLOT_BITS, bool)
        wanted[slots] = True
        weight = np.zeros(1 << SLOT_BITS)
        weight[slots] = weights
        for block in blocks(batches, limit=BLOCK):
            n = block.rows.num_rows
            total = np.full(n, intercept)
            if len(slots):
                doc, slot = presences(block, wanted)
                total += np.bincount(doc, weight[slot], n)
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(sigmoid(total))], names=[*names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, StructType([*fields, StructField(score, DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
