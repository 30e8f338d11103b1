"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Document evidence is the log likelihood ratio of a logistic classifier on a
text's make-up (letters, case, symbols, repetition).  Hosts (`source`) and the
paths below them (`source`, `lang`) have rates of good documents: Beta posteriors
whose priors are the level above, of a strength estimated from the spread among
that level's members.  A site with few documents therefore has about its parent's
rate.  A document is kept if evidence and its path's rate make it likelier good
than not.

Sites are counted with grouped aggregation over all documents, each by the
probability that its evidence gives.  A document is left out of the rates of its own
site, so its evidence counts once.  Features are computed in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .blocks import Block, blocks, prefix_hashes, span_hashes, words
from .common import cut, free_name, look_up, table
from .learning import base_rate, fit_dense, held_out, training_rows

THRESHOLD = 0.5
#: Training documents of each class, at most.
MAX_SAMPLE = 6_000
BLOCK = 1 << 20
#: Columns that judge() adds beside the evidence.
ADDED = ("host_rate", "path_rate", "score", "keep")

_UPPER, _LOWERCASE, _DIGIT, _STOP, _SYMBOL, _LINE, _PIPE, _HIGH = range(8)
_KIND = np.full(256, 8, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWERCASE, _DIGIT
_KIND[[44, 46, 58, 59, 63, 39, 40, 41, 45, 34]] = _STOP
_KIND[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = _SYMBOL
_KIND[10], _KIND[124] = _LINE, _PIPE
_KIND[128:] = _HIGH


def features(block: Block) -> np.ndarray:
    """A row of numbers for each document: shares of kinds of bytes, and how its words repeat."""
    n = len(block.off) - 1
    size = np.diff(block.off).astype(float)
    kind = _KIND[block.buf]
    shares = np.stack([np.add.reduceat((kind == k).astype(np.int64), block.off[:-1]) / size for k in range(8)])
    w = words(block)
    count = np.diff(w.first)
    prefix, inverse = prefix_hashes(w.norm)
    h = span_hashes(prefix, inverse, w.start, w.end)
    length = np.bincount(w.doc, (w.end - w.start).astype(float), n) / np.maximum(count, 1)
    order = np.lexsort((h, w.doc))
    hs, ds = h[order], w.doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n) / np.maximum(count, 1)
    starts = np.flatnonzero(new)
    top = np.zeros(n)
    if len(starts):
        np.maximum.at(top, ds[starts], np.diff(np.append(starts, len(hs))))
    top /= np.maximum(count, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    echo = np.bincount(w.doc[again], minlength=n) / np.maximum(count, 1)
    few = 1 / np.sqrt(count + 1.0)
    return np.stack([*np.sqrt(shares), *shares, np.minimum(length, 40) / 10, distinct * np.sqrt(np.minimum(count, 400)) / 20, distinct, top, np.sqrt(top), echo, np.sqrt(echo), few, top * few], axis=1)


def fit(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Rows mean, scale and weights (intercept last; it is the sample's own log odds of nothing): 3 x (features + 1)."""
    xs, ys = [], []
    for block in blocks(batches, limit=BLOCK):
        xs.append(features(block))
        ys.append(block.column("y").astype(float))
    y = np.concatenate(ys) if ys else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return np.zeros((3, 0))
    x = np.concatenate(xs)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = fit_dense((x - mean) / scale, y)
    w[-1] -= np.log(y.mean() / (1 - y.mean()))  # a likelihood ratio, whatever the classes' shares in the sample
    return np.stack([np.append(mean, 0), np.append(scale, 1), w])


def evidence(block: Block, model: np.ndarray) -> np.ndarray:
    if not model.shape[1]:
        return np.zeros(block.rows.num_rows)
    mean, scale, w = model
    z = ((features(block) - mean[:-1]) / scale[:-1]) @ w[:-1] + w[-1]
    return np.clip(z, -30, 30)


def add_evidence(docs: DataFrame, labels: DataFrame, name: str, most: int = MAX_SAMPLE) -> DataFrame:
    """docs with the classifier's log likelihood ratio of a good document."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([fit(batches).astype("<f8").tobytes()])], names=["model"])

    row = training_rows(docs, labels, "quality", most).mapInArrow(train, "model binary").first()
    model = np.frombuffer(row.model if row else b"", "<f8").reshape(3, -1)  # no row: there was nothing to run on
    fields = list(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            yield pa.RecordBatch.from_arrays([*block.rows.columns, pa.array(evidence(block, model))], names=[*(f.name for f in fields), name])

    return docs.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, parent: str) -> Column | float:
    """Prior strength by the method of moments: how little rates k / n spread around their parents'.

    The parents' binomial variance over that of the rates in excess of sampling noise, from 1 to 10000.
    """
    p, n = F.col("k") / F.col("n"), F.col("n")
    m = F.col(parent)
    row = sites.where("n > 0").agg(
        F.sum(n * (p - m) * (p - m)).alias("between"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(n * m * (1 - m)).alias("whole"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not row.sites or not row.whole:
        return 100.0
    excess = row.between - row.noise
    return 10_000.0 if excess <= 0 else float(min(10_000.0, max(1.0, row.whole / excess)))


def sites(seen: DataFrame, rate: float) -> tuple[DataFrame, float, float]:
    """Counts of each site, and the prior strengths of hosts and of paths; seen has (host, path, good), good being a probability.

    Columns: host, path, k and n (sum of good and number of documents), host_k, host_n, host_rate, path_rate.
    """
    # the hot host is summed up before the shuffle; the tables below have a row for each site
    paths = cut(seen.groupBy("host", "path").agg(F.sum("good").alias("k"), F.count("good").cast("double").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("m", F.lit(rate))
    a = _strength(hosts, "m")
    hosts = hosts.select("host", F.col("k").alias("host_k"), F.col("n").alias("host_n"), ((F.col("k") + a * F.col("m")) / (F.col("n") + a)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    b = _strength(paths, "host_rate")
    return paths.withColumn("path_rate", (F.col("k") + b * F.col("host_rate")) / (F.col("n") + b)), a, b


def judged(scored: DataFrame, rate: float, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, evidence: str = "evidence", names: Sequence[str] = ADDED) -> DataFrame:
    """scored (checkpointed, with evidence) and host_rate, path_rate, score and keep under the given names; the rates leave the document itself out."""
    here = [free_name(scored, f"__{x}") for x in ("host", "path", "good")]
    h = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00"))
    p = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("\x00"))
    good = 1 / (1 + F.exp(-(F.col(f"`{evidence}`") + float(np.log(rate / (1 - rate))))))
    rows = scored.withColumns(dict(zip(here, (h, p, good), strict=True)))
    counts, a, b = sites(rows.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(here, ("host", "path", "good"), strict=True)]), rate)
    of_site = {c: free_name(rows, f"__{c}") for c in ("k", "n", "host_k", "host_n")}
    counts = cut(counts.select(F.col("host").alias(here[0]), F.col("path").alias(here[1]), *[F.col(c).alias(x) for c, x in of_site.items()]))
    k, n, host_k, host_n = (F.col(x) for x in of_site.values())
    g = F.col(here[2])
    host_rate = (host_k - g + a * rate) / (host_n - 1 + a)
    path_rate = (k - g + b * host_rate) / (n - 1 + b)
    score = 1 / (1 + F.exp(-(F.col(f"`{evidence}`") + _logit(path_rate))))
    out = look_up(rows, counts, here[:2])
    return out.select(*[F.col(f"`{c}`") for c in scored.columns], host_rate.alias(names[0]), path_rate.alias(names[1]), score.alias(names[2]), (score >= threshold).alias(names[3]))


def label_rate(labels: DataFrame) -> float:
    """Share of good documents among the labels that may be learnt from, kept away from 0 and 1."""
    return min(max(base_rate(labels, "quality"), 1e-3), 1 - 1e-3)


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MAX_SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and evidence, host_rate, path_rate, score (0 to 1), keep.

    Whole texts count; a null one is empty and has little evidence either way.
    Null hosts or paths are a site of their own.  Labels with a null, and those
    that are held out, are not learnt from; without labels of both classes there
    is no document evidence, and the prior rate is the share of good labels (0.5
    without labels), kept between 0.001 and 0.999.  A site's only document has its
    parent's rate.  Repeated rows are judged alike; an empty table stays empty.
    The five columns that are added replace ones of those names.
    """
    docs = docs.drop("evidence", *ADDED)
    return judged(cut(add_evidence(docs, labels, "evidence", most)), label_rate(labels), host, path, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MAX_SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns as they were, whatever these are called."""
    evidence = free_name(docs, "evidence")
    scored = cut(add_evidence(docs, labels, evidence, most))
    names = [free_name(docs, x) for x in ADDED]
    out = judged(scored, label_rate(labels), host, path, threshold, evidence, names)
    return out.where(F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep of all documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels")
    scored = cut(add_evidence(docs, labels, "evidence").drop("text"))
    return judged(scored, label_rate(labels)).select("doc_id", "evidence", *ADDED)
