"""Substring dedup on words: repeated windows by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hashed gram of words in
them) travel as one packed string to the minimiser's bucket; there the windows are
sorted and equal ones counted, and the least document that has a window keeps it.
Hashes bring windows together; those are equal whose bytes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, equal_spans, prefix_hashes, span_hashes, words
from .common import NO_ID, table
from .spans import Codec, Strings, covered, keyed, removed_spans, rewritten, sampled

WINDOW_WORDS = 13
GRAM_WORDS = 3


def word_units(gram_words: int):
    """Units of spans.block_strings: words joined by single spaces."""

    def units(block: Block):
        w = words(block)
        prefix, inverse = prefix_hashes(w.norm)
        n = len(w.start)
        if n < gram_words:
            return w.norm, np.zeros(0, np.uint64), w.first, None
        gram = span_hashes(prefix, inverse, w.start[: n - gram_words + 1], w.end[gram_words - 1 :])
        return w.norm, gram, w.first, lambda i, j: (w.start[i], w.end[j - 1])

    return units


def repeated_windows(s: Strings, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a bucket's strings that a smaller document has too: string, first word, last word + 1."""
    space = s.data == 32
    ends = np.zeros(len(s.data) + 1, bool)
    ends[1:][space] = True  # a word starts after a space
    start_flag = ends[:-1]
    start_flag[s.off[:-1]] = True
    starts = np.flatnonzero(start_flag)
    first = np.searchsorted(starts, s.off)
    n = np.diff(first) - window + 1  # windows of each string: at least one
    base = np.repeat(first[:-1], n)
    owner = np.repeat(np.arange(len(n)), n)
    at = base + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    lo = starts[at]
    last = at + window
    is_end = last == first[1:][owner]
    hi = np.where(is_end, s.off[1:][owner], starts[np.minimum(last, len(starts) - 1)] - 1)
    prefix, inverse = prefix_hashes(s.data)
    first_of, group = equal_spans(s.data, lo, hi, span_hashes(prefix, inverse, lo, hi))
    key = s.key[owner]
    least = np.full(len(first_of), np.iinfo(np.int64).max)
    np.minimum.at(least, group, key)
    a = np.flatnonzero(key > least[group])
    word = at[a] - first[owner[a]]
    return owner[a], word, word + window


def deduplicate(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, kept text, and counts of each document without its repeated windows.

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller doc_id; windows are those of the input.  A null text
    has no words.  Rows of one doc_id do not remove from one another; a null
    doc_id counts as larger than all others.  Repeated rows each get the same
    result.  An empty table gives an empty result; extra columns are not read.
    Columns: doc_id, n_words, n_removed, kept (words joined by single spaces).
    """
    base = keyed(docs)
    texts = sampled(base)
    codec = Codec.of(texts)
    spans = removed_spans(base, texts, codec, window, gram, word_units(gram), lambda s: repeated_windows(s, window))

    def rewrite(block: Block, removed: list) -> pa.RecordBatch:
        w = words(block)
        n = np.diff(w.first)
        gone, kept = [], []
        norm = w.norm.tobytes()
        for d, runs in enumerate(removed):
            a, b = int(w.first[d]), int(w.first[d + 1])
            text = norm[w.start[a] : w.end[b - 1]] if b > a else b""
            if runs:
                mask, _ = covered(runs, b - a)
                gone.append(int(mask.sum()))
                text = b" ".join(norm[x:y] for x, y in zip(w.start[a:b][~mask].tolist(), w.end[a:b][~mask].tolist(), strict=True))
            else:
                gone.append(0)
            kept.append(text)
        return pa.RecordBatch.from_arrays([block.rows.column("k"), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["k", "n_words", "n_removed", "kept"])

    out = rewritten(base, codec, spans, rewrite, "k long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_words", "n_removed", "kept")


def op2_substring_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
