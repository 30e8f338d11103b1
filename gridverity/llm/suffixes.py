"""Suffix-array dedup on bytes, by the difference-cover algorithm.

The texts' strings meet in buckets by minimiser (see spans), so that equal
50-byte strings are in one bucket.  Each bucket builds the suffix array of its
distinct strings: it sorts and names the triples at positions 1 and 2 modulo 3,
recurses on the names, sorts the remaining suffixes by their first byte and the
rank behind it, and merges both.  Suffixes need to be in order by their first 50
bytes only, which bounds the depth of the recursion.  Neighbours in the array are
then compared on their first 50 bytes; of a run of equal ones the least document
keeps its bytes.  The order across buckets is never needed.

A bucket sets aside strings that cannot repeat: windows that hold their minimiser
at a place in one quarter of the window have the bytes around it in common; if no
other string has the same minimiser with the same bytes around it, for none of the
quarters, no window of the string occurs elsewhere.  Equal strings are one entry,
and the same test among different entries leaves those that get a suffix array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, lanes, prefix_hashes, ragged, same_spans, span_hashes
from .common import NO_ID, table
from .spans import Codec, Strings, covered, keyed, removed_spans, rewritten, sampled, string_hashes

WINDOW_BYTES = 50
GRAM_BYTES = 8
#: A block's work holds about 100 bytes of arrays for each byte of text.
TEXT_BLOCK = 3 << 18


def _pack(columns: list[np.ndarray]) -> np.ndarray:
    """One integer for each row, in the order of the rows as tuples of non-negative integers."""
    out = columns[0].astype(np.uint64)
    top = int(out.max(initial=0))
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (top + 1) * width >= 1 << 64:  # too wide: replace what is there by its ranks
            out = np.unique(out, return_inverse=True)[1].astype(np.uint64)
            top = int(out.max(initial=0))
        out = out * np.uint64(width) + c.astype(np.uint64)
        top = (top + 1) * width - 1
    return out


def suffix_ranks(t: np.ndarray, need: int) -> np.ndarray:
    """The rank of each suffix of t (positive integers and separators 0) by its first `need` symbols at least.

    Suffixes that agree on those stand together, in any order.
    """
    n = len(t)
    rank = np.empty(n, np.int64)
    if need <= 1 or n < 3:
        order = np.lexsort(tuple(np.append(t, np.zeros(n, t.dtype))[k : k + n] for k in range(max(1, min(need, 3)) - 1, -1, -1)))
        rank[order] = np.arange(n)
        return rank
    p = np.concatenate([t, np.zeros(3, t.dtype)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = np.unique(_pack([p[sample], p[sample + 1], p[sample + 2]]), return_inverse=True)[1] + 1
    r12 = np.zeros(n + 3, np.int64)
    if int(names.max(initial=0)) < len(sample):
        reduced = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        below = suffix_ranks(reduced, -(-need // 3))
        names = np.concatenate([below[: len(one)], below[len(one) + 1 :]]) + 1
    r12[sample] = names
    s12 = sample[np.argsort(names, kind="stable")]
    zero = np.arange(0, n, 3)
    key0 = _pack_pair(p[zero], r12[zero + 1], n)
    by0 = np.argsort(key0, kind="stable")
    s0 = zero[by0]
    # how many sampled suffixes are less than each of the others; those that agree on the first `need`
    # symbols have no fixed order, so the counts are made to rise
    first, second = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    less = np.searchsorted(np.sort(_pack_pair(p[first], r12[first + 1], n), kind="stable"), key0[by0])
    wide = _pack([np.concatenate([p[second], p[s0]]), np.concatenate([p[second + 1], p[s0 + 1]]), np.concatenate([r12[second + 2], r12[s0 + 2]])])
    less += np.searchsorted(np.sort(wide[: len(second)], kind="stable"), wide[len(second) :])
    at0 = np.arange(len(s0)) + np.maximum.accumulate(less)
    rank[s0] = at0
    free = np.ones(n, bool)
    free[at0] = False
    rank[s12] = np.flatnonzero(free)
    return rank


def _pack_pair(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return a.astype(np.uint64) * np.uint64(n + 4) + b.astype(np.uint64)


def byte_units(gram_bytes: int):
    """Units of spans.block_strings: bytes."""

    def units(block: Block):
        keep = np.ones(len(block.buf), bool)
        keep[block.off[1:] - 1] = False
        data = block.buf[keep]
        first = block.off - np.arange(len(block.off))
        n = len(data) - gram_bytes + 1
        if n <= 0:
            return data, np.zeros(0, np.uint64), first, None
        prefix, inverse = prefix_hashes(data)
        at = np.arange(n)
        return data, span_hashes(prefix, inverse, at, at + gram_bytes), first, lambda i, j: (i, j)

    return units


def _distinct(data: np.ndarray, off: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal strings: the index of one of the least key for each, and that index for every string."""
    h = string_hashes(data, off)
    order = np.lexsort((key, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    size = np.diff(off)
    same = size[order] == size[lead]
    same[same] = same_spans(data, off[order[same]], off[lead[same]], size[order[same]])
    out = np.empty(len(order), np.int64)
    out[order] = np.where(same, lead, order)  # a collision of hashes stands for itself
    return np.unique(out), out


def _may_repeat(s: Strings, window: int, gram: int, quarters: int = 4) -> np.ndarray:
    """Strings that share their minimiser, with the bytes that a quarter's windows have around it, with another string."""
    at = s.off[:-1] + s.mini
    edges = np.linspace(0, window - gram, quarters + 1).astype(int).tolist()
    out = np.zeros(len(at), bool)
    lane = lanes(s.data)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lo, size = at - a, window - (b - a)
        has = np.flatnonzero((lo >= s.off[:-1]) & (lo + size <= s.off[1:]))
        if size < 8:
            out[has] = True
            continue
        h = np.zeros(len(has), np.uint64)
        with np.errstate(over="ignore"):
            for k in [*range(0, size - 7, 8), size - 8]:
                h = (h ^ lane[lo[has] + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            out[has[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]] = True
    return out


def repeated_bytes(s: Strings, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a bucket's strings that a smaller document has too: string, first byte, last byte + 1."""
    none = np.zeros(0, np.int64)
    live = np.flatnonzero(_may_repeat(s, window, gram))
    if not len(live):
        return none, none, none
    size = np.diff(s.off)[live]
    data = s.data[ragged(s.off[live], size)]
    off = np.concatenate([[0], np.cumsum(size)])
    key = s.key[live]
    leads, of = _distinct(data, off, key)
    # strings of later documents than their equal's least one go whole
    whole = np.flatnonzero(key > key[of])
    # of the distinct ones, those that may share a window with a different string
    own = data[ragged(off[leads], size[leads])]
    leads = leads[_may_repeat(Strings(own, np.concatenate([[0], np.cumsum(size[leads])]), key[leads], key[leads], key[leads], s.mini[live][leads]), window, gram)]
    if not len(leads):
        return live[whole], np.zeros(len(whole), np.int64), size[whole]
    # one text of them, each followed by a separator
    width = size[leads] + 1
    begin = np.cumsum(width) - width
    t = np.zeros(int(width.sum()) + 8, np.int16)
    t[ragged(begin, size[leads])] = data[ragged(off[leads], size[leads])].astype(np.int16) + 1
    rank = suffix_ranks(t, window)
    suffix = np.empty(len(t), np.int64)
    suffix[rank] = np.arange(len(t))
    room = np.zeros(len(t), bool)  # a whole window starts here
    room[ragged(begin, size[leads] - window + 1)] = True
    suffix = suffix[room[suffix]]
    string = np.searchsorted(begin, suffix, "right") - 1
    # compare neighbours on their first `window` bytes
    raw = np.zeros(len(t), np.uint8)
    raw[ragged(begin, size[leads])] = data[ragged(off[leads], size[leads])]
    lane_at = lanes(raw)
    equal = np.ones(len(suffix) - 1, bool)
    for k in [*range(0, window - 7, 8), window - 8]:
        lane = lane_at[suffix + k]
        equal &= lane[1:] == lane[:-1]
    new = np.concatenate([[True], ~equal])
    owner = key[leads][string]
    least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.flatnonzero(least < owner)
    place = suffix[hit] - begin[string[hit]]
    by_lead = leads[string[hit]]
    order = np.lexsort((place, by_lead))
    place, by_lead = place[order], by_lead[order]
    if len(place):  # windows that follow one another make one run
        fresh = np.ones(len(place), bool)
        fresh[1:] = (by_lead[1:] != by_lead[:-1]) | (place[1:] > place[:-1] + window)
        runs = np.flatnonzero(fresh)
        last = np.append(runs[1:], len(place)) - 1
        lo, hi, by_lead = place[runs], place[last] + window, by_lead[runs]
        # all rows of the least document that have this string
        firsts = np.flatnonzero(key == key[of])
        firsts = firsts[np.argsort(of[firsts], kind="stable")]
        a, b = np.searchsorted(of[firsts], by_lead), np.searchsorted(of[firsts], by_lead, "right")
        rows = firsts[ragged(a, b - a)]
        lo, hi = np.repeat(lo, b - a), np.repeat(hi, b - a)
    else:
        rows, lo, hi = none, none, none
    return live[np.concatenate([whole, rows])], np.concatenate([np.zeros(len(whole), np.int64), lo]), np.concatenate([size[whole], hi])


def deduplicate(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, others: Sequence[str] = ()) -> DataFrame:
    """Each document's bytes without strings of `window` bytes that a smaller doc_id has too.

    Texts are whole, as UTF-8 bytes; a null one is empty.  A byte goes if a string
    of `window` bytes that covers it also starts in a document with a smaller
    doc_id; overlaps count and strings are those of the input.  Rows of one doc_id
    do not remove from one another; a null doc_id counts as larger than all
    others; repeated rows each get the same result; an empty table gives an empty
    result; extra columns are not read, but for those named in `others`.
    Columns: doc_id, n_bytes, n_removed, n_spans, kept (binary), text (kept, with
    bytes of cut characters dropped), and the others.
    """
    base = keyed(docs, others)
    extra = [f.name for f in base.schema.fields if f.name not in ("k", "row", "text")]
    kinds = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in extra)
    texts = sampled(base)
    codec = Codec.of(texts)
    spans = removed_spans(base, texts, codec, window, gram, byte_units(gram), lambda s: repeated_bytes(s, window, gram), TEXT_BLOCK)

    def rewrite(block: Block, removed: list) -> pa.RecordBatch:
        size = np.diff(block.off) - 1
        gone, spans, kept, text = [], [], [], []
        for d, runs in enumerate(removed):
            raw = block.buf[block.off[d] : block.off[d + 1] - 1]
            mask, k = covered(runs, len(raw)) if runs else (None, 0)
            gone.append(0 if mask is None else int(mask.sum()))
            spans.append(k)
            kept.append((raw if mask is None else raw[~mask]).tobytes())
            text.append(kept[-1].decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays(
            [block.rows.column("k"), pa.array(size.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(text, pa.string()), *(block.rows.column(c) for c in extra)],
            names=["k", "n_bytes", "n_removed", "n_spans", "kept", "text", *extra],
        )

    out = rewritten(base, codec, spans, rewrite, "k long, n_bytes long, n_removed long, n_spans long, kept binary, text string" + kinds)
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "text", *[F.col(x).alias(c) for x, c in zip(extra, others, strict=True)])


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
