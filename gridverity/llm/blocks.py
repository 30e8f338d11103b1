"""Arrow batches of texts as flat byte buffers, and vectorised work on them.

A block is a few megabytes of consecutive documents in one buffer, each followed
by one separator byte.  Everything below costs a few array passes per byte; no
Python code runs per word or per window.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# freed batches go back to the system, not to a pool of each worker
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None) if sys.platform == "linux" else None


def release() -> None:
    """Give free memory back; at the end of a task, as its worker stays for the next."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: Text bytes in a block; a document longer than this is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(int(_BASE), -1, 2**64)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]).cumprod(dtype=np.uint64)
            _inverses = np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(inverse))]).cumprod(dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def span_hashes(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans [start, end), by prefix sums of prefix_hashes()."""
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value times power, and the inverse powers."""
    power, inverse = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out, inverse


@dataclass
class Block:
    """Documents k[i] with row hash h[i]; their bytes are buf[off[i] : off[i + 1] - 1]."""

    rows: pa.RecordBatch
    buf: np.ndarray
    off: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split batches to blocks of about `limit` bytes of text (whole documents)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy() + 1)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            data = b"\n".join(t or b"" for t in texts.slice(at, stop - at).to_pylist()) + b"\n"
            off = np.concatenate([[0], ends[at:stop] - base])
            yield Block(batch.slice(at, stop - at), np.frombuffer(data, np.uint8), off)
            at = stop
    release()


@dataclass
class Words:
    """Words of a block, each followed by one space in `norm`.

    Word i is norm[start[i] : end[i]] and belongs to document doc[i];
    document d has words first[d] to first[d + 1].
    """

    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(block: Block, lower: bool = False) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    space = SPACE[block.buf]
    after = np.empty_like(space)
    after[0] = False
    np.logical_not(space[:-1], out=after[1:])  # the byte before is part of a word
    ends = np.flatnonzero(space & after)
    keep = ~space
    keep[ends] = True
    norm = block.buf[keep]
    spaces = SPACE[norm]
    norm = LOWER[norm] if lower else norm.copy()
    norm[spaces] = 32
    end = np.flatnonzero(spaces)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    first = np.searchsorted(ends, block.off)  # words that end before a document's first byte
    doc = np.repeat(np.arange(len(block.off) - 1), np.diff(first))
    return Words(norm, start.astype(np.int64), end.astype(np.int64), doc, first)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ...: indices of many spans."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    stops = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (stops - length), length)


#: Bits of a position in sliding_min(); the hashes there are compared by the others.
_PLACE_BITS = 28


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost index of the minimum of each `width` consecutive hashes, by doubling.

    Hashes are compared by their upper bits.  The lower ones hold the position
    instead, so that one running minimum gives both.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = 1 << _PLACE_BITS
    if len(values) > most:  # a text of this length is cut into overlapping pieces
        step = most - width + 1
        return np.concatenate([at + sliding_min(values[at : at + most], width) for at in range(0, n, step)])
    mask = np.uint64(most - 1)
    best = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & mask).astype(np.int64)


#: The first k bytes of a lane, for k from 0 to 8.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros beyond the end) as numbers."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", raw, 0, (1,))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a[i] : a[i] + size[i]] equals data[b[i] : b[i] + size[i]], by their bytes."""
    lane = lanes(data)
    out = np.ones(len(a), bool)
    rows = np.flatnonzero(size > 0)
    a, b, left = a[rows], b[rows], size[rows]
    for _ in range(64):
        if not len(rows):
            return out
        bad = ((lane[a] ^ lane[b]) & _HEAD[np.minimum(left, 8)]) != 0
        out[rows[bad]] = False
        go = ~bad & (left > 8)
        rows, a, b, left = rows[go], a[go] + 8, b[go] + 8, left[go] - 8
    for r, x, y, n in zip(rows.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):  # few are that long
        out[r] = np.array_equal(data[x : x + n], data[y : y + n])
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, back): one span of each group of equal ones, and each span's group.

    Spans are equal if their bytes (and kinds) are; hashes only bring them together.
    """
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    lead = first[back]
    size = end - start
    rows = np.flatnonzero(lead != np.arange(len(lead)))
    other = lead[rows]
    same = size[rows] == size[other]
    if kind is not None:
        same &= kind[rows] == kind[other]
    same[same] = same_spans(data, start[rows[same]], start[other[same]], size[rows[same]])
    if same.all():
        return first, back
    # spans that differ and have one hash: their own groups
    groups: dict[tuple, int] = {}
    more = []
    for i in rows[~same].tolist():
        key = (data[start[i] : end[i]].tobytes(), None if kind is None else bool(kind[i]))
        if key not in groups:
            groups[key] = len(first) + len(more)
            more.append(i)
        back[i] = groups[key]
    return np.concatenate([first, np.array(more, first.dtype)]), back
