"""XXH64 of many spans of one buffer at once."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 (uint64) of each buf[start[i] : end[i]].

    Spans advance together, lane by lane; those that are done drop out.
    """
    with np.errstate(over="ignore"):
        data = np.concatenate([buf, np.zeros(32, np.uint8)])
        lanes = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the 8 bytes from each position on
        words = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
        at, size, s = start.astype(np.int64), (end - start).astype(np.int64), np.uint64(seed)
        h = np.full(len(at), s + _P5, np.uint64)
        left = size.copy()
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            rows, pos, rest = np.arange(len(long)), at[long].copy(), left[long].copy()
            while len(rows):
                p = pos[rows]
                for k in range(4):
                    acc[k][rows] = _round(acc[k][rows], lanes[p + 8 * k])
                pos[rows] += 32
                rest[rows] -= 32
                rows = rows[rest[rows] >= 32]
            out = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                out = (out ^ _round(np.zeros_like(out), acc[k])) * _P1 + _P4
            h[long], at[long], left[long] = out, pos, rest
        h += size.astype(np.uint64)
        for lane in range(3):  # fewer than 32 bytes are left
            rows = np.flatnonzero(left >= 8)
            if not len(rows):
                break
            whole = len(rows) == len(h)
            x = h if whole else h[rows]
            x = x ^ _round(np.zeros_like(x), lanes[at if whole else at[rows]])
            x = _rotl(x, 27) * _P1 + _P4
            if whole:
                h, at, left = x, at + 8, left - 8
            else:
                h[rows], at[rows], left[rows] = x, at[rows] + 8, left[rows] - 8
        rows = np.flatnonzero(left >= 4)
        if len(rows):
            h[rows] = _rotl(h[rows] ^ (words[at[rows]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[rows] += 4
            left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left > 0)
            if not len(rows):
                break
            h[rows] = _rotl(h[rows] ^ (data[at[rows]].astype(np.uint64) * _P5), 11) * _P1
            at[rows] += 1
            left[rows] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
