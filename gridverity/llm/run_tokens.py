"""Batch encoding with a word-level BPE of the tokenizers library.

Such a vocabulary splits text to letter runs, single digits and punctuation runs
before its merges, and drops white space, so a document's ids are those of its
runs in order.  Runs repeat a lot: each distinct one is encoded once by the
library's BPE model and looked up afterwards.  Runs are found by array passes
over whole blocks.  A white-space-delimited stretch with anything unusual
(other scripts, combining marks, apostrophes, controls, "<") is encoded as it is
by the complete tokenizer, which white space cannot influence.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from .blocks import LOWER, SPACE, equal_spans, prefix_hashes, ragged, span_hashes

# classes of bytes
_WS, _LETTER, _DIGIT, _PUNCT, _LEAD, _ODD = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[SPACE] = _WS
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = _PUNCT
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[39, 60]] = _ODD
_CLASS[0xC3] = _LEAD
#: Second bytes of the letters U+00C0 to U+00FF (all but the signs of times and division).
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: Strings that a worker remembers, at most.
_MAX_RUNS = 200_000


def _byte_names() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by code point of the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(rest)}


class IdPool:
    """Ids of strings that were met before, by their bytes.  When it is full, strings met in one block only go."""

    def __init__(self):
        self._start_anew()

    def _start_anew(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)

    def trim(self) -> None:
        """Call before a block, not while indices of strings are in use."""
        if len(self.known) <= _MAX_RUNS:
            return
        n = len(self.known)
        floor = max(2, int(np.partition(self.met[:n], n - _MAX_RUNS // 2)[n - _MAX_RUNS // 2]))
        old, start, length, pool, met = self.known, self.start, self.length, self.pool, self.met
        self._start_anew()
        for key, i in old.items():
            if met[i] >= floor:
                j = self.learn(key, pool[start[i] : start[i] + length[i]])
                self.met[j] = 1

    def count(self, at: np.ndarray) -> None:
        """Note that a block has these (distinct) strings."""
        self.met[at] += 1

    def learn(self, key: bytes, ids: list[int] | np.ndarray) -> int:
        n = len(self.known)
        if n >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.start[n], self.length[n] = self.used, len(ids)
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known[key] = n
        return n


class RunEncoder(IdPool):
    """Ids of documents by runs; knows each run that it has met."""

    def __init__(self, path: str):
        super().__init__()
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError("a vocabulary of another kind: runs would not be independent")
        self.names = _byte_names()

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block in order, and each document's first position among them.

        end_id, if given, follows each document.
        """
        self.trim()
        cls = _CLASS[buf]
        low = LOWER[buf]
        lead = np.flatnonzero(cls == _LEAD)
        if len(lead):
            second = buf[lead + 1]  # a separator follows the last byte of any text
            good = _SECOND[second]
            cls[lead] = np.where(good, _LETTER, _ODD)
            good_at = lead[good] + 1
            cls[good_at] = _LETTER
            upper = good_at[buf[good_at] < 0x9F]
            low[upper] += 0x20
        solid = cls != _WS
        inside = np.zeros(len(cls), bool)  # same run as the byte before
        inside[1:] = (cls[1:] == cls[:-1]) & (cls[1:] != _DIGIT)
        starts = solid & ~inside
        odd = np.flatnonzero(cls == _ODD)
        odd_from = odd_to = np.zeros(0, np.int64)
        if len(odd):
            gaps = np.flatnonzero(~solid)
            k = np.unique(np.searchsorted(gaps, odd))  # stretch k ends at gaps[k]
            odd_to = gaps[k]
            odd_from = np.where(k > 0, gaps[np.maximum(k - 1, 0)] + 1, 0)
            for a, b in zip(odd_from, odd_to, strict=True):
                starts[a:b] = False
            starts[odd_from] = True
        st = np.flatnonzero(starts)
        after = np.flatnonzero(starts | ~solid)  # a run ends where the next starts, or at white space
        en = after[np.minimum(np.searchsorted(after, st, "right"), len(after) - 1)] if len(st) else st
        is_odd = np.isin(st, odd_from, assume_unique=True) if len(odd_from) else np.zeros(len(st), bool)
        for a, b in zip(odd_from, odd_to, strict=True):  # these are known by their bytes as they are
            low[a:b] = buf[a:b]
        prefix, inverse = prefix_hashes(low)
        first, back = equal_spans(low, st, en, span_hashes(prefix, inverse, st, en), is_odd)
        known, at = self.known, np.empty(len(first), np.int64)
        whole = low.tobytes()
        for i, (a, b, odd_one) in enumerate(zip(st[first].tolist(), en[first].tolist(), is_odd[first].tolist(), strict=True)):
            run = whole[a:b]
            key = b"\x01" + run if odd_one else run  # no run starts with a control
            n = known.get(key)
            if n is None:
                if odd_one:
                    ids = self.full.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
                else:
                    ids = [t.id for t in self.full.model.tokenize(run.decode("latin-1").translate(self.names))]
                n = self.learn(key, ids)
            at[i] = n
        self.count(at)
        run = at[back]
        start, length = self.start[run], self.length[run]
        cuts = np.searchsorted(st, off)
        if end_id is not None:
            end_at = known.get(b"")
            if end_at is None:
                end_at = self.learn(b"", [end_id])
            start = np.insert(start, cuts[1:], self.start[end_at])
            length = np.insert(length, cuts[1:], 1)
            cuts = cuts + np.arange(len(cuts))
        total = np.concatenate([[0], np.cumsum(length)])
        return self.pool[ragged(start, length)], total[cuts]
