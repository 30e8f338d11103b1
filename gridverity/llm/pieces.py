"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and kinds, and the
normaliser's and trainer's settings.  From them a Tokenizer is rebuilt: the
normaliser (its marker for spaces and the one before a text), a Unigram model with
the scores or a BPE model whose merges are in the order of the scores, and byte
fallback for characters without a piece.

If no piece holds the marker behind another character, a marker after anything
else starts a stretch of text that is encoded by itself; other models encode whole
texts.  Each distinct stretch of
a block goes to the library once, in multithreaded batches; a worker remembers it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers

from .blocks import Block, blocks, equal_spans, prefix_hashes, ragged, span_hashes
from .common import table
from .run_tokens import IdPool

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Threads of the library in a worker; an executor has a worker for each of its cores.
THREADS = 2
#: Stretches that are encoded at once.
BATCH = 4_096
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    unigram: bool = True
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            raw = f.read()
        out = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece[1].decode())
                out.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                out.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.squeeze, out.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        return out

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, by its score, best first."""
        at = {p: i for i, p in enumerate(self.pieces)}
        found = []
        for piece, score, kind in zip(self.pieces, self.scores, self.kinds, strict=True):
            if kind in (NORMAL, USER):
                pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in at and piece[i:] in at]
                found += [(-score, at[a], at[b], a, b) for a, b in pairs]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, marked: bool = False) -> Tokenizer:
        """The Tokenizer of this model; marked: for stretches whose spaces are markers already."""
        has_bytes = BYTE in self.kinds
        if self.unigram:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unknown, byte_fallback=has_bytes)
        else:
            model = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=has_bytes)
        out = Tokenizer(model)
        if not marked:
            steps = []
            if self.charsmap:
                steps.append(normalizers.Precompiled(self.charsmap))
            if self.squeeze:
                steps += [normalizers.Strip(), normalizers.Replace(_spaces(), " ")]
            if self.dummy_prefix:
                steps.append(normalizers.Prepend(MARK))
            if self.escape:
                steps.append(normalizers.Replace(" ", MARK))
            out.normalizer = normalizers.Sequence(steps)
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return out

    def stretches_are_independent(self) -> bool:
        """Whether a marker behind another character always starts a piece, and nothing else changes the text."""
        inner = any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))
        runs = {s for p, s in zip(self.pieces, self.scores, strict=True) if len(p) > 1 and not p.strip(MARK)}
        last = len(runs) < 2 and all(s <= min(self.scores) for s in runs) and MARK in self.pieces
        return last and not (inner or self.charsmap or self.squeeze or not self.escape or USER in self.kinds or self.unigram)


def _spaces():
    from tokenizers import Regex

    return Regex(" {2,}")


class PieceEncoder(IdPool):
    """Encodes blocks of documents, and decodes ids."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = PieceModel.read(path)
        self.whole = self.model.tokenizer()
        self.independent = self.model.stretches_are_independent()
        self.stretch = self.model.tokenizer(marked=True)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw])
        self.first = np.cumsum(self.size) - self.size
        self.runs = {len(p): i for i, p in enumerate(self.model.pieces) if p and not p.strip(MARK)}
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block in order, and each document's first position among them."""
        if not self.independent:
            texts = [block.buf[a : b - 1].tobytes().decode("utf-8", "replace") for a, b in zip(block.off[:-1], block.off[1:], strict=True)]
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.trim()
        buf, off = block.buf, block.off
        end = np.zeros(len(buf), bool)  # separators between documents
        end[off[1:] - 1] = True
        space = (buf == 32) & ~end
        before = np.zeros(len(buf), bool)
        before[1:] = space[:-1]
        start = space & ~before
        opens = off[:-1][np.diff(off) > 1]
        start[opens] = True
        st = np.flatnonzero(start)
        stop = np.flatnonzero(start | end)
        en = stop[np.searchsorted(stop, st, "right")] if len(st) else st
        prefix, inverse = prefix_hashes(buf)
        head = np.zeros(len(buf), bool)
        head[opens] = True
        opening = head[st]  # a text's first stretch has the marker before it
        hashes = span_hashes(prefix, inverse, st, en)
        hashes[opening] ^= np.uint64(0x5851F42D4C957F2D)
        first, back = equal_spans(buf, st, en, hashes, opening)
        whole = buf.tobytes()
        listed = [(b"\n" if h else b"") + whole[a:b] for a, b, h in zip(st[first].tolist(), en[first].tolist(), opening[first].tolist(), strict=True)]
        known = self.known
        new = [i for i, key in enumerate(listed) if key not in known]
        if new:
            mark = MARK if self.model.dummy_prefix else ""
            texts = [(mark if opening[j] else "") + whole[st[j] : en[j]].decode("utf-8", "replace").replace(" ", MARK) for j in first[new].tolist()]
            for a in range(0, len(new), BATCH):  # the library's results are large
                for i, ids in zip(new[a : a + BATCH], self._stretches(texts[a : a + BATCH]), strict=True):
                    self.learn(listed[i], ids)
        at = np.fromiter((known[key] for key in listed), np.int64, len(listed))
        self.count(at)
        run = at[back]
        start_of, length = self.start[run], self.length[run]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.pool[ragged(start_of, length)], total[np.searchsorted(st, off)]

    def _stretches(self, texts: list[str]) -> list[list[int]]:
        """Ids of stretches.  Markers in a row all have one score, so they join from the left, and last of all."""
        rest = [t.lstrip(MARK) for t in texts]
        marks = [len(t) - len(r) for t, r in zip(texts, rest, strict=True)]
        heads = [MARK + r if m and r else r for m, r in zip(marks, rest, strict=True)]
        out = []
        for m, e in zip(marks, self.stretch.encode_batch_fast(heads, add_special_tokens=False), strict=True):
            ids = e.ids
            if m and ids:
                alone = ids[0] == self.runs[1]
                ids, m = (ids[1:], m) if alone else (ids, m - 1)
            out.append([*self._joined(m), *ids])
        return out

    def _joined(self, m: int) -> list[int]:
        """Ids of m markers: the leftmost two neighbours that make a piece join, again and again."""
        done: list[int] = []
        while m > 0:
            now, m = 1, m - 1
            while True:
                if done and done[-1] + now in self.runs:
                    now += done.pop()
                elif m and now + 1 in self.runs:
                    now, m = now + 1, m - 1
                else:
                    break
            done.append(now)
        return [self.runs[n] for n in done]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of documents; invalid bytes become replacement characters."""
        data = self.bytes[ragged(self.first[ids], self.size[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(self.size[ids])])[off].tolist()
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and model."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parity(path: str, texts: list[str]) -> list[str]:
    """The texts whose ids or decoded text differ from those of the sentencepiece library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = PieceEncoder(path)
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    ids, first = enc.encode(Block(rows, np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), off))
    back = enc.decode(ids, first)
    out = []
    for i, t in enumerate(texts):
        want = theirs.encode(t)
        if ids[first[i] : first[i + 1]].tolist() != want or back[i] != theirs.decode(want):
            out.append(t)
    return out


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and ids (array of int) of each document.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are
    encoded each; an empty table gives an empty result; other columns are not read.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for block in blocks(batches):
            ids, off = enc.encode(block)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.rows.columns, lists], names=["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, column: str = "decoded") -> DataFrame:
    """doc_id, text, n_ids, ids_crc32, n_byte_ids and the decoded text; null ids decode to an empty text.

    ids_crc32 is of the ids as unsigned little-endian 32-bit numbers; n_byte_ids
    counts ids of single bytes, which stand for characters without a piece.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1_000):
                part = batch.slice(s, 1_000)
                lists = part.column("ids")
                size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                off = np.concatenate([[0], np.cumsum(size)])
                ids = lists.flatten().to_numpy()
                raw = ids.astype("<u4").tobytes()
                bytes_before = np.concatenate([[0], np.cumsum(enc.is_byte[ids])])[off]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.diff(bytes_before)), pa.array(enc.decode(ids, off), pa.string())],
                    names=["doc_id", "text", "n_ids", "ids_crc32", "n_byte_ids", column],
                )

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, f"doc_id long, text string, n_ids long, ids_crc32 long, n_byte_ids long, `{column}` string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_byte_ids, decoded_sha256, and whether decoding gave the text again."""
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_ids", "ids_crc32", "n_byte_ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
