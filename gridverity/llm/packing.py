"""Packing of token ids to sequences of fixed length, online and in bounded space.

Each input partition keeps a fixed number of open windows.  A piece goes to the
window that it leaves least room in (best fit).  When none has room, the fullest
window is filled up with the head of the piece and emitted; the tail opens a
window in its place.  At a partition's end its open windows are poured together,
which leaves less than one sequence; these rests are laid end to end over all
partitions and cut at each multiple of the length.  One sequence at most has
padding, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import blocks
from .common import cut, table
from .run_tokens import RunEncoder

SEQUENCE = 2048
OPEN_WINDOWS = 16
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

_PLACED = "part int, seq long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, ids binary"
_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens); `out` gets (sequence, offset, piece), sequence None for the rest."""

    def __init__(self, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS):
        self.size, self.most = size, open_windows
        self.windows: list[tuple[int, list]] = []  # tokens so far, pieces
        self.n, self.out = 0, []

    def _emit(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.out.append((self.n, at, p))
            at += len(p[2])
        self.n += 1

    @staticmethod
    def _split(piece: tuple, k: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:k], total), (doc, start + k, ids[k:], total)

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for s in range(0, whole, self.size):
            self._emit([(doc, s, ids[s : s + self.size], len(ids))])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:], len(ids)))

    def _place(self, piece: tuple) -> None:
        need = len(piece[2])
        fits = [i for i, (used, _) in enumerate(self.windows) if self.size - used >= need]
        if fits:
            i = max(fits, key=lambda i: self.windows[i][0])
            used, pieces = self.windows[i]
            pieces.append(piece)
            if used + need == self.size:
                self._emit(pieces)
                del self.windows[i]
            else:
                self.windows[i] = (used + need, pieces)
        elif len(self.windows) < self.most:
            self.windows.append((need, [piece]))
        else:
            i = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
            used, pieces = self.windows[i]
            head, tail = self._split(piece, self.size - used)
            self._emit([*pieces, head])
            self.windows[i] = (len(tail[2]), [tail])

    def close(self) -> None:
        """Pour the open windows together; what is left is less than one sequence."""
        row: list = []
        used = 0
        for _, pieces in sorted(self.windows, key=lambda w: -w[0]):
            for piece in pieces:
                while used + len(piece[2]) >= self.size:
                    head, piece = self._split(piece, self.size - used)
                    self._emit([*row, head] if len(head[2]) else row)
                    row, used = [], 0
                if len(piece[2]):
                    row.append(piece)
                    used += len(piece[2])
        at = 0
        for p in row:
            self.out.append((None, at, p))
            at += len(p[2])
        self.windows = []


def _rows(part: int, placed: list) -> pa.RecordBatch:
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    cols: list[list] = [[] for _ in schema]
    for seq, at, (doc, start, ids, total) in placed:
        raw = ids.astype("<u4", copy=False).tobytes()
        row = (part, seq, doc, start, len(ids), zlib.crc32(raw), total, at, raw if seq is None else None)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents with their places in sequences of `size` ids.

    A document's ids are those of its text, then end_id; a null text is empty and
    so is just end_id.  Repeated rows are packed each.  A null doc_id stays null.
    An empty table gives no piece.  Columns other than doc_id and text are not read.
    Sequences are numbered from 0 without gaps; only the last can be short, and
    is the only one that is padded.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, packer = encoder(path), Packer(size, open_windows)
        for block in blocks(batches):
            ids, off = enc.encode(block.buf, block.off, end_id)
            for doc, a, b in zip(block.rows.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                packer.add(doc, ids[a:b])
            done, packer.out = packer.out, []
            if done:
                yield _rows(part, done)
            # what stays open must not hold the block's ids
            packer.windows = [(used, [(d, s, i.copy(), t) for d, s, i, t in pieces]) for used, pieces in packer.windows]
        packer.close()
        if packer.out:
            yield _rows(part, packer.out)

    placed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, _PLACED))

    # one row for each input partition: sequences and left-over ids before it
    parts = placed.groupBy("part").agg(
        F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("seq").isNull(), F.col("length"))), F.lit(0)).alias("rest"),
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("rest_before"),
        F.sum("n").over(W.partitionBy()).alias("n_all"),
    )
    rows = placed.join(parts, "part")
    whole = rows.where(F.col("seq").isNotNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("n_before") + F.col("seq")).alias("sequence_id"), "offset")
    rest = rows.where(F.col("seq").isNull()).withColumn("at", F.col("rest_before") + F.col("offset"))
    # a piece lies in one sequence or, where a boundary cuts it, in several
    rest = rest.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))))
    lo = F.greatest(F.col("at"), F.col("k") * size) - F.col("at")
    hi = F.least(F.col("at") + F.col("length"), (F.col("k") + 1) * size) - F.col("at")
    rest = rest.withColumn("lo", lo).withColumn("hi", hi)
    rest = rest.select(
        "doc_id",
        (F.col("start") + F.col("lo")).alias("start"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.crc32(F.substring(F.col("ids"), (F.col("lo") * 4 + 1).cast("int"), ((F.col("hi") - F.col("lo")) * 4).cast("int"))).alias("ids_crc32"),
        "doc_tokens",
        (F.col("n_all") + F.col("k")).alias("sequence_id"),
        (F.col("at") + F.col("lo") - F.col("k") * size).alias("offset"),
    )
    return whole.unionByName(rest)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
