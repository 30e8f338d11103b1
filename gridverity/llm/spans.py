"""Super-k-mers: exact search for repeated windows, shared by the two substring operators.

A window's minimiser is the least (hashed) gram inside it.  Equal windows have
equal minimisers, so consecutive windows of a document that share theirs travel as
one packed string to the minimiser's bucket, and all equal windows meet there.
A block drops its own repeats first: of strings that are equal within a block only
the one of the least document travels, which bounds what a passage that many
documents share sends to one bucket.

A payload is one compressed record per block and bucket: how many strings each
part of the bucket has, then lengths, owners (index to a list of documents),
positions, the minimiser's unit in the string, the documents (key, row hash) and
the strings end to end.  A part is the share of a bucket that is worked on at once.

A minimiser that many documents have, in different surroundings, would fill one
part however many there are.  Windows of such hot minimisers travel one by one
instead, to the bucket of the whole window's hash, where only equal ones meet.
Which are hot is told from a sample; it decides where windows meet, not which.

The texts travel compressed as well, to where the removed runs of their document
go, and are rewritten there.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, Block, blocks, equal_spans, mixed, prefix_hashes, ragged, release, same_spans, sliding_min, span_hashes
from .common import doc_key, partitions, whole_text

#: Buckets for each shuffle partition, and parts of a bucket; they are worked on one after another.
BUCKETS_EACH = 4
PARTS = 8
#: Level of compression, and bytes of text that are compressed together at most.
LEVEL = 3
TEXT_BLOCK = 4 << 20
#: Bytes of strings that a task gathers before it sends them.
OUTBOX_BYTES = 16 << 20
#: A minimiser is hot if this share of the sampled documents has it, and its strings would fill so many mean parts.
HOT_DOCS, HOT_PARTS = 0.02, 32
#: Sampled documents and bytes, and bytes of the compression's dictionary made from them, at most.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 1 << 20, 1 << 16


@dataclass
class Strings:
    """Packed strings: bytes data[off[i] : off[i + 1]] of the document (key[i], row[i]), from unit pos[i] on.

    mini[i] is the unit of string i where its minimiser starts.
    """

    data: np.ndarray
    off: np.ndarray
    key: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    mini: np.ndarray


def super_kmers(gram: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: first window, number of windows, the minimiser's unit.

    gram[i] is the hash of units i .. i + k - 1; document d has units first[d] to first[d + 1].
    """
    n = np.diff(first)
    has = np.maximum(n - window + 1, 0)  # windows
    total = int(has.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(gram, window - k + 1)
    at = ragged(first[:-1], has)
    chosen = least[at]
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    runs = np.flatnonzero(new)
    return at[runs], np.diff(np.append(runs, total)), chosen[runs]


def sampled(docs: DataFrame) -> list[bytes]:
    """Some texts, SAMPLE_DOCS rows and SAMPLE_BYTES bytes at most.  Results don't depend on them, sizes do."""
    rows = docs.where(F.octet_length("text").between(8, SAMPLE_BYTES // 16)).select("text").limit(SAMPLE_DOCS).collect()
    out, total = [], 0
    for r in rows:
        raw = r.text.encode()
        if total + len(raw) > SAMPLE_BYTES:
            break
        out.append(raw)
        total += len(raw)
    return out


def hot_minimisers(texts: list[bytes], window: int, k: int, units: Callable, parts: int) -> np.ndarray:
    """Grams (hashes) that are minimisers in many of the texts, ascending; a part is one of `parts` shares of all strings."""
    if not texts:
        return np.zeros(0, np.uint64)
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    data, gram, first, span = units(Block(rows, np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), off))
    at, _, chosen = super_kmers(gram, first, window, k)
    doc = np.searchsorted(first, at, "right") - 1
    each, back, strings = np.unique(gram[chosen], return_inverse=True, return_counts=True)
    has = np.unique(back * len(texts) + doc) // len(texts)
    docs = np.bincount(has, minlength=len(each))
    return each[(docs >= max(2, HOT_DOCS * len(texts))) & (strings * parts >= HOT_PARTS * len(at))]


class Codec:
    """Compression with a dictionary made from some texts: small payloads shrink about as well as large ones."""

    def __init__(self, dictionary: bytes):
        self.dictionary = dictionary

    @classmethod
    def of(cls, texts: list[bytes]) -> Codec:
        samples = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
        try:
            return cls(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
        except zstandard.ZstdError:  # too few texts
            return cls(b"")

    def _dict(self):
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def compress(self, raw: bytes) -> bytes:
        if not hasattr(self, "_c"):
            self._c = zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dict())
        return self._c.compress(raw)

    def decompress(self, raw: bytes) -> bytes:
        if not hasattr(self, "_d"):
            self._d = zstandard.ZstdDecompressor(dict_data=self._dict())
        return self._d.decompress(raw)

    def __getstate__(self) -> dict:
        return {"dictionary": self.dictionary}


def _planes(values: np.ndarray, width: int) -> bytes:
    """Integers of `width` bytes, by byte planes: the high ones are mostly zero and cost little."""
    return np.ascontiguousarray(values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64)


def pack(codec: Codec, doc_key: np.ndarray, doc_row: np.ndarray, owner: np.ndarray, pos: np.ndarray, mini: np.ndarray, part: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """A compressed payload; the strings are in the order of their parts, then of documents and positions."""
    docs, local = np.unique(owner, return_inverse=True)
    body = [
        struct.pack("<qq", len(owner), len(docs)),
        np.bincount(part, minlength=PARTS).astype("<i4").tobytes(),
        _planes(size, 4),
        _planes(np.diff(local, prepend=0), 4),
        _planes(np.diff(pos, prepend=0), 8),
        _planes(mini, 4),
        _planes(np.diff(doc_key[docs], prepend=0), 8),
        _planes(doc_row[docs], 8),
        data[ragged(start, size)].tobytes(),
    ]
    return codec.compress(b"".join(body))


class Payload:
    """A payload, decompressed; part(p) gives its strings of one part."""

    def __init__(self, codec: Codec, packed: bytes):
        raw = codec.decompress(packed)
        n, m = struct.unpack_from("<qq", raw)
        counts = np.frombuffer(raw, "<i4", PARTS, 16)
        at = 16 + 4 * PARTS
        self.size = _from_planes(raw, at, n, 4)
        self.local = np.cumsum(_from_planes(raw, at + 4 * n, n, 4))
        self.pos = np.cumsum(_from_planes(raw, at + 8 * n, n, 8))
        self.mini = _from_planes(raw, at + 16 * n, n, 4)
        self.key = np.cumsum(_from_planes(raw, at + 20 * n, m, 8))
        self.row = _from_planes(raw, at + 20 * n + 8 * m, m, 8)
        self.data = np.frombuffer(raw, np.uint8, -1, at + 20 * n + 16 * m)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.byte = np.concatenate([[0], np.cumsum(self.size)])[self.first]

    def part(self, p: int) -> tuple:
        a, b = self.first[p], self.first[p + 1]
        local = self.local[a:b]
        return self.data[self.byte[p] : self.byte[p + 1]], self.size[a:b], self.key[local], self.row[local], self.pos[a:b], self.mini[a:b]


def gathered(payloads: list[Payload], p: int) -> Strings:
    data, size, key, row, pos, mini = (np.concatenate(x) for x in zip(*(x.part(p) for x in payloads), strict=True))
    return Strings(data, np.concatenate([[0], np.cumsum(size)]), key, row, pos, mini)


def string_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    prefix, inverse = prefix_hashes(data)
    return span_hashes(prefix, inverse, off[:-1], off[1:])


def removed_rows(key: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Removed units [start, stop) of documents; touching runs are joined."""
    order = np.lexsort((start, row, key))
    key, row, start, stop = key[order], row[order], start[order], stop[order]
    if len(key):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
        runs = np.flatnonzero(new)
        key, row, start, stop = key[runs], row[runs], start[runs], np.maximum.reduceat(stop, runs)
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(row.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["k", "row", "start", "stop"])


_SENT = "bucket int, payload binary, k long, row long, start long, stop long"
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("k", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def block_strings(block: Block, outbox: Outbox, window: int, k: int, units: Callable, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Puts a block's strings into the outbox, and gives what its own repeats remove at once.

    units(block) -> (data, gram hashes, first unit of each document, byte range of units i .. j - 1).
    """
    data, gram, first, span = units(block)
    at, count, chosen = super_kmers(gram, first, window, k)
    if not len(at):
        return
    key, row = block.column("k").astype(np.int64), block.column("row").astype(np.int64)
    start, stop = span(at, at + count + window - 1)
    doc = np.searchsorted(first, at, "right") - 1
    prefix, inverse = prefix_hashes(data)
    h = span_hashes(prefix, inverse, start, stop)
    order = np.lexsort((key[doc], h))
    same = np.zeros(len(order), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[head]  # of the least document, for each in order
    # a repeat in a later document goes for good; its bytes are compared, not only hashes
    later = np.flatnonzero(same & (key[doc[order]] > key[doc[lead]]))
    a, b = order[later], lead[later]
    sure = (stop - start)[a] == (stop - start)[b]
    sure[sure] = same_spans(data, start[a[sure]], start[b[sure]], (stop - start)[a[sure]])
    gone = a[sure]
    keep = np.ones(len(at), bool)
    keep[gone] = False
    pos = at - first[doc]
    if len(gone):
        out = removed_rows(key[doc[gone]], row[doc[gone]], pos[gone], (pos + count + window - 1)[gone])
        yield _sent(out.num_rows, removed=out)
    minimiser = gram[chosen]
    if len(hot):
        is_hot = keep & np.isin(minimiser, hot)
        if is_hot.any():
            keep &= ~is_hot
            x = np.flatnonzero(is_hot)
            one, d, mini = ragged(at[x], count[x]), np.repeat(doc[x], count[x]), np.repeat(chosen[x], count[x])
            lo, hi = span(one, one + window)
            h = span_hashes(prefix, inverse, lo, hi)
            sample, group = equal_spans(data, lo, hi, h)
            least = np.full(len(sample), np.iinfo(np.int64).max)
            np.minimum.at(least, group, key[d])
            later = key[d] > least[group]
            if later.any():
                out = removed_rows(key[d[later]], row[d[later]], (one - first[d])[later], (one - first[d])[later] + window)
                yield _sent(out.num_rows, removed=out)
            y = np.flatnonzero(~later)
            size = (hi - lo)[y]
            outbox.add(h[y], d[y], key, row, (one - first[d])[y], (mini - one)[y], data[ragged(lo[y], size)], size)
    x = np.flatnonzero(keep)
    size = (stop - start)[x]
    outbox.add(minimiser[x], doc[x], key, row, pos[x], (chosen - at)[x], data[ragged(start[x], size)], size)


class Outbox:
    """Strings of several blocks of a task, so that payloads don't shrink as the number of buckets grows."""

    def __init__(self, codec: Codec, buckets: int):
        self.codec, self.buckets = codec, buckets
        self.held, self.docs, self.bytes = [], 0, 0

    def add(self, minimiser, doc, key, row, pos, mini, data, size) -> None:
        if len(size):
            self.held.append((minimiser, doc + self.docs, pos, mini, data, size, key, row))
            self.docs += len(key)
            self.bytes += len(data)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        minimiser, doc, pos, mini, data, size, key, row = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.docs, self.bytes = [], 0, 0
        start = np.cumsum(size) - size
        bucket = (minimiser % np.uint64(self.buckets)).astype(np.int64)
        part = (minimiser // np.uint64(self.buckets) % np.uint64(PARTS)).astype(np.int64)
        order = np.argsort(bucket * PARTS + part, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(cuts[1:], len(order))
        payloads = []
        for a, b in zip(cuts, ends, strict=True):
            x = order[a:b]
            payloads.append(pack(self.codec, key, row, doc[x], pos[x], mini[x], part[x], data, start[x], size[x]))
        yield _sent(len(cuts), bucket[order[cuts]].astype(np.int32), payloads)


def _sent(n: int, bucket: np.ndarray | None = None, payloads: list[bytes] | None = None, removed: pa.RecordBatch | None = None) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(n, kind)
    if removed is None:
        cols = [pa.array(bucket, pa.int32()), pa.array(payloads, pa.binary()), *[none(pa.int64())] * 4]
    else:
        spread = (np.asarray(removed.column(0)) % 65536 - 65536).astype(np.int32)  # any bucket will do
        cols = [pa.array(spread), none(pa.binary()), *removed.columns]
    return pa.RecordBatch.from_arrays(cols, schema=_SENT_SCHEMA)


def removed_spans(docs: DataFrame, texts: list[bytes], codec: Codec, window: int, k: int, units: Callable, repeats: Callable, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(k, row, start, stop): units covered by a window that also starts in a document with a smaller key.

    docs has k, row and text; texts are sampled() ones.  repeats(Strings) -> (string index, first unit, last unit + 1) of windows
    in a bucket that a smaller document has too, units counted from the string's first.
    """
    n = partitions(docs.sparkSession)
    buckets = n * BUCKETS_EACH
    hot = hot_minimisers(texts, window, k, units, buckets * PARTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = Outbox(codec, buckets)
        for block in blocks(batches, limit=block_bytes):
            yield from block_strings(block, outbox, window, k, units, hot)
            if outbox.bytes >= OUTBOX_BYTES:
                yield from outbox.flush()
        yield from outbox.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for p in range(PARTS):
                s = gathered(held, p)
                if len(s.key):
                    which, lo, hi = repeats(s)
                    if len(which):
                        yield removed_rows(s.key[which], s.row[which], s.pos[which] + lo, s.pos[which] + hi)

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            local = np.flatnonzero(bucket < 0)
            if len(local):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(local)) for c in batch.columns[2:]], names=["k", "row", "start", "stop"])
            payload = batch.column("payload")
            for i in np.flatnonzero(bucket >= 0).tolist():
                if bucket[i] != now:
                    if held:
                        yield from found()
                    now, held = bucket[i], []
                held.append(Payload(codec, payload[i].as_py()))
        if held:
            yield from found()
        held.clear()
        release()

    sent = docs.select("k", "row", "text").mapInArrow(send, _SENT)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "k long, row long, start long, stop long")


def keyed(docs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """k (doc_id, the stand-in for null), row, text, and other columns as x0, x1, ...

    row tells rows of one doc_id apart: a hash of the text, or 0 if no doc_id repeats (it travels with each string).
    """
    repeated = docs.select(doc_key().alias("k")).groupBy("k").count().where("count > 1").limit(1).count()
    row = F.xxhash64(whole_text()) if repeated else F.lit(0).cast("long")
    extra = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(others)]
    return docs.select(doc_key().alias("k"), row.alias("row"), whole_text().alias("text"), *extra)


def rewritten(docs: DataFrame, codec: Codec, spans: DataFrame, rewrite: Callable, schema: str) -> DataFrame:
    """rewrite(block, removed) of all keyed() documents, where removed[d] has the runs (start, stop) of document d, or None.

    Runs and compressed texts of a document, with its other columns, meet by its key and row hash.
    """
    n = partitions(docs.sparkSession)
    names = ["part", "text", "k", "row", "start", "stop"]
    kinds = "part int, text binary, k long, row long, start long, stop long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=TEXT_BLOCK):
            key, row = (block.column(c).astype(np.int64) for c in ("k", "row"))
            to = (mixed(key.view(np.uint64) ^ mixed(row.view(np.uint64))) % np.uint64(n)).astype(np.int32)
            parts, texts = [], []
            for p in np.unique(to):
                d = np.flatnonzero(to == p)
                size = np.diff(block.off)[d]
                rows = pa.Table.from_batches([block.rows]).drop_columns(["text"]).take(pa.array(d)).combine_chunks().to_batches()[0]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                head = sink.getvalue().to_pybytes()
                body = struct.pack("<q", len(head)) + head + size.astype("<i8").tobytes() + block.buf[ragged(block.off[d], size)].tobytes()
                parts.append(p)
                texts.append(codec.compress(body))
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(texts, pa.binary()), none, none, none, none], names=names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = (batch.column(c).to_numpy().astype(np.int64) for c in ("k", "row"))
            to = (mixed(key.view(np.uint64) ^ mixed(row.view(np.uint64))) % np.uint64(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.nulls(len(to), pa.binary()), *batch.columns], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, held = None, None, []
        for batch in batches:
            part = batch.column("part").to_numpy()
            is_text = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    now, runs, held = part[a], None, []
                if not is_text[a]:
                    held.append(tuple(batch.column(c).slice(a, b - a).to_numpy() for c in names[2:]))
                    continue
                runs = runs or Runs(held)
                for x in batch.column("text").slice(a, b - a):
                    raw = codec.decompress(x.as_py())
                    at = 8 + struct.unpack_from("<q", raw)[0]
                    rows = pa.ipc.open_stream(raw[8:at]).read_next_batch()
                    size = np.frombuffer(raw, "<i8", rows.num_rows, at)
                    block = Block(rows, np.frombuffer(raw, np.uint8, -1, at + 8 * rows.num_rows), np.concatenate([[0], np.cumsum(size)]))
                    keys = zip(rows.column("k").to_pylist(), rows.column("row").to_pylist(), strict=True)
                    yield rewrite(block, [runs.of(k, r) for k, r in keys])
        release()

    both = docs.mapInArrow(send, kinds).unionByName(spans.select("k", "row", "start", "stop").mapInArrow(route, kinds))
    # runs (no text) come before the texts
    return both.repartition(n, "part").sortWithinPartitions("part", F.col("text").isNotNull()).mapInArrow(meet, schema)


class Runs:
    """Removed runs by document."""

    def __init__(self, parts: list[tuple]):
        none = np.zeros(0, np.int64)
        key, row, start, stop = (np.concatenate(x) for x in zip((none,) * 4, *parts, strict=True))
        order = np.lexsort((row, key))
        self.start, self.stop = start[order], stop[order]
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(key))[: len(first)]
        self.index = {kr: ab for kr, ab in zip(zip(key[first].tolist(), row[first].tolist(), strict=True), zip(first.tolist(), ends.tolist(), strict=True), strict=True)}

    def of(self, key: int, row: int) -> tuple[np.ndarray, np.ndarray] | None:
        ab = self.index.get((key, row))
        return ab and (self.start[ab[0] : ab[1]], self.stop[ab[0] : ab[1]])


def covered(runs: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, int]:
    """Which of n units the runs cover, and the number of maximal runs."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, runs[0], 1)
    np.add.at(delta, runs[1], -1)
    mask = np.cumsum(delta[:-1]) > 0
    return mask, int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(mask[:1].any()))
