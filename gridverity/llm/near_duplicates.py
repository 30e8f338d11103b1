"""SimHash near-duplicates at a similarity: five-word shingles, Jaccard similarity 0.8 or more.

Candidates: fingerprints within three bits meet in buckets of equal bits and slabs of
their distance to a pivot, as in simhash.  At 0.8 fingerprints differ in some 10 of
64 bits and often in 17, where buckets and slabs are not selective, so documents
also meet in bands of minimum hashes; a pair of similarity 0.8 shares none of 20
bands of 4 with a probability of 3 in 100,000.

Pivots: each document has a SimHash fingerprint and a table of its Hamming distances
to the pivots.  A pair that meets in a band, in whichever step, is discarded if a
coordinate differs by more than RADIUS, or the fingerprints do; at 0.8 these are
five standard deviations away.  Texts of fewer than SURE_SHINGLES shingles, whose
bits depend on few hashes, are not discarded so.

Links: the survivors are verified on the whole shingle sets.  Members of a band are
first held against the least of them, so a large group of copies costs one
comparison a member.  Where these links leave a band's members apart, those outside
the band's largest component visit blocks of all members.  Blocks first compare
fingerprints; only members that pivots leave a partner in their block send their
shingle sets there, and the block compares them in its task: it gives links that
connect, and no table of pairs is made, however large the band is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, mixed, ragged, release, words
from .common import cut, doc_key, is_small, look_up, partitions, whole_text
from .components import components
from .simhash import bit_counts, distance_table, fingerprint_links, keep_first, pivots
from .xxh import xxh64

SHINGLE_WORDS = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS = 20
BAND_ROWS = 4
SEED = 42
#: Bits that fingerprints of a link differ in, at most; shingles of a text that this is asked of, at least.
RADIUS = 26
SURE_SHINGLES = 20
#: Members of a band that are in one block, and that visit it at once, about; their shingles, about.
GROUP_ROWS = 256
GROUP_SHINGLES = 1 << 18
#: Pairs of fingerprints that are compared at once.
PAIRS_AT_ONCE = 1 << 18


def _keys(n: int) -> np.ndarray:
    """n fixed numbers from a counter and a mixing function."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64))


def shingle_sets(block: Block, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all documents, and where each document's start (one more than documents).

    A text of fewer than `width` words has one shingle, its words; one of none has none.
    """
    w = words(block, lower=True)
    n = np.diff(w.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = ragged(w.first[:-1], count)
    last = start + np.repeat(np.minimum(n, width) - 1, count)
    doc = np.repeat(np.arange(len(n)), count)
    h = xxh64(w.norm, w.start[start], w.end[last], SEED) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def band_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each document; those without shingles are alike."""
    n = len(first) - 1
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((n, BANDS), np.uint64)
    if not len(some):
        return out
    salts, odd = _keys(2 * BANDS * BAND_ROWS).reshape(2, BANDS, BAND_ROWS)
    odd = odd | np.uint64(1)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            band = np.zeros(len(some), np.uint64)
            for r in range(BAND_ROWS):
                band = mixed(band + np.minimum.reduceat((h ^ salts[b, r]) * odd[b, r], first[some]))
            out[some, b] = band
    return out


def set_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each document's shingle set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h), dtype=np.uint64)])
        return mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def set_fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint64 SimHash of each document's shingle set; zero for an empty one."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(some):
        ones = bit_counts(h, np.concatenate([[0], np.cumsum(size[some])])) * 2 > size[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def far_apart(fa: np.ndarray, fb: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of fingerprints that differ in more than `radius` bits: most by a pivot's coordinate, the others by themselves."""
    reference = pivots()
    out = np.zeros(len(fa), bool)
    each, back = np.unique(np.concatenate([fa, fb]), return_inverse=True)
    a, b = back[: len(fa)], back[len(fa) :]
    for row in distance_table(each, reference):
        out |= np.abs(row[a] - row[b]) > radius
    rest = np.flatnonzero(~out)
    out[rest] = np.bitwise_count(fa[rest] ^ fb[rest]) > radius
    return out


def _near(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, n_a, n_b, fp_a, fp_b) that pivots and fingerprints don't discard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, fa, fb = (batch.column(c).to_numpy() for c in ("n_a", "n_b", "fp_a", "fp_b"))
            gone = far_apart(fa.view(np.uint64), fb.view(np.uint64)) & (np.minimum(na, nb) >= SURE_SHINGLES)
            keep = pa.array(~gone)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "fp_a", "fp_b").mapInArrow(run, "a long, b long").distinct()


def _signatures(docs: DataFrame) -> DataFrame:
    """(k, row, s, n, fp, bands): key and hash of the text; hash, size, fingerprint and band hashes of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, first = shingle_sets(block)
            bands = pa.ListArray.from_arrays(np.arange(len(first), dtype=np.int32) * BANDS, band_hashes(h, first).view(np.int64).ravel())
            cols = [block.rows.column("k"), block.rows.column("row"), pa.array(set_hashes(h, first).view(np.int64)), pa.array(np.diff(first)), pa.array(set_fingerprints(h, first).view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "row", "s", "n", "fp", "bands"])

    rows = docs.select(doc_key().alias("k"), F.xxhash64(whole_text()).alias("row"), "text")
    return rows.mapInArrow(run, "k long, row long, s long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, shingles) of the wanted documents (k, row, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, first = shingle_sets(block)
            yield pa.RecordBatch.from_arrays([block.rows.column("s"), pa.ListArray.from_arrays(first.astype(np.int32), h.view(np.int64))], names=["s", "shingles"])

    wanted = cut(wanted)
    rows = docs.select(doc_key().alias("k"), F.xxhash64(whole_text()).alias("row"), "text")
    rows = rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, ["k", "row"])  # texts that are not wanted stay where they are
    return rows.select("s", "text").mapInArrow(run, "s long, shingles array<long>").dropDuplicates(["s"])


def _alike(n_a: str, n_b: str, shared=None):
    """Whether sets of these sizes can be as similar as a link needs; whether they are, given the number of shared shingles."""
    top, bottom = SIMILARITY
    if shared is None:
        return F.least(n_a, n_b) * bottom >= F.greatest(n_a, n_b) * top
    return shared * bottom >= (F.col(n_a) + F.col(n_b) - shared) * top


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    used = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    sets = cut(_sets(docs, nodes.join(used, "s").select("k", "row", "s")))  # so that a join with it can be dealt anew where a key is hot
    left = sets.select(F.col("s").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(_alike("nx", "ny", F.col("shared"))).select("a", "b")


def _rooted(links: DataFrame) -> DataFrame:
    """(s, root) of the nodes that have links to lesser ones; any other node is its own root.  Checkpointed."""
    return cut(components(links).where("node <> root").select(F.col("node").alias("s"), "root"))


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (with s) and their root."""
    return look_up(rows, roots, ["s"]).withColumn("root", F.coalesce("root", "s"))


def _bucket_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs that connect the nodes of equal fingerprints, and by buckets and pivot tables those within three bits."""
    prints = cut(nodes.groupBy("fp").agg(F.min("s").alias("k")))
    same = look_up(nodes.select("s", "fp"), prints, ["fp"], "inner").where("s <> k").select(F.col("k").alias("a"), F.col("s").alias("b"))
    return same.unionByName(fingerprint_links(prints).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")))


def partners(place: np.ndarray, guest: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Members that may be linked to one of another root in their block, a guest to a home: sizes, pivots and fingerprints allow it.

    Rows of a block stand together, homes first.
    """
    top, bottom = SIMILARITY
    out = np.zeros(len(place), bool)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(place))))
    homes = np.bincount(block[~guest], minlength=len(start))
    who = np.flatnonzero(guest)
    ends = np.cumsum(homes[block[who]])
    at = 0
    while at < len(who):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        now = who[at:stop]
        i, j = np.repeat(now, homes[block[now]]), ragged(start[block[now]], homes[block[now]])
        least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        maybe = (root[i] != root[j]) & (least * bottom >= most * top)
        i, j, least = i[maybe], j[maybe], least[maybe]
        near = ~far_apart(fp[i], fp[j]) | (least < SURE_SHINGLES)
        out[i[near]] = True
        out[j[near]] = True
        at = stop
    return out


def block_links(root: np.ndarray, guest: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between guests and homes that connect all of them whose sets are similar enough; members of one root are connected.

    A guest is held against all homes of other components at once that pivots and fingerprints don't discard.
    """
    top, bottom = SIMILARITY
    size = np.array([len(x) for x in sets])
    _, label = np.unique(root, return_inverse=True)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    homes = np.flatnonzero(~guest)
    mark = np.zeros(int(word.max(initial=-1)) + 1, bool)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(guest).tolist():
        n = size[homes]
        j = homes[(label[homes] != label[i]) & (np.minimum(n, size[i]) * bottom >= np.maximum(n, size[i]) * top)]
        if len(j):
            j = j[~far_apart(np.full(len(j), fp[i]), fp[j]) | (np.minimum(size[j], size[i]) < SURE_SHINGLES)]
        if not len(j):
            continue
        own = word[first[i] : first[i + 1]]
        mark[own] = True
        hit = np.concatenate([[0], np.cumsum(mark[word[ragged(first[j], size[j])]])])
        ends = np.cumsum(size[j])
        shared = hit[ends] - hit[ends - size[j]]
        mark[own] = False
        for x in j[shared * bottom >= (size[j] + size[i] - shared) * top].tolist():
            if label[x] != label[i]:
                label[label == label[x]] = label[i]
                links.append((i, x))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, those of one place (which stand together) in one batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("place").to_numpy()
        last = len(place) - int(np.argmax(place[::-1] != place[-1])) if (place != place[-1]).any() else 0  # where the last place starts
        if kept and (last or kept[-1].column("place")[-1].as_py() != place[0]):
            head = pa.concat_batches([*kept, batch.slice(0, last)]) if last else pa.concat_batches(kept)
            yield head
            kept = []
        elif last:
            yield batch.slice(0, last)
        kept.append(batch.slice(last))
    if kept:
        yield pa.concat_batches(kept)


def _links_apart(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): verified links between members (key, s, n, fp, root) of a band that have different roots."""
    n_partitions = partitions(docs.sparkSession)
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    total = [F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "root", "n")).alias("main"), F.count(F.lit(1)).alias("roots")]
    bands = by_root.groupBy("key").agg(*total).where("roots > 1")
    blocks_of = lambda rows, n: F.ceil(F.greatest(rows / GROUP_ROWS, n / GROUP_SHINGLES)).cast("int")
    blocks_, visits = blocks_of(F.col("rows"), F.col("n")), blocks_of(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n"))
    bands = cut(bands.select("key", F.col("main.root").alias("main"), blocks_.alias("blocks"), visits.alias("visits")))
    rows = look_up(members, bands, ["key"], "inner")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "s"), F.col(n)).cast("int")
    what = ["s", "root", "n", "fp"]
    homes = rows.select("key", own(0, "blocks").alias("p"), F.explode(up_to("visits")).alias("q"), F.lit(False).alias("guest"), *what)
    guests = rows.where("root <> main").select("key", F.explode(up_to("blocks")).alias("p"), own(1, "visits").alias("q"), F.lit(True).alias("guest"), *what)
    placed = homes.unionByName(guests).select(F.xxhash64("key", "p", "q").alias("place"), "guest", *what)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_blocks(batches):
            place, guest, root, n, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "guest", "root", "n", "fp"))
            yield batch.select(["place", "guest", "s", "root", "fp"]).filter(pa.array(partners(place, guest, root, n, fp.view(np.uint64))))

    placed = placed.repartition(n_partitions, "place").sortWithinPartitions("place", "guest")
    placed = cut(placed.mapInArrow(near, "place long, guest boolean, s long, root long, fp long"))
    sets = _sets(docs, nodes.join(placed.select("s").distinct(), "s").select("k", "row", "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            s, root, guest, fp, sets = (list(x) for x in zip(*held, strict=True))
            i, j = block_links(np.array(root), np.array(guest), np.array(fp).view(np.uint64), sets)
            s = np.array(s)
            return pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[j])], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("place", "s", "root", "guest", "fp")]
            lists = batch.column("shingles")
            for x, (place, s, root, guest, fp) in enumerate(zip(*cols, strict=True)):
                if place != now:
                    if held:
                        yield found()
                    now, held = place, []
                held.append((s, root, guest, fp, lists[x].values.to_numpy()))
        if held:
            yield found()
        release()

    met = placed.join(sets, "s").repartition(n_partitions, "place").sortWithinPartitions("place")
    return met.select("place", "s", "root", "guest", "fp", "shingles").mapInArrow(run, "a long, b long")


def near_duplicate_roots(docs: DataFrame) -> DataFrame:
    """(k, row, root): each document's component of links."""
    prints = cut(_signatures(docs))
    nodes = cut(prints.groupBy("s").agg(F.min(F.struct("k", "row", "n", "fp", "bands")).alias("x")).select("s", "x.k", "x.row", "x.n", "x.fp", "x.bands"))
    members = nodes.select("s", "n", "fp", F.posexplode("bands").alias("t", "band")).select(F.xxhash64("t", "band").alias("key"), "s", "n", "fp")
    centres = cut(members.groupBy("key").agg(F.min(F.struct("s", "n", "fp")).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("x.s").alias("a"), F.col("x.n").alias("n_a"), F.col("x.fp").alias("fp_a")))
    stars = look_up(members, centres, ["key"], "inner").where("s <> a").where(_alike("n_a", "n"))
    stars = cut(_near(stars.select("a", F.col("s").alias("b"), "n_a", F.col("n").alias("n_b"), "fp_a", F.col("fp").alias("fp_b"))))
    links = cut(_verified(docs, nodes, cut(stars.unionByName(_bucket_pairs(nodes)).distinct())))
    roots = _rooted(links)
    more = cut(_links_apart(docs, nodes, _with_root(members, roots)))
    if not more.isEmpty():
        roots = _rooted(links.unionByName(more))
    return _with_root(prints.select("k", "row", "s"), roots).select("k", "row", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of documents that are linked by a similarity of 0.8 or more.

    That row is the one of the least doc_id (null comes last), all columns as they
    were, whatever their names.  Texts are whole, words are runs of bytes other than
    0x20 and 0x09-0x0D, ASCII letters in lower case; texts without words are alike.
    Of repeated rows (doc_id and text) one stays; an empty table stays empty.
    """
    return keep_first(docs, near_duplicate_roots(docs))
