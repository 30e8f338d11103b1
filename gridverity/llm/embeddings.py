"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Centroids are fitted to a bounded sample.  Each distinct vector is at home in the
cell of its nearest centroid and visits each cell whose border it is close to; a
cell compares its visitors with its home vectors, block by block, in double
precision.  Blocks count links and give a spanning forest of them, so a dense
group costs products but no table of pairs.

A vector y of cell c can only link to x if x is within |x - y| of the hyperplane
between x's centroid and c, and |x - y| is sqrt(2 - 2 * threshold) at most: x
visits the cells whose border is that close, so no link is missed.  A smaller
`reach` visits less and may miss links.

Vectors travel as packed groups of rows, one for each cell that a batch goes to.  A
cell's home vectors are in blocks of bounded bytes; a cell of one block is one task's
work, and the visitors of a larger one go to each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import mixed
from .common import NO_ID, cut, look_up, partitions, table
from .components import components, unite

THRESHOLD = 0.95
#: Vectors that centroids are fitted to, at most; vectors of a cell, about.
MAX_SAMPLE = 20_000
CELL_SIZE = 1_024
#: Bytes of a block of home vectors, and of a product, about; rows that are placed at once.
BLOCK_BYTES = 16 << 20
BATCH_ROWS = 4_096
_KEPT_ROUNDS = 8


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column (no nulls, all of one size)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    return units(rows_of(column, size))


def narrow(x: np.ndarray) -> np.ndarray:
    """x in single precision if that loses nothing: vectors travel as they are, in half the bytes, and are scaled where they meet."""
    small = x.astype(np.float32)
    return small if (small == x).all() else x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = _KEPT_ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows, from evenly spaced rows; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def visits(x: np.ndarray, c: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and which cells it visits: its home, and cells of greater number whose border is within reach.

    Of two linked vectors in different cells the one in the cell of smaller number visits the other.
    """
    near = x @ c.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(x)), home][:, None] - near
    go = gap <= reach * apart[home] + 1e-9
    go &= np.arange(len(c))[None, :] > home[:, None]
    go[np.arange(len(x)), home] = True
    return home, go


def fit_centroids(nodes: DataFrame, size: int, k: int, most: int) -> np.ndarray:
    """Centroids from the vectors of `most` rows with the least hashes, in one task."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [unit_rows(b.column("vec"), size) for b in batches if b.num_rows]
        c = spherical_kmeans(np.concatenate(rows), k)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()])], names=["c"])

    raw = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("vec").coalesce(1).mapInArrow(train, "c binary").first().c
    return np.frombuffer(raw).reshape(k, size)


class CellLinks:
    """Links between a block's home vectors and its visitors, one group of visitors after another.

    Links within the cell are seen from both ends, as its vectors visit their home;
    links of other visitors are seen once and count for both ends.
    """

    def __init__(self, node: np.ndarray, weight: np.ndarray, vec: np.ndarray, cell: int, threshold: float):
        self.node, self.weight, self.vec, self.cell, self.threshold = node, weight, vec, cell, threshold
        self.count = np.zeros(len(node), np.int64)
        self.label = np.arange(len(node))

    def add(self, node: np.ndarray, weight: np.ndarray, vec: np.ndarray, home: np.ndarray) -> Iterator[tuple]:
        """(node, links, a, b) of visitors: their counts, and what ties them to home vectors."""
        rows = max(1, BLOCK_BYTES // (8 * max(1, len(self.node))))
        for s in range(0, len(node), rows):
            linked = (vec[s : s + rows] @ self.vec.T) >= self.threshold
            linked &= node[s : s + rows, None] != self.node[None, :]
            g, h = np.nonzero(linked)
            if not len(g):
                continue
            g += s
            away = home[g] != self.cell
            np.add.at(self.count, h[away], weight[g[away]])
            first = np.ones(len(g), bool)
            first[1:] = g[1:] != g[:-1]
            heads = np.flatnonzero(first)
            mine = np.add.reduceat(self.weight[h], heads)
            # all home vectors of a visitor's links are joined; the visitor hangs on one of them
            lead = h[heads][np.cumsum(first) - 1]
            self.label = unite(self.label, lead, h)
            yield node[g[heads]], mine.astype(np.int64), node[g[heads]], self.node[h[heads]]

    def close(self) -> tuple:
        some, joined = np.flatnonzero(self.count), np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.node[some], self.count[some], self.node[joined], self.node[self.label[joined]]


_FOUND = ("node", "links", "a", "b")
_PLACED = "size int, cell int, block int, guest boolean, node binary, weight binary, home binary, vec binary"


def _found(node, links, a, b) -> pa.RecordBatch:
    none = lambda n: pa.nulls(n, pa.int64())
    n, m = len(node), len(a)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(node), none(m)]), pa.concat_arrays([pa.array(links), none(m)]), pa.concat_arrays([none(n), pa.array(a)]), pa.concat_arrays([none(n), pa.array(b)])], names=_FOUND)


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Groups of vectors sorted by (size, cell, block), home vectors first: counts and links of each block."""
    now, homes, block = None, [], None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["size"], r["cell"], r["block"])
            if key != now:
                if block:
                    yield _found(*block.close())
                now, homes, block = key, [], None
            node, weight, home = (np.frombuffer(r[c], t) for c, t in (("node", np.int64), ("weight", np.int64), ("home", np.int32)))
            kind = np.float32 if len(r["vec"]) == 4 * len(node) * r["size"] else np.float64
            part = (node, weight, units(np.frombuffer(r["vec"], kind).astype(np.float64).reshape(-1, r["size"])), home)
            if not r["guest"]:
                homes.append(part[:3])
            elif homes:
                block = block or CellLinks(*(np.concatenate(x) for x in zip(*homes, strict=True)), r["cell"], threshold)
                for out in block.add(*part):
                    yield _found(*out)
    if block:
        yield _found(*block.close())


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, most: int = MAX_SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    Vectors link if their cosine is `threshold` or more; ones of other lengths
    never do, nor do vectors that are null, empty or zero or hold null or
    non-finite components: each is its own component.  Equal vectors are one node
    with a weight, and link to one another.  Rows without a vec_id come last when
    a component's id is chosen.  An empty table gives an empty result.  Other
    columns are not read.
    """
    e = F.col("embedding").cast("array<double>")
    good = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("k"), e.alias("e"))
    rows = rows.select("k", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"), F.coalesce(good, F.lit(False)).alias("good"))  # -0.0 is 0.0
    for seed in range(100):
        node = F.xxhash64(F.lit(seed), "e")
        nodes = cut(rows.where("good").groupBy(node.alias("node"), F.col("e").alias("vec")).agg(F.count(F.lit(1)).alias("weight"), F.min("k").alias("k")))
        if nodes.groupBy("node").count().where("count > 1").isEmpty():  # each hash stands for one vector
            break
    ids = cut(rows.select("k", F.when(F.col("good"), node).alias("node")))
    nodes = nodes.withColumn("size", F.size("vec"))
    found = cut(_links(nodes, threshold, most))
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    # nodes are in the order of their least ids, so a component's root has the least of all
    known = nodes.select("node", "k", "weight")
    for end in ("a", "b"):
        found = look_up(found, known.select(F.col("node").alias(end), F.struct("k", "node").alias(f"{end}_node")), [end])
    roots = components(found.where("a is not null").select("a_node", "b_node"), "a_node", "b_node")
    roots = roots.where("node != root").select(F.col("node.node").alias("node"), F.col("root.k").alias("component"))
    named = known.join(roots, "node", "left").join(counts, "node", "left")
    named = cut(named.select("node", F.coalesce("component", "k").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    out = look_up(ids, named, ["node"])
    component = F.coalesce("component", "k")
    return out.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NO_ID, component).alias("component_id"),
        (F.col("k") == component).alias("kept"),
    )


def _links(nodes: DataFrame, threshold: float, most: int) -> DataFrame:
    """node and links (counts to be summed up), or a and b (links that connect components)."""
    spark = nodes.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    # lengths with vectors for more than one cell; others have one cell each
    large = [(r["size"], r["count"]) for r in nodes.groupBy("size").count().where(F.col("count") >= 2 * CELL_SIZE).collect()]
    models = {}
    for size, n in large:
        c = fit_centroids(nodes.where(F.col("size") == size), size, max(1, min(n // CELL_SIZE, most // 8)), most)
        models[size] = c, np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    shared = spark.sparkContext.broadcast(models)  # most / 8 centroids at most for each length

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for s in range(0, rows.num_rows, BATCH_ROWS):
                    part = rows.slice(s, BATCH_ROWS)
                    yield size, part, rows_of(part.column("vec"), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, _, x in by_size(batches):
            home = (units(x) @ shared.value[size][0].T).argmax(axis=1) if size in shared.value else np.zeros(len(x), int)
            cell, n = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), size), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["size", "cell", "n"])

    each = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size"))))  # rows of a block
    cells = nodes.select("size", "vec").mapInArrow(count, "size int, cell int, n long").groupBy("size", "cell").agg(F.sum("n").alias("n"))
    # only cells of more than one block: as many as there are blocks of bytes in the table, at most
    crowded = {(r["size"], r.cell): r.blocks for r in cells.select("size", "cell", F.ceil(F.col("n") / each).cast("int").alias("blocks")).where("blocks > 1").collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, x in by_size(batches):
            if size in shared.value:
                home, go = visits(units(x), *shared.value[size], reach)
            else:
                home, go = np.zeros(len(x), int), np.ones((len(x), 1), bool)
            node, weight = (part.column(c).to_numpy() for c in ("node", "weight"))
            home, x = home.astype(np.int32), narrow(x)
            out: list[tuple] = []

            def add(cell, block, guest, rows):
                out.append((size, cell, block, guest, node[rows].tobytes(), weight[rows].tobytes(), home[rows].tobytes(), x[rows].tobytes()))

            for cell in np.flatnonzero(go.any(axis=0)).tolist():
                blocks = crowded.get((size, cell), 1)
                own, all_ = np.flatnonzero(home == cell), np.flatnonzero(go[:, cell])
                to = (mixed(node[own].view(np.uint64)) % np.uint64(blocks)).astype(int)
                for b in np.unique(to).tolist():
                    add(cell, b, False, own[to == b])
                for b in range(blocks):
                    add(cell, b, True, all_)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PLACED.split(", ")])

    placed = nodes.select("size", "node", "weight", "vec").mapInArrow(place, _PLACED)
    met = placed.repartition(partitions(spark), "size", "cell", "block").sortWithinPartitions("size", "cell", "block", "guest")
    return met.mapInArrow(lambda b: _meet(b, threshold), "node long, links long, a long, b long")


def op8_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
