"""Connected components of a link table, all on the executors.

Alternating star contraction: each round hangs a node's larger neighbours, then
its smaller ones, on the least neighbour.  Few rounds suffice (their number grows
with the logarithm of the longest path); each ends in a checkpoint, so that a
lost executor costs one round and plans stay short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, look_up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; label[x] is the least member of x's set, before and after."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node that has a link to another node; root is its component's least node.

    Nodes are of any type with an order.  Links may repeat, in either direction;
    loops and links with a null end are ignored.  No links give no rows.  A node
    with very many links is no more work for one task than another (look_up).
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut(edges)
    state = None
    while True:
        # a node's larger neighbours go to the least of it and its neighbours
        least = cut(edges.groupBy("hi").agg(F.min("lo").alias("m")))
        large = look_up(edges, least.select(F.col("hi").alias("lo"), "m"), ["lo"])
        large = cut(large.select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        # its smaller neighbours, and the node itself, go to the least one
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = look_up(large, least, ["hi"], "inner").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.unionByName(least.select("hi", F.col("m").alias("lo"))).where("hi != lo").distinct())
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
