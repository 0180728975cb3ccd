"""Connected components by repeated contraction, with DataFrame operations.

Each round maps every node to the neighbour, or itself, with the smallest hash, follows that map three steps further, and keeps
the edges between different images.  Hashes make the order random, so that a round removes a constant share of the nodes in expectation,
on long chains too.  Neighbourhoods are reduced to a minimum before the shuffle; joins with a hub are skewed joins, which Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """node, image of one map followed by another; images that the other does not map stay."""
    return first.join(then.select(F.col("node").alias("image"), F.col("image").alias("next")), "image", "left").select("node", F.coalesce("next", "image").alias("image"))


def components(edges: DataFrame, small: int = 0, rounds: int | None = None) -> DataFrame:
    """node, component (the smallest node) of every node of edges (a, b), longs; null ends and loops are left out.

    Once at most `small` edges are left, one task finishes them by union-find in Python; with 0 all rounds are native.  With a
    number of rounds it stops after them: nodes of one component may then stand under several smallest nodes, never the reverse.
    """
    left = written(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    images: list[DataFrame] = []
    while (rounds is None or len(images) < max(1, rounds)) and (n := left.count()):
        if n <= small:
            images.append(written(left.coalesce(1).mapInArrow(_union_find, "node long, image long")))
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(images))).alias("hash"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.any_value(order("a")))["node"].alias("image")))
        twice = _after(least, least)
        image = written(_after(twice, twice))
        images.append(image)
        first, second = image.select(F.col("node").alias("a"), F.col("image").alias("x")), image.select(F.col("node").alias("b"), F.col("image").alias("y"))
        moved = left.join(first, "a").join(second, "b").where("x <> y")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not images:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = images[-1]
    for image in reversed(images[:-1]):
        found = _after(image, found)
    found = written(found) if len(images) > 1 else found
    least = found.groupBy("image").agg(F.min("node").alias("component"))
    return found.join(least, "image").select("node", "component")


def _union_find(batches):
    edges = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ends.reshape(2, -1).T.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[root(x) for x in range(len(nodes))]] if len(nodes) else nodes)], names=["node", "image"])
