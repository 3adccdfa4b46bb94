"""Connected components of a link table: union-find within partitions, then star rounds between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import stored


def _forest(batches):
    """Union-find over one partition's links: each node with the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(x) for x in parent), np.int64, len(parent))
    keep = nodes != roots
    yield pa.record_batch([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v: long) that isn't the smallest of its component.

    A partition's links become a forest of as many links as nodes. Then each node's neighbours are tied to the least of
    them, larger ones and smaller ones in turn, until nothing changes, as often as it takes (a number of rounds that
    grows with the logarithm of the longest path). Each round is stored, so that lost executors cost one round. A node's
    neighbours are never gathered: joins and min() only.
    """
    edges = stored(links.select("u", "v").filter("u <> v").mapInArrow(_forest, "u long, v long"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "links")
        after = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
