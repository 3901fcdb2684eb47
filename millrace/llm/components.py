"""Connected components of a link table.

Tasks contract their own links by union-find first; what is left converges by alternating
large and small stars (Kiveris et al. 2014), each a minimum per node and a join, so a node with
many links is combined on the map side and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import keep


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and of each the least node of its component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]] if len(nodes) else nodes


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        go = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[go]), pa.array(roots[go])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, root being the least node that it reaches. ``links``: a and b, long."""
    edges = keep(links.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    before = None
    while True:
        # Large star: larger neighbours move to the least of a node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = keep(small.filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
