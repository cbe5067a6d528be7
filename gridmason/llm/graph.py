"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import union_find
from .common import release, stored

#: Edges that a task holds, to put the stars of what they connect in their place.
TOGETHER = 1 << 20


def _spanning(together: int):
    """From edges (a, b), so many at a time: an edge from each node to the smallest that they connect it with."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        nodes, at = np.unique(np.r_[rows.column(0).to_numpy(), rows.column(1).to_numpy()], return_inverse=True)
        low = union_find(len(nodes), *np.split(at, 2))
        own = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                if n + part.num_rows > together:
                    yield stars(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield stars(held)

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges a > b. A node's smallest neighbour takes over its other neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low")).select("n", F.least("n", "low").alias("low"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        joined = edges.join(least, F.col("a") == F.col("n"))
        moved = joined.select(F.greatest(F.col("b"), F.col("low")).alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node that has an edge, and the smallest node that it can reach. edges: a, b, ordered either way.

    First, of each million edges only those of spanning stars are kept, fewer than they have nodes: dense groups have many edges a node.
    Then a round joins the edges with their least neighbours; the number of rounds grows with the logarithm of a component's diameter.
    Each round is written to the checkpoint folder as a table, whose size the planner then knows. Loops and repeated edges are ignored; nulls too.
    """
    given = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = stored(given.coalesce(-(-given.count() // TOGETHER) or 1).mapInArrow(_spanning(TOGETHER), given.schema).distinct())
    release(given)
    sign = None
    while True:
        before, edges = edges, stored(_star(_star(edges, True), False))
        release(before)
        # a forest of stars is a fixed point; n, and the sums of hashes, tell whether anything moved
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign:
            break
        sign = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
