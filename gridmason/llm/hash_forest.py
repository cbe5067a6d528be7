"""Approximate nearest neighbours by a hash-prefix forest: sorted arrays of long hash strings, one a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut, table

#: Trees; digits of a hash string; bits of a digit.
TREES, DIGITS, DIGIT_BITS = 64, 8, 8
#: An ascent ends when this share of the block's vectors has been met, repeats counted, or the root.
SHARE = 0.2
#: Distinct vectors in a block, on average. A block and its forest are held by one task.
BLOCK = 16_384
SEED = 7


class Forest:
    """A forest over the rows of x. A digit is the direction, of the axes of a random rotation and their opposites, nearest to the vector; a tree's
    hash strings are sorted, so the rows that share a prefix with a query stand together.

    For inner products, rows get one more component that makes their lengths equal; a query's is 0.
    """

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.x, n, d = x, len(x), x.shape[1]
        length = np.linalg.norm(x, axis=1)
        most = length.max()
        padded = np.c_[x, np.sqrt(np.maximum(most**2 - length**2, 0))] / most
        rng = np.random.default_rng(SEED)
        # a digit names at most 2 ** DIGIT_BITS directions
        width = min(d + 1, 1 << (DIGIT_BITS - 1))
        self.axes = [[np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0][:, :width] for _ in range(DIGITS)] for _ in range(trees)]
        self.order, self.sorted = [], []
        for axes in self.axes:
            s = self.strings(padded, axes)
            order = np.argsort(s, kind="stable")
            self.order.append(order)
            self.sorted.append(s[order])

    @staticmethod
    def strings(x: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for a in axes:
            along = x @ a
            best = np.abs(along).argmax(axis=1)
            digit = 2 * best + (along[np.arange(len(x)), best] < 0)
            out = out << np.uint64(DIGIT_BITS) | digit.astype(np.uint64)
        return out

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, the rows met: each tree is descended to its longest match; from the deepest level on, all trees ascend together, a digit at a time, until `wanted` rows are met or the root is."""
        n, q = len(self.x), np.c_[queries, np.zeros(len(queries))]
        low = np.empty((DIGITS + 1, len(self.axes), len(q)), np.int64)
        high = np.empty_like(low)
        for t, axes in enumerate(self.axes):
            s = self.strings(q, axes)
            for level in range(DIGITS + 1):
                free = np.uint64((1 << DIGIT_BITS * (DIGITS - level)) - 1)
                low[level, t] = np.searchsorted(self.sorted[t], s & ~free, "left")
                high[level, t] = np.searchsorted(self.sorted[t], s | free, "right")
        met = (high - low).sum(axis=1)
        met[0] = max(n, wanted)
        level = DIGITS - np.argmax(met[::-1] >= wanted, axis=0)
        for i, at in enumerate(level):
            if at == 0:
                yield np.arange(n)
                continue
            mark = np.zeros(n, bool)
            for t, order in enumerate(self.order):
                mark[order[low[at, t, i] : high[at, t, i]]] = True
            yield np.flatnonzero(mark)


def _search(k: int, share: float):
    """From rows sorted by block and kind: builds the forest of a block's vectors (kind 0), then answers its queries (kind 1) as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vectors, ids, forest = None, [], [], None

        def answer(queries: list, vector_ids: list) -> pa.RecordBatch:
            x = np.array(queries, np.float64)
            found, scores = [], []
            for q, rows in zip(x, forest.candidates(x, max(int(share * len(forest.x)), 20 * k))):
                s = forest.x[rows] @ q
                if len(rows) > 2 * k + 40:  # the k + 1 best, and all that may tie with the last of them
                    keep = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-12 * np.linalg.norm(q)
                    rows = rows[keep]
                exact = (forest.x[rows] * q).sum(axis=1)
                best = sorted(((-v, i) for v, r in zip(exact.tolist(), rows.tolist()) for i in ids[r]))[: k + 1]
                found.append([i for _, i in best])
                scores.append([-v for v, _ in best])
            return pa.RecordBatch.from_arrays([pa.array(vector_ids, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["query", "ids", "scores"])

        for b in batches:
            queries, of = [], []
            for at, kind, q, v, i in zip(*(c.to_pylist() for c in b.columns)):
                if at != block:
                    if queries:
                        yield answer(queries, of)
                        queries, of = [], []
                    block, vectors, ids, forest = at, [], [], None
                if kind == 0:
                    vectors.append(v)
                    ids.append(i)
                else:
                    if forest is None:
                        forest = Forest(np.array(vectors, np.float64))
                        vectors = []
                    queries.append(v)
                    of.append(q)
            if queries:
                yield answer(queries, of)

    return run


def sound(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id, v, dim of the vectors that take part: not null, of some length, all components finite, not all zero; with an id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries, k: int = 20, id: str = "vec_id", vector: str = "embedding", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `queries` (on id) picks, the k rows of largest inner product found, its own excepted; ties to smaller ids.

    Equal vectors are merged first, with the k + 1 smallest of their ids, which is all that any result can need; equal queries are searched once.
    Distinct vectors are dealt by hash to blocks of about `block`, each with a forest of its own in one task; all queries pass through every block, and the best of all blocks are merged.
    So every row is indexed; which rows of a block are scored is up to its forest.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor rows without an id. Vectors are compared with those of the same number of components.
    Rows that are repeated whole count once. Fewer candidates than k: all. Empty tables give an empty result. Other columns are ignored.
    """
    rows = sound(vectors, id, vector).distinct()
    own = Window.partitionBy("v").orderBy("id")
    small = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    merged = cut(small.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sizes = {r.dim: r.n for r in merged.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    blocks = spark.createDataFrame([(d, max(1, -(-n // block))) for d, n in sizes.items()] or [(0, 1)], "of int, blocks int")
    asked = cut(rows.where(queries(F.col("id"))).select("id", "v"))
    first = asked.groupBy("v").agg(F.min("id").alias("query"))
    wanted = first.withColumn("dim", F.size("v")).join(F.broadcast(blocks), F.col("dim") == F.col("of"))
    target = merged.join(F.broadcast(blocks), F.col("dim") == F.col("of"))
    place = lambda b: F.struct("dim", b.cast("int").alias("b"))
    index = target.select(place(F.pmod(F.xxhash64("v"), F.col("blocks"))).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "v", "ids")
    asks = wanted.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "query", "v")
    asks = asks.select(place(F.col("b")).alias("at"), F.lit(1).alias("kind"), "query", "v", F.lit(None).cast("array<bigint>").alias("ids"))
    n = sum(max(1, -(-x // block)) for x in sizes.values()) or 1
    work = index.unionByName(asks).select(F.concat_ws("/", "at.dim", "at.b").alias("at"), "kind", "query", "v", "ids").repartition(n, "at").sortWithinPartitions("at", "kind")
    out = StructType([StructField("query", LongType()), StructField("ids", ArrayType(LongType())), StructField("scores", ArrayType(DoubleType()))])
    found = work.mapInArrow(_search(k, share), out)
    each = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    top = each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    per = asked.select(F.col("id").alias("query_id"), F.col("v").alias("of")).join(first, F.col("of") == F.col("v")).select("query_id", "query")
    others = per.join(lists, "query").select("query_id", F.posexplode(F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("i", "e"))
    return others.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op1(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda id: id % 20 == 0)
