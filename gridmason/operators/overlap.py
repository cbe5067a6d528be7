"""Joins of boxes that overlap, and what is counted over them. Boxes of different pages never meet, nor do boxes of a page that share no cell: page_id and cell are the join key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, ios_min, iou, overlaps, skinny

CORNERS = ("x1", "y1", "x2", "y2")
#: The side of a cell, in pixels. Boxes stand in every cell that they touch, so cells should be some times as wide as most boxes.
CELL = 512


def sided(boxes: DataFrame, side: str, *more: str, id: str = "box_id") -> DataFrame:
    """page_id, and the other columns under names that begin with side."""
    return boxes.select("page_id", *[F.col(c).alias(f"{side}_{c}") for c in (id, *CORNERS, *more)])


def _span(lo: Column, hi: Column, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def in_cells(boxes: DataFrame, side: str, cell: int = CELL) -> DataFrame:
    """Boxes of sided(), once for each cell gx, gy that they touch."""
    b = Box.of(f"{side}_")
    return boxes.withColumn("gx", _span(b.x1, b.x2, cell)).withColumn("gy", _span(b.y1, b.y2, cell))


def meeting(left: DataFrame, right: DataFrame, a: str, b: str, cell: int = CELL) -> DataFrame:
    """Each two boxes, of sided(), that share an area of a page.

    They meet by an equi-join on page and cell, so a page of very many boxes is dealt to as many tasks as it has cells, and only neighbours are compared. A pair counts in the cell of its overlap's corner
    alone, so none counts twice.
    """
    p, q = Box.of(f"{a}_"), Box.of(f"{b}_")
    corner = (F.floor(F.greatest(p.x1, q.x1) / cell) == F.col("gx")) & (F.floor(F.greatest(p.y1, q.y1) / cell) == F.col("gy"))
    return in_cells(left, a, cell).join(in_cells(right, b, cell), ["page_id", "gx", "gy"]).where(overlaps(p, q) & corner).drop("gx", "gy")


def holding(boxes: DataFrame, points: DataFrame, side: str, x: str = "cx", y: str = "cy", cell: int = CELL) -> DataFrame:
    """Each box, of sided(), with the points of its page that lie in it, its edges included. A point has one cell."""
    placed = points.withColumn("gx", F.floor(F.col(x) / cell)).withColumn("gy", F.floor(F.col(y) / cell))
    return in_cells(boxes, side, cell).join(placed, ["page_id", "gx", "gy"]).where(Box.of(f"{side}_").holds(F.col(x), F.col(y))).drop("gx", "gy")


def overlap_pairs(boxes: DataFrame, grid: int = CELL) -> DataFrame:
    """page_id, i, j, iou, ios of every two boxes of a page that share an area, i < j. They meet in cells of `grid` pixels."""
    p, q = Box.of("a_"), Box.of("b_")
    pairs = meeting(sided(boxes, "a"), sided(boxes, "b"), "a", "b", grid).where("a_box_id < b_box_id")
    return pairs.select("page_id", F.col("a_box_id").alias("i"), F.col("b_box_id").alias("j"), iou(p, q).alias("iou"), ios_min(p, q).alias("ios"))


def merged_blocks(boxes: DataFrame) -> DataFrame:
    """page_id, box_id of boxes that only join others: two smaller ones or more lie in them by over 80 %, cover three quarters of their area
    together, and none of these is a skinny slice."""
    big, small = Box.of("b_"), Box.of("s_")
    inside = ios_min(small, big)
    pairs = meeting(sided(boxes, "b"), sided(boxes, "s"), "b", "s").where((small.area < big.area) & (inside > 0.80))
    sums = pairs.groupBy("page_id", F.col("b_box_id").alias("box_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(inside * small.area).alias("covered"), F.bool_or(skinny(small)).alias("sliced"), F.first(big.area).alias("area"))
    return sums.where((F.col("n") >= 2) & (F.col("covered") >= 0.75 * F.col("area")) & ~F.col("sliced")).select("page_id", "box_id")


def without(boxes: DataFrame, dropped: DataFrame) -> DataFrame:
    return boxes.join(dropped, ["page_id", "box_id"], "left_anti")


def match_rate(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: n_left, n_right, matched (boxes of the left with a partner of at least this IoU), and rate, the share of the left; 1 if both are empty.

    As `rate` divides by the left, so `over_right` divides by the right: the latter can pass 1, and is given only for comparison.
    """
    a, b = Box.of("a_"), Box.of("b_")
    partner = meeting(sided(left, "a"), sided(right, "b"), "a", "b").where(iou(a, b) >= least).select("page_id", F.col("a_box_id").alias("box_id")).distinct()
    counts = left.agg(F.count(F.lit(1)).alias("n_left")).crossJoin(right.agg(F.count(F.lit(1)).alias("n_right"))).crossJoin(partner.agg(F.count(F.lit(1)).alias("matched")))
    share = lambda n: F.when(n > 0, F.col("matched") / n)
    both_empty = F.when((F.col("n_left") == 0) & (F.col("n_right") == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return counts.select("*", F.coalesce(share(F.col("n_left")), both_empty).alias("rate"), F.coalesce(share(F.col("n_right")), both_empty).alias("over_right"))


def jaccard(left: DataFrame, right: DataFrame, key: str = "box_id") -> DataFrame:
    """One row: n_both, n_any, and jaccard, their ratio; 1 if both are empty. Keys are compared as sets."""
    marked = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    sums = marked.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return sums.select("*", F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(F.lit(1.0)).alias("jaccard"))
