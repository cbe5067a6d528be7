"""Made-up pools and plans with a known structure, from hashes of row numbers: the same on any cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_W, CELL_H, GUTTER, ORIGIN = 120, 90, 14, 40
PAPER, INK = 245, 40
#: A cell's fill, as blue, green and red, and the band that finds it.
COLOR = (200, 90, 60)
FILL = ([120, 0, 0], [255, 130, 110])


def _unit(seed: int, what: str, *keys: str) -> Column:
    """A number from 0 up to 1 that keys and seed decide."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1 << 30)) / float(1 << 30)


def _between(low: float, high: float, *of) -> Column:
    return low + (high - low) * _unit(*of)


def grid(spark: SparkSession, cells: int) -> DataFrame:
    """cell, x, y of a nearly square grid."""
    cols = max(1, round(cells**0.5))
    at = lambda i, side: F.lit(float(ORIGIN)) + i * (side + GUTTER)
    return spark.range(cells).select(F.col("id").alias("cell"), at(F.col("id") % cols, CELL_W).alias("x"), at(F.floor(F.col("id") / cols), CELL_H).alias("y"))


def box_pool(spark: SparkSession, cells: int = 600, seed: int = 0) -> DataFrame:
    """box_id, page_id, x1..y2, score, source, kind: two to four jittered copies of each cell, a nested label in a third, a skinny slice in an eighth, and a few blocks over two by two cells; in shuffled order."""
    g = grid(spark, cells)
    w, h = CELL_W + _between(-8, 8, seed, "w", "cell"), CELL_H + _between(-6, 6, seed, "h", "cell")
    copies = (2 + F.floor(3 * _unit(seed, "n", "cell"))).cast("int")
    c = g.select("cell", "x", "y", w.alias("w"), h.alias("h"), F.explode(F.sequence(F.lit(1), copies)).alias("k"))
    jitter = [_between(-4, 4, seed, f"j{i}", "cell", "k") for i in range(4)]
    x, y = F.col("x"), F.col("y")
    boxes = c.select("cell", (x + jitter[0]).alias("x1"), (y + jitter[1]).alias("y1"), (x + F.col("w") + jitter[2]).alias("x2"), (y + F.col("h") + jitter[3]).alias("y2"), _between(0.55, 0.99, seed, "s", "cell", "k").alias("score"), F.lit("cell").alias("kind"))
    nested = g.where(_unit(seed, "nested", "cell") < 0.35).select("cell", (x + CELL_W * 0.3).alias("x1"), (y + CELL_H * 0.3).alias("y1"), (x + CELL_W * 0.8).alias("x2"), (y + CELL_H * 0.8).alias("y2"), _between(0.4, 0.8, seed, "sn", "cell").alias("score"), F.lit("label").alias("kind"))
    thin = g.where(_unit(seed, "thin", "cell") < 0.12).select("cell", (x + 4.0).alias("x1"), (y + 20.0).alias("y1"), (x + CELL_W - 4.0).alias("x2"), (y + 28.0).alias("y2"), _between(0.4, 0.7, seed, "st", "cell").alias("score"), F.lit("slice").alias("kind"))
    n = max(2, cells // 80)
    cols = max(1, round(cells**0.5))
    inner = (F.col("cell") % cols < cols - 1) & (F.col("cell") < cells - cols)
    blocks = g.where(inner).orderBy(_unit(seed, "block", "cell"), "cell").limit(n)
    blocks = blocks.select("cell", x.alias("x1"), y.alias("y1"), (x + 2.0 * CELL_W + GUTTER).alias("x2"), (y + 2.0 * CELL_H + GUTTER).alias("y2"), _between(0.3, 0.6, seed, "sb", "cell").alias("score"), F.lit("block").alias("kind"))
    every = boxes.unionByName(nested).unionByName(thin).unionByName(blocks)
    id_ = F.xxhash64(F.lit(seed), "kind", "cell", "x1", "y1", "x2")
    return every.select(id_.alias("box_id"), F.lit(0).cast("long").alias("page_id"), "x1", "y1", "x2", "y2", "score", F.lit("color").alias("source"), "kind")


def plan(cells: int, seed: int, scale: float = 0.25, lines: bool = False) -> np.ndarray:
    """A page of filled cells with dark outlines on paper, as blue, green and red."""
    cols = max(1, round(cells**0.5))
    side = lambda v: max(1, round(v * scale))
    rows = -(-cells // cols)
    step_x, step_y, start = side(CELL_W + GUTTER), side(CELL_H + GUTTER), side(ORIGIN)
    page = np.full((2 * start + rows * step_y, 2 * start + cols * step_x, 3), PAPER, np.uint8)
    shade = np.random.default_rng(seed).integers(-15, 15, cells)
    for i in range(cells):
        x, y = start + i % cols * step_x, start + i // cols * step_y
        w, h = side(CELL_W), side(CELL_H)
        if lines:
            page[y - 1 : y + h + 1, x - 1 : x + w + 1] = INK
        page[y : y + h, x : x + w] = np.clip(np.array(COLOR) + shade[i], 0, 255)
    return page


def plan_pixels(spark: SparkSession, cells: int, seed: int) -> DataFrame:
    page = plan(cells, seed, 0.3)
    rows = [(0, y, x, *map(int, page[y, x])) for y in range(page.shape[0]) for x in range(page.shape[1])]
    return spark.createDataFrame(rows, "page_id long, y long, x long, b int, g int, r int")


def plan_images(spark: SparkSession, cells: int, pages: int) -> DataFrame:
    made = [(p, plan(cells, p, 1.0, True)) for p in range(pages)]
    return spark.createDataFrame([(p, a.shape[0], a.shape[1], bytearray(a.tobytes())) for p, a in made], "page_id long, height int, width int, data binary")
