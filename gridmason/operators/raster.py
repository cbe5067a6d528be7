"""Masks as relations of foreground pixels (page_id, y, x): colour ranges, neighbourhoods, line runs, connected components and what is measured on them."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import page_components

PIXEL = ("page_id", "y", "x")


def in_range(pixels: DataFrame, bands: list[tuple[list[int], list[int]]], channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """The pixels all of whose channels lie in one of the bands, ends included."""
    hit = F.lit(False)
    for low, high in bands:
        inside = F.lit(True)
        for c, lo, hi in zip(channels, low, high):
            inside = inside & F.col(c).between(lo, hi)
        hit = hit | inside
    return pixels.where(hit).select(*PIXEL)


def planes(pixels: DataFrame) -> DataFrame:
    """pixels with v (the largest channel), s (saturation, 0 to 255) and gray, rounded half to even."""
    v, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    s = F.when(v > 0, F.bround(255.0 * (v - low) / v)).otherwise(F.lit(0.0))
    return pixels.withColumn("v", v).withColumn("s", s.cast("int")).withColumn("gray", F.bround(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int"))


def hue(pixels: DataFrame) -> DataFrame:
    """pixels with v, s and h: hue in steps of two degrees, 0 to 179."""
    p = planes(pixels)
    span = F.nullif(F.greatest("b", "g", "r") - F.least("b", "g", "r"), F.lit(0))
    turn = F.when(F.col("r") == F.col("v"), (F.col("g") - F.col("b")) / span).when(F.col("g") == F.col("v"), 2 + (F.col("b") - F.col("r")) / span).otherwise(4 + (F.col("r") - F.col("g")) / span)
    return p.withColumn("h", F.coalesce(F.pmod(F.bround(30.0 * turn), F.lit(180)), F.lit(0)).cast("int"))


def hue_bands(pixels: DataFrame, k: int = 3, s_min: int = 60, v_min: int = 60, half: int = 8) -> DataFrame:
    """page_id, rank, hue, n, lo, hi: of each page up to k hues of most pixels that are saturated and bright enough, each more than `half` from those before, around the circle; of equal ones the larger.

    A page's histogram has 180 rows at most; bands end at 0 and 179.
    """
    counts = hue(pixels).where((F.col("s") >= s_min) & (F.col("v") >= v_min)).groupBy("page_id", "h").agg(F.count(F.lit(1)).alias("n"))
    order = F.reverse(F.sort_array(F.collect_list(F.struct("n", "h"))))
    far = lambda a, b: F.least(F.abs(a - b), 180 - F.abs(a - b)) > half
    none = F.array().cast("array<struct<n:bigint,h:int>>")
    take = lambda acc, x: F.when((F.size(acc) < k) & F.forall(acc, lambda p: far(p["h"], x["h"])), F.concat(acc, F.array(x))).otherwise(acc)
    peaks = counts.groupBy("page_id").agg(F.aggregate(order, none, take).alias("peaks")).select("page_id", F.posexplode("peaks").alias("i", "p"))
    return peaks.select("page_id", (F.col("i") + 1).alias("rank"), F.col("p.h").alias("hue"), F.col("p.n").alias("n"), F.greatest(F.lit(0), F.col("p.h") - half).alias("lo"), F.least(F.lit(179), F.col("p.h") + half).alias("hi"))


def _window(mask: DataFrame, kh: int, kw: int) -> DataFrame:
    """Every pixel once for each place of a kernel about it. Kernels must be odd: an even one would have no middle."""
    if kh % 2 == 0 or kw % 2 == 0:
        raise ValueError("kernel sides must be odd")
    around = lambda c, k: F.explode(F.sequence(F.col(c) - k // 2, F.col(c) + k // 2))
    return mask.select("page_id", around("y", kh).alias("y"), "x").select("page_id", "y", around("x", kw).alias("x"))


def _on_page(mask: DataFrame, height: int | None, width: int | None) -> DataFrame:
    inside = F.lit(True)
    if height is not None:
        inside = inside & F.col("y").between(0, height - 1)
    if width is not None:
        inside = inside & F.col("x").between(0, width - 1)
    return mask.where(inside)


def dilate(mask: DataFrame, kh: int = 3, kw: int | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """Pixels with a foreground pixel in the kernel about them, on the page."""
    return _on_page(_window(mask, kh, kw or kh), height, width).distinct()


def erode(mask: DataFrame, kh: int = 3, kw: int | None = None) -> DataFrame:
    """Pixels with nothing but foreground in the kernel about them; off the page is background."""
    kw = kw or kh
    full = _window(mask, kh, kw).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == kh * kw)
    return full.select(*PIXEL)


def opened(mask: DataFrame, k: int = 3, height: int | None = None, width: int | None = None) -> DataFrame:
    return dilate(erode(mask, k), k, None, height, width) if k > 1 else mask


def closed(mask: DataFrame, k: int = 3, height: int | None = None, width: int | None = None) -> DataFrame:
    return erode(dilate(mask, k, None, height, width), k) if k > 1 else mask


def color_mask(pixels: DataFrame, bands: list[tuple[list[int], list[int]]], open_k: int = 3, close_k: int = 3, height: int | None = None, width: int | None = None) -> DataFrame:
    """Range, then opening, then closing of each band; the bands' masks together."""
    masks = [closed(opened(in_range(pixels, [b]), open_k, height, width), close_k, height, width) for b in bands]
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def runs(mask: DataFrame, along: str = "x", across: str = "y") -> DataFrame:
    """page_id, the line, lo, hi, n: the longest rows of neighbouring pixels. A pixel's place less its rank on its line stays the same along a run."""
    island = F.col(along) - F.row_number().over(Window.partitionBy("page_id", across).orderBy(along))
    return mask.withColumn("island", island).groupBy("page_id", across, "island").agg(F.min(along).alias("lo"), F.max(along).alias("hi"), F.count(F.lit(1)).alias("n")).drop("island")


def line_pixels(mask: DataFrame, least: int) -> DataFrame:
    """Pixels in a horizontal or vertical run of this length at least: the opening by a line, either way."""
    flat = runs(mask, "x", "y").where(F.col("n") >= least).select("page_id", "y", F.explode(F.sequence("lo", "hi")).alias("x"))
    upright = runs(mask, "y", "x").where(F.col("n") >= least).select("page_id", F.explode(F.sequence("lo", "hi")).alias("y"), "x")
    return flat.unionByName(upright).distinct()


def label(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """page_id, y, x, label of every pixel. Pixels are joined to runs first; runs of neighbouring lines that touch are the edges, so components are found on far fewer nodes, in one pass over each page.

    A label is the number of its least run, on all pages.
    """
    reach = 1 if connectivity == 8 else 0
    line = runs(mask.select(*PIXEL).distinct())
    # a run's number: page, line and start, packed; 20 bits for each place
    line = line.withColumn("run", F.shiftleft(F.col("page_id").cast("long"), 40) + F.shiftleft(F.col("y").cast("long"), 20) + F.col("lo"))
    above = line.select("page_id", (F.col("y") + 1).alias("y"), F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("run").alias("up"))
    touching = line.join(above, ["page_id", "y"]).where((F.col("lo") <= F.col("uhi") + reach) & (F.col("ulo") <= F.col("hi") + reach)).select("page_id", F.col("run").alias("i"), F.col("up").alias("j"))
    named = page_components(line.select("page_id", F.col("run").alias("box_id"), "y", "lo", "hi"), touching)
    return named.select("page_id", "y", F.explode(F.sequence("lo", "hi")).alias("x"), F.col("comp").alias("label"))


def component_boxes(labels: DataFrame, least: int = 1, by: str = "box") -> DataFrame:
    """page_id, x1, y1, x2, y2 of each component, the far ends one beyond its last pixel. `least` bounds the box's area (by="box") or the number of pixels (by="pixels")."""
    boxes = labels.groupBy("page_id", "label").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("n"))
    size = F.col("n") if by == "pixels" else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.where(size >= least).select("page_id", "x1", "y1", "x2", "y2")


def component_stats(labels: DataFrame) -> DataFrame:
    """page_id, component (1, 2, … in order of label), x, y, w, h, area (pixels) and centroid cx, cy."""
    rows = labels.groupBy("page_id", "label").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    return rows.withColumn("component", F.dense_rank().over(Window.partitionBy("page_id").orderBy("label"))).drop("label")


def largest(labels: DataFrame, least: Column) -> DataFrame:
    """The pixels of each page's largest component, the first of equals, if it has `least` pixels."""
    sizes = labels.groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("page_id").orderBy(F.col("n").desc(), "label")
    best = sizes.withColumn("nth", F.row_number().over(first)).where((F.col("nth") == 1) & (F.col("n") >= least)).select("page_id", "label")
    return labels.join(best, ["page_id", "label"], "left_semi")


def touches_border(labels: DataFrame, height: int, width: int) -> DataFrame:
    """page_id, label of the components with a pixel on the page's border."""
    return labels.where(F.col("y").isin(0, height - 1) | F.col("x").isin(0, width - 1)).select("page_id", "label").distinct()


def inverse(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The background pixels of each page that has foreground."""
    every = mask.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    every = every.select("page_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    return every.join(mask.select(*PIXEL), list(PIXEL), "left_anti")


def fill_holes(mask: DataFrame, most: int, height: int, width: int) -> DataFrame:
    """mask, and the background components of up to `most` pixels that don't reach the border."""
    labels = label(inverse(mask, height, width), 4)
    small = labels.groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("page_id", "label")
    holes = labels.join(small, ["page_id", "label"], "left_semi").join(touches_border(labels, height, width), ["page_id", "label"], "left_anti")
    return mask.select(*PIXEL).unionByName(holes.select(*PIXEL))


def background(pixels: DataFrame, barriers: DataFrame, height: int, width: int, dense: tuple[float, float] = (0.68, 0.18), tolerance: int = 12) -> DataFrame:
    """page_id, y, x: what can be reached from the border over bright, unsaturated pixels without crossing the barriers, these dilated by a pixel. Brightness counts from 60 below the page's white.

    Where this is more than dense[0] of a page of which less than dense[1] is coloured, the page is dense: there the background is what the border reaches over pixels of nearly its own colour instead. Such a
    page is one group, an image.
    """
    from .detect import alike_background

    p = planes(pixels)
    white = p.groupBy("page_id").agg(F.count_if(F.col("s") < 25).alias("n"), F.percentile(F.when(F.col("s") < 25, F.col("v")), F.lit(0.8)).alias("q"), F.count_if(F.col("s") > 40).alias("colored"))
    level = F.greatest(F.lit(200), F.least(F.lit(255), F.when(F.col("n") > 1000, F.col("q").cast("int")).otherwise(F.lit(245)))).cast("int")
    white = white.select("page_id", level.alias("white"), (F.col("colored") < dense[1] * height * width).alias("plain"))
    walls = dilate(barriers, 3, None, height, width)
    free = p.join(white, "page_id").where((F.col("v") >= F.col("white") - 60) & (F.col("s") < 40)).select(*PIXEL)
    labels = label(free.join(walls, list(PIXEL), "left_anti"), 4)
    loose = labels.join(touches_border(labels, height, width), ["page_id", "label"], "left_semi").select(*PIXEL)
    share = loose.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    tight = share.where(F.col("n") > dense[0] * height * width).join(white.where("plain"), "page_id").select("page_id", "white")

    def run(page: pa.Table) -> pa.Table:
        y, x, *bgr, wall, seed = (page.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "b", "g", "r", "wall", "seed"))
        image, solid, seeds = np.zeros((height, width, 3), np.uint8), np.ones((height, width), bool), np.zeros((height, width), bool)
        image[y, x], solid[y, x], seeds[y, x] = np.stack(bgr, axis=1), wall, seed
        ys, xs = np.nonzero(alike_background(image, solid, seeds, tolerance))
        return pa.table({"page_id": np.full(len(ys), page.column("page_id")[0].as_py()), "y": ys, "x": xs})

    walled = walls.select(*PIXEL, F.lit(True).alias("wall"))
    rows = p.join(tight, "page_id").join(walled, list(PIXEL), "left")
    rows = rows.select(*PIXEL, "b", "g", "r", F.coalesce("wall", F.lit(False)).alias("wall"), ((F.col("s") < 40) & (F.col("v") >= F.col("white") - 50)).alias("seed"))
    kinds = loose.schema
    return loose.join(tight.select("page_id"), "page_id", "left_anti").unionByName(rows.groupBy("page_id").applyInArrow(run, "page_id long, y long, x long").select(*[F.col(f.name).cast(f.dataType) for f in kinds.fields]))


def walkway(pixels: DataFrame, height: int, width: int, low: int = 95, high: int = 205, share: float = 0.015) -> DataFrame:
    """The largest gray area of each page, if it has this share of the page."""
    gray = planes(pixels).where((F.col("s") < 30) & (F.col("v") >= low) & (F.col("v") < high)).select(*PIXEL)
    return largest(label(closed(gray, 5, height, width), 8), F.lit(share * height * width)).select(*PIXEL)


def bordered_cells(pixels: DataFrame, height: int, width: int, dark: int = 128, seal: int = 3, least: int = 1) -> DataFrame:
    """Boxes of the areas that dark lines enclose, gaps in which are sealed."""
    lines = planes(pixels).where(F.col("gray") < dark).select(*PIXEL)
    return component_boxes(label(inverse(dilate(lines, seal, None, height, width), height, width), 8), least, "pixels")


def median(pixels: DataFrame, k: int = 3, value: str = "gray", tile: int = 256) -> DataFrame:
    """page_id, y, x, median: the exact middle value of the k by k pixels about each, of those there are (the lower of two).

    Small kernels are gathered pixel by pixel. For others, pages are cut to tiles, with what lies half a kernel about them, and a tile's windows are counted by running sums, whatever their size.
    """
    if k > 5:
        return _median_by_tile(pixels, k, value, tile)
    around = lambda c: F.explode(F.sequence(F.col(c) - k // 2, F.col(c) + k // 2))
    near = pixels.select("page_id", around("y").alias("y"), "x", value).select("page_id", "y", around("x").alias("x"), value)
    middle = near.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(value)).alias("all"))
    own = pixels.select(*PIXEL)
    return own.join(middle, list(PIXEL)).select(*PIXEL, F.element_at("all", F.floor((F.size("all") + 1) / 2).cast("int")).alias("median"))


def _median_by_tile(pixels: DataFrame, k: int, value: str, tile: int) -> DataFrame:
    half = k // 2

    def run(part: pa.Table) -> pa.Table:
        page, ty, tx, y, x, v = (part.column(i).to_numpy() for i in range(6))
        top, left = ty[0] * tile - half, tx[0] * tile - half
        levels, code = np.unique(v, return_inverse=True)
        there = np.zeros((tile + 2 * half + 1, tile + 2 * half + 1), bool)
        codes = np.zeros(there.shape, np.int64)
        there[y - top, x - left], codes[y - top, x - left] = True, code

        def counted(mask: np.ndarray) -> np.ndarray:
            sums = np.pad(mask.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
            return sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]

        inner = (y - top >= half) & (y - top < half + tile) & (x - left >= half) & (x - left < half + tile)
        at = (y[inner] - top - half, x[inner] - left - half)
        wanted = (counted(there)[at] + 1) // 2
        found = np.zeros(len(wanted), np.int64)
        for bit in 1 << np.arange(int(len(levels)).bit_length())[::-1]:
            ask = found + bit
            below = np.zeros(len(found), np.int64)
            for level in np.unique(ask[ask < len(levels)]):
                own = ask == level
                below[own] = counted(there & (codes < level))[at[0][own], at[1][own]]
            found = np.where((ask < len(levels)) & (below < wanted), ask, found)
        return pa.table({"page_id": page[inner], "y": y[inner], "x": x[inner], "median": levels[found]})

    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - half) / tile)), F.floor((F.col(c) + half) / tile)))
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = pixels.select(long("page_id"), span("y").alias("ty"), long("y"), long("x"), F.col(value).cast("long").alias("v")).select("page_id", "ty", span("x").alias("tx"), "y", "x", "v")
    found = rows.groupBy("page_id", "ty", "tx").applyInArrow(run, "page_id long, y long, x long, median long")
    of = {**{c: pixels.schema[c].dataType for c in PIXEL}, "median": pixels.schema[value].dataType}
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in of.items()])


def sobel(pixels: DataFrame, height: int, width: int, value: str = "s") -> DataFrame:
    """page_id, y, x, magnitude of the gradient by 3 by 3 Sobel kernels; beyond the border its pixels repeat. Every pixel of the page must be there."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(-dx * (2 - abs(dy))).alias("wx"), F.lit(-dy * (2 - abs(dx))).alias("wy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    # each pixel asks for its neighbours, so that border pixels can ask for themselves
    asks = pixels.select(*PIXEL, F.explode(steps).alias("k")).select("page_id", F.col("y").alias("oy"), F.col("x").alias("ox"), clip(F.col("y") - F.col("k.dy"), height).alias("y"), clip(F.col("x") - F.col("k.dx"), width).alias("x"), "k")
    sums = asks.join(pixels.select(*PIXEL, value), list(PIXEL)).groupBy("page_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col(value) * F.col("k.wx")).alias("gx"), F.sum(F.col(value) * F.col("k.wy")).alias("gy"))
    return sums.select(*PIXEL, F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")).alias("magnitude"))


def shape_filter(stats: DataFrame, height: int, width: int, low: float = 8e-5, high: float = 0.06, side: int = 12, fill: float = 0.60, aspect: float = 0.14) -> DataFrame:
    """Components that look like cells: of middling size, not thin, filled, and clear of the border."""
    total, small, large = height * width, F.least("w", "h"), F.greatest("w", "h")
    clear = (F.col("x") > 2) & (F.col("y") > 2) & (F.col("x") + F.col("w") < width - 2) & (F.col("y") + F.col("h") < height - 2)
    return stats.where(F.col("area").between(low * total, high * total) & (small >= side) & clear & (F.col("area") / (F.col("w") * F.col("h")) >= fill) & (small / large >= aspect))


#: The detectors of each mode.
PASSES = {"all": ("color", "bordered", "opencv_strict"), "both": ("color", "bordered"), "color": ("color",), "bordered": ("bordered",), "geometric": ("opencv_strict",)}


def color_cells(pixels: DataFrame, bands: list[tuple[list[int], list[int]]], least: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    """Boxes of the components of a colour mask."""
    return component_boxes(label(color_mask(pixels, bands, 3, 3, height, width), 8), least)


def ensemble(mode: str = "all", **pools: DataFrame) -> DataFrame:
    """The boxes of the mode's detectors in one pool, each with its detector's name as source and that source's score. Detectors of other modes are left out."""
    from ..functions.geometry import source_score

    if mode not in PASSES:
        raise ValueError(f"mode must be one of {tuple(PASSES)}")
    sided = [boxes.select("page_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(name).alias("source")) for name, boxes in pools.items() if name in PASSES[mode]]
    return functools.reduce(DataFrame.unionByName, sided).withColumn("score", source_score(F.col("source")))
