"""Areas and overlaps of convex polygons, given as arrays of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_area(points: Column) -> Column:
    """The area of a polygon whose points are arrays [x, y], by the shoelace formula; 0 for fewer than three points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(F.lit(0.0))


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon within a convex one, cut by one edge of the latter after the other."""
    if signed_area(window) < 0:
        window = window[::-1]
    out = subject
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for p, q, sp, sq in zip(out, np.roll(out, -1, axis=0), side, np.roll(side, -1)):
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                kept.append(p + (q - p) * (sp / (sp - sq)))
        out = np.array(kept).reshape(-1, 2)
    return out


def shared_area(one, other) -> float:
    a, b = (np.array([list(p) for p in x], float).reshape(-1, 2) for x in (one if one is not None else [], other if other is not None else []))
    if len(a) < 3 or len(b) < 3:
        return 0.0
    part = clip(a, b)
    return abs(signed_area(part)) if len(part) >= 3 else 0.0


def intersection_area(one: Column, other: Column) -> Column:
    """The area that two convex polygons share; 0 for fewer than three points."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_area(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, "double")(one, other)


def polygon_overlap(one: Column, other: Column) -> Column:
    """A struct of iou and ios: the shared area over the union's, and over the smaller polygon's."""
    shared, a, b = intersection_area(one, other), polygon_area(one), polygon_area(other)
    over = lambda whole: F.when((shared > 0) & (whole > 0), shared / whole).otherwise(F.lit(0.0))
    return F.struct(over(a + b - shared).alias("iou"), over(F.least(a, b)).alias("ios"))
