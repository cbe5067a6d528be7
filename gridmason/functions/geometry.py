"""Column expressions over boxes given as corners: x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score that each detector's boxes carry.
SOURCE_SCORE = {"opencv_strict": 1.0, "color": 0.75, "bordered": 0.45, "bigregion": 1.0}


@dataclass(frozen=True)
class Box:
    """The four corner columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y2 - self.y1)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def holds(self, x: Column, y: Column) -> Column:
        """The point lies in the box, its edges included."""
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap_area(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def overlaps(a: Box, b: Box) -> Column:
    """The boxes share an area: the residual predicate of overlap joins."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def iou(a: Box, b: Box) -> Column:
    shared = overlap_area(a, b)
    return ratio(shared, a.area + b.area - shared)


def ios_min(a: Box, b: Box) -> Column:
    """Shared area over that of the smaller box."""
    return ratio(overlap_area(a, b), F.least(a.area, b.area))


def ios_self(a: Box, b: Box) -> Column:
    """Shared area over that of the first box."""
    return ratio(overlap_area(a, b), a.area)


def skinny(b: Box) -> Column:
    """A long thin box of small area, as a slice of text is."""
    return (F.greatest(b.width, b.height) / F.greatest(F.lit(1.0), F.least(b.width, b.height)) > 2.5) & (b.area < 15000)


def source_score(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_SCORE.items() for x in kv])
    return F.coalesce(F.element_at(known, source), F.lit(1.0))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def ring(b: Box) -> Column:
    """The closed outline, as five points."""
    return F.array(F.array(b.x1, b.y1), F.array(b.x2, b.y1), F.array(b.x2, b.y2), F.array(b.x1, b.y2), F.array(b.x1, b.y1))


def clipped(b: Box, crop_w: Column, crop_h: Column, left: Column, top: Column, page_w: Column, page_h: Column, edge: int = 4) -> Column:
    """A crop's box touches an inner edge of the crop; edges on the page's own border don't count."""
    return ((b.x1 <= edge) & (left > 0)) | ((b.x2 >= crop_w - edge) & (left + crop_w < page_w)) | ((b.y1 <= edge) & (top > 0)) | ((b.y2 >= crop_h - edge) & (top + crop_h < page_h))


def under_cap(b: Box, crop_w: Column, crop_h: Column, share: float) -> Column:
    """A crop's box takes no more than this share of the crop; no limit if the share isn't positive."""
    return b.area <= share * crop_w * crop_h if share > 0 else F.lit(True)


def on_page(b: Box, left: Column, top: Column) -> Box:
    """A crop's box in the page's coordinates."""
    return Box(b.x1 + left, b.y1 + top, b.x2 + left, b.y2 + top)


def area_floor(min_area: int, share: float, crop_w: Column, crop_h: Column) -> Column:
    """The least area of a component: a share of the crop, rounded half to even, but min_area at least."""
    return F.greatest(F.lit(min_area), F.bround(F.lit(share) * crop_w * crop_h)).cast("long") if share > 0 else F.lit(min_area).cast("long")


def tile_starts(extent: Column, tile: int, step: int) -> Column:
    """Where tiles begin, so that the last reaches the end and no tile is needless."""
    return F.when(extent <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (F.ceil((extent - tile) / step) * step).cast("long"), F.lit(step).cast("long")))


def tile_starts_plain(extent: Column, step: int) -> Column:
    """Where tiles begin, one at each step short of the end, as the text reader cuts pages."""
    return F.sequence(F.lit(0).cast("long"), (extent - 1).cast("long"), F.lit(step).cast("long"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest place of a segment, its ends included."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length2 < 1e-12, F.lit(1.0)).otherwise(length2)))
    return F.when(length2 < 1e-12, distance(px, py, ax, ay)).otherwise(distance(px, py, ax + t * dx, ay + t * dy))


def to_pixel(value: Column, scale: Column) -> Column:
    """A coordinate in pixels, cut toward zero."""
    return (value * scale).cast("int")
