"""Queries over every page of a made-up table, against plain versions."""

import numpy as np
from pyspark.sql import functions as F
from test_rasters_and_trails import plain_bridges

from gridmason.operators import trails
from gridmason.plans import catalog
from gridmason.sources.views import view


def plain_trails(preds, clusters, w, h):
    """The trails of a page, with every pair of ends tried: (segments, points)."""
    s = trails.Settings()
    near = float(np.hypot(w, h)) * s.merge_ratio
    lines = {i: x for i, p in enumerate(preds) if len(x := trails.centerline(np.array(p, float), 1.0, 1.0, s)) >= 2}
    found = plain_bridges([(i, 0, clusters[i], 0.0, *map(float, x[0]), *map(float, x[-1])) for i, x in lines.items()], near, max(s.cross_least, near * s.cross_ratio))
    group = {i: {i} for i in lines}
    for i, j, _, _ in found:
        both = group[i] | group[j]
        group |= {k: both for k in both}
    out = set()
    for members in {tuple(sorted(g)) for g in group.values()}:
        line = lines[members[0]]
        if len(members) > 1:
            line = trails.stitch(trails.longest_chain(list(members), sorted(b for b in found if b[0] in members)), lines)
            line = trails.smooth_points(trails.densify_points(line, s.gap), s.window)
        line = trails.cut_returns(line, 35, max(10.0, near * 0.10))
        line = trails.densify_points(trails.cut_overlaps(line, s.lookback, max(s.overlap_least, near * s.overlap_ratio)), s.gap)
        if len(line) >= s.least_points:
            out.add(members)
    return out


def test_merged_trails_of_every_page(spark, tmp_path):
    spark.range(1, 600).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    pages = {}
    for r in view(spark, str(tmp_path), "segments").orderBy("seg").collect():
        a, b = (r.ax + 100, r.ay + 100), (r.bx + 220, r.by_ + 120)
        pages.setdefault(r.page_id, []).append((r.seg, r.cluster, [a, b, (b[0] + 6, b[1] + 14), (a[0] + 6, a[1] + 14)]))
    expected = {(page, tuple(rows[i][0] for i in group)) for page, rows in pages.items() for group in plain_trails([x[2] for x in rows], [x[1] for x in rows], 900, 700)}
    got = {(r.page_id, tuple(sorted(r.segments))) for r in catalog.merged_trails(spark, str(tmp_path)).collect()}
    assert len(pages) == 20 and {p for p, _ in got} == set(pages)
    assert got == expected


def shade(y, x, page):
    return (x * x + y * 3) % 256, (y * 13 + x * 53) % 256, (y * 37 + x * 11 + page * 5) % 256


def plain_features(r, g, b):
    import colorsys

    h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
    return np.array([np.cos(2 * np.pi * h) * s, np.sin(2 * np.pi * h) * s, s, v])


def test_color_clusters_of_every_page(spark, tmp_path):
    """Pixels of a few colours far apart on every page, eight or so of each, among shades that differ by a step: on each page a cluster for each colour."""
    rows, colors = [], {}
    places = sorted((y, x) for y in range(40) for x in range(60))
    apart = lambda p, q: np.linalg.norm(np.subtract(p, q))
    for page in range(0, 2560, 256):
        base: list = []
        for y, x in places:
            if len(base) < 4 and all(apart(plain_features(*shade(y, x, page)), plain_features(*shade(*q, page))) > 0.9 and apart(shade(y, x, page), shade(*q, page)) > 0.4 * 255 for q in base):
                base.append((y, x))
        for k, q in enumerate(base):
            near = [p for p in places if apart(plain_features(*shade(*p, page)), plain_features(*shade(*q, page))) < 0.12][:8]
            for y, x in near:
                colors[page * 2400 + y * 60 + x] = (page, k)
                rows.append((page * 100, x, 0, y * 27 % 40))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.seg: (r.page_id, r.cluster) for r in catalog.color_clusters(spark, str(tmp_path)).collect()}
    assert set(got) == set(colors) and len({p for p, _ in colors.values()}) == 10
    pairs = {(colors[s], got[s]) for s in got}
    assert len(pairs) == len(set(colors.values())) == len(set(got.values()))


def test_recover_missing_over_all_boxes(spark, data):
    from gridmason.functions.text import is_boothlike

    pool = view(spark, data, "box_pool").collect()
    spans = view(spark, data, "text_items").withColumn("like", is_boothlike(F.col("text"))).orderBy("page_id", "span_id").collect()
    new = []
    for t in spans:
        cx, cy = (t.x0 + t.x1) / 2, (t.y0 + t.y1) / 2
        held = any(b.page_id == t.page_id and b.x1 <= cx <= b.x2 and b.y1 <= cy <= b.y2 for b in pool)
        if t.like and not held and not any(p == t.page_id and x1 <= cx <= x2 and y1 <= cy <= y2 for p, _, x1, y1, x2, y2 in new):
            w, h = max(60.0, 1.6 * (t.x1 - t.x0)) / 2, max(60.0, 2.2 * (t.y1 - t.y0)) / 2
            new.append((t.page_id, t.span_id, cx - w, cy - h, cx + w, cy + h))
    got = {(r.page_id, r.span_id, r.x1, r.y1, r.x2, r.y2) for r in catalog.recover_missing(spark, data).collect()}
    assert got == set(new)


def test_components_of_all_pixels(spark, data):
    """The operators of the five component queries over the whole view, which their SQL doesn't take."""
    from gridmason.operators import raster

    pixels = view(spark, data, "pixels").cache()
    left = {(r.page_id, r.y, r.x) for r in pixels.collect()}
    every, parts = set(left), {}
    for start in sorted(every):
        if start not in left:
            continue
        left.discard(start)
        todo, own = [start], []
        while todo:
            p, y, x = todo.pop()
            own.append((p, y, x))
            near = {(p, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        parts[start[0], (start[0] << 40) + (start[1] << 20) + start[2]] = own
    label = raster.label(pixels, 8).cache()
    assert {(r.page_id, r.y, r.x, r.label) for r in label.collect()} == {(*c, k[1]) for k, own in parts.items() for c in own}
    assert max(map(len, parts.values())) > 20

    bounds = lambda own: (min(c[2] for c in own), min(c[1] for c in own), max(c[2] for c in own) + 1, max(c[1] for c in own) + 1)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    boxes = sorted((k[0], *bounds(own)) for k, own in parts.items() if area(bounds(own)) >= 4)
    assert sorted((r.page_id, r.x1, r.y1, r.x2, r.y2) for r in raster.component_boxes(label, 4).collect()) == boxes
    stats = sorted((k[0], b[0], b[1], b[2] - b[0], b[3] - b[1], len(own)) for k, own in parts.items() for b in [bounds(own)])
    assert sorted((r.page_id, r.x, r.y, r.w, r.h, r.area) for r in raster.component_stats(label).collect()) == stats
    best = {}
    for (p, k), own in sorted(parts.items()):
        if len(own) >= 5 and len(own) > len(best.get(p, [])):
            best[p] = own
    assert {(r.page_id, r.y, r.x) for r in raster.largest(label, F.lit(5)).collect()} == {c for own in best.values() for c in own}
    edge = {k for k, own in parts.items() if any(c[1] in (0, 39) or c[2] in (0, 59) for c in own)}
    assert {(r.page_id, r.label) for r in raster.touches_border(label, catalog.HEIGHT, catalog.WIDTH).collect()} == edge
