"""Numpy kernels against plain versions, detection on drawn plans, and lines."""

import numpy as np
import pytest

from gridmason.operators import detect, raster, suppress, trails
from gridmason.sources import fixtures


@pytest.mark.parametrize("k", [3, 5, 11])
def test_median(k):
    a = np.random.default_rng(k).integers(0, 256, (17, 23))
    p = np.pad(a, k // 2, mode="edge")
    expected = [[np.sort(p[y : y + k, x : x + k].ravel())[k * k // 2] for x in range(23)] for y in range(17)]
    assert (detect.median(a, k) == np.array(expected)).all()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(connectivity):
    m = np.random.default_rng(1).random((30, 40)) < 0.45
    got = detect.components(m, connectivity)
    seen = np.zeros(m.shape, int)
    n = 0
    for start in zip(*np.nonzero(m)):
        if seen[start]:
            continue
        n += 1
        todo = [start]
        seen[start] = n
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if connectivity == 4 and dy and dx:
                        continue
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < 30 and 0 <= p[1] < 40 and m[p] and not seen[p]:
                        seen[p] = n
                        todo.append(p)
    assert got.max() == n
    assert len(np.unique(np.stack([got[m], seen[m]]), axis=1).T) == n


def test_morphology_matches_relation(spark):
    m = np.random.default_rng(2).random((20, 20)) < 0.6
    rows = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(m))], "page_id long, y long, x long")
    get = lambda f: {(r.y, r.x) for r in f.collect()}
    as_set = lambda a: {(int(y), int(x)) for y, x in zip(*np.nonzero(a))}
    assert get(raster.erode(rows, 3)) == as_set(detect.erode(m, 3))
    assert get(raster.dilate(rows, 3, None, 20, 20)) == as_set(detect.dilate(m, 3))
    assert get(raster.line_pixels(rows, 4)) == as_set(detect.opened(np.pad(m, 4), 1, 4)[4:-4, 4:-4] | detect.opened(np.pad(m, 4), 4, 1)[4:-4, 4:-4])
    with pytest.raises(ValueError):
        raster.dilate(rows, 2)


def test_plan_cells(spark):
    cells = raster.color_cells(fixtures.plan_pixels(spark, 9, 1), [fixtures.FILL], 30, None, None).collect()
    assert len(cells) == 9


def test_detector_finds_outlined_cells():
    page = fixtures.plan(12, 0, 1.0, True)
    found = detect.detect(page)
    assert len(found) >= 12


def test_spine_of_a_bar():
    points = np.array([[10, 10], [90, 10], [90, 16], [10, 16]], float)
    line = trails.centerline(points, 1, 1, trails.Settings())
    assert abs(line[:, 1].mean() - 13) < 1.5 and np.ptp(line[:, 0]) > 65


def test_simplify_and_densify():
    p = np.array([[0, 0], [5, 0.1], [10, 0], [10, 10]], float)
    assert trails.simplify(p, 1.5).tolist() == [[0, 0], [10, 0], [10, 10]]
    assert len(trails.densify_points(p[[0, 2]], 3)) == 5
    assert trails.smooth_points(np.arange(14, dtype=float).reshape(7, 2), 5)[:2].tolist() == [[0, 1], [2, 3]]


def test_detours_go():
    out = [(float(x), 0.0) for x in range(0, 100, 2)]
    back = [(98 - 2.0 * x, 1.0) for x in range(45)]
    line = trails.cut_overlaps(np.array(out + back), 6, 5.0)
    assert len(line) < len(out) + len(back)
    circle = np.array([(np.cos(a) * 50, np.sin(a) * 50) for a in np.linspace(0, 2 * np.pi, 60)])
    assert len(trails.cut_returns(circle, 35, 15.0)) < 30


def plain_bridges(segs, near, cross_near):
    free = {(s[0], e) for s in segs for e in "12"}
    group = {s[0]: s[0] for s in segs}
    out = set()
    for cross, limit in ((False, near), (True, cross_near)):
        pairs = []
        for a in segs:
            for b in segs:
                if a[0] < b[0] and (a[2] != b[2]) == cross:
                    for ea, pa in (("1", a[4:6]), ("2", a[6:8])):
                        for eb, pb in (("1", b[4:6]), ("2", b[6:8])):
                            if (d := float(np.hypot(pa[0] - pb[0], pa[1] - pb[1]))) < limit:
                                pairs.append((d, a[0], b[0], ea, eb))
        for d, i, j, ea, eb in sorted(pairs):
            if (i, ea) in free and (j, eb) in free and group[i] != group[j]:
                free -= {(i, ea), (j, eb)}
                old, new = group[j], group[i]
                group = {k: new if v == old else v for k, v in group.items()}
                out.add((i, j, ea, eb))
    return out


def test_bridges(spark):
    r = np.random.default_rng(4)
    segs = [(i, 0, int(r.integers(0, 2)), 0.5, *map(float, r.integers(0, 80, 4))) for i in range(25)]
    frame = spark.createDataFrame(segs, "seg long, page_id long, cluster long, confidence double, ax double, ay double, bx double, by_ double")
    got = {(b.seg_i, b.seg_j, b.ep_i, b.ep_j) for b in trails.find_bridges(frame, 20.0, 8.0).collect()}
    assert got == plain_bridges(segs, 20.0, 8.0)


def test_longest_chain_drops_side_branches():
    assert [s for s, _ in trails.longest_chain([1, 2, 3, 4], [(1, 2, "2", "1"), (2, 3, "2", "1"), (2, 4, "2", "1")])] in ([3, 2, 1], [4, 2, 1], [1, 2, 3], [1, 2, 4])


def test_color_clusters(spark):
    """Each page by itself: two colours on page 0, the same two and a near shade of one on page 1, a single one on page 2, two segments on page 3."""
    shades = {0: [(250, 10, 10), (10, 10, 250)], 1: [(250, 10, 10), (10, 10, 250), (245, 14, 12)], 2: [(9, 9, 9)], 3: [(250, 10, 10), (10, 10, 250)]}
    rows = [(p, i, *s[i % len(s)]) for p, s in shades.items() for i in range(2 if p == 3 else 12)]
    got = {(r.page_id, r.seg): r.cluster for r in trails.cluster_colors(spark.createDataFrame(rows, "page_id long, seg long, r int, g int, b int")).collect()}
    assert all(got[0, i] == i % 2 and got[1, i] == int(i % 3 == 1) and got[2, i] == 0 for i in range(12)) and got[3, 0] == got[3, 1] == 0


def test_silhouette_by_definition():
    r = np.random.default_rng(5)
    x, label = r.normal(size=(30, 4)), r.integers(0, 3, 30)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    each = []
    for i in range(30):
        own = d[i, (label == label[i]) & (np.arange(30) != i)].mean()
        other = min(d[i, label == k].mean() for k in range(3) if k != label[i])
        each.append((other - own) / max(own, other))
    assert trails.silhouette(x, label) == pytest.approx(np.mean(each))


def test_lines_are_left_at_the_nearest_earlier_point():
    lines = {1: np.array([(x, 0.0) for x in range(0, 100, 10)]), 2: np.array([(52.0, 3.0), (52.0, 40.0), (52.0, 90.0)])}
    assert trails.stitch([(1, "2"), (2, None)], lines)[-4:].tolist() == [[50, 0], [52, 3], [52, 40], [52, 90]]
    # turned to the nearer end, and what runs back before the meeting is left out
    lines = {1: np.array([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]), 2: np.array([(60.0, 0.0), (30.0, 0.0), (16.0, 0.0)])}
    assert trails.stitch([(1, "2"), (2, None)], lines).tolist() == [[0, 0], [10, 0], [16, 0], [30, 0], [60, 0]]
    line, more = trails.meet_forward(lines[1], np.array([(20.5, 0.0), (30.0, 0.0)]))
    assert len(line) == 3 and len(more) == 2


def test_finest_by_pixels():
    r = np.random.default_rng(6)
    low = r.integers(0, 60, (40, 2))
    b = np.concatenate([low, low + r.integers(4, 40, (40, 2))], axis=1).astype(float)
    area = np.round((b[:, 2:] - b[:, :2]).prod(axis=1) * r.uniform(0.6, 1, 40))
    kept = []
    for i in np.argsort(area, kind="stable"):
        shared = [np.prod(np.maximum(0, np.minimum(b[i, 2:], b[k, 2:]) - np.maximum(b[i, :2], b[k, :2]))) for k in kept]
        size = lambda k: np.prod(b[k, 2:] - b[k, :2])
        if not any(s / (size(i) + size(k) - s) > 0.3 for s, k in zip(shared, kept)):
            kept.append(i)
    expected = []
    for i in kept:
        x1, y1, x2, y2 = b[i].astype(int)
        grid = np.zeros((max(1, (y2 - y1) // 4), max(1, (x2 - x1) // 4)), bool)
        for k in kept:
            u1, v1, u2, v2 = b[k].astype(int)
            if area[k] < 0.9 * area[i] and min(x2, u2) > max(x1, u1) and min(y2, v2) > max(y1, v1):
                grid[(max(y1, v1) - y1) // 4 : (min(y2, v2) - y1) // 4, (max(x1, u1) - x1) // 4 : (min(x2, u2) - x1) // 4] = True
        if grid.mean() <= 0.5:
            expected.append(i)
    got = suppress.finest(b, area, 0.3, 0.5)
    assert got.tolist() == expected and 0 < len(expected) < len(kept)


def test_tilt_of_slanted_lines():
    mask = np.zeros((400, 400), bool)
    for k in range(-300, 400, 12):
        for t in range(0, 700):
            x, y = k + t * np.cos(np.radians(30)), t * np.sin(np.radians(30))
            if 0 <= x < 400 and 0 <= y < 400:
                mask[int(y), int(x)] = True
    segments = detect.line_segments(mask, 40, 20)
    angles = np.degrees(np.arctan2(segments[:, 3] - segments[:, 1], segments[:, 2] - segments[:, 0])) % 180
    assert len(segments) >= 25 and np.abs(np.median(angles) - 30) < 2
    assert abs(detect.dominant_tilt(mask, detect.Tuning()) - 30) <= 3
    upright = np.zeros((400, 400), bool)
    upright[::20] = True
    assert detect.dominant_tilt(upright, detect.Tuning()) is None and len(detect.line_segments(upright[:0], 5, 5)) == 0


def dense_page():
    """Pale gray paper around an island of a shade that is bright enough, but not nearly the paper's."""
    page = np.full((40, 60, 3), 240, np.uint8)
    page[10:14, 10:18] = 215
    page[0, 30:33] = 60
    return page


def test_background_of_dense_pages(spark):
    page = dense_page()
    v, s, _ = detect.planes(page)
    walls = detect.dilate(v < 130, 3)
    expected, todo = np.zeros(v.shape, bool), []
    for y, x in [(y, x) for x in range(60) for y in (0, 39)] + [(y, x) for y in range(40) for x in (0, 59)]:
        if walls[y, x] or expected[y, x] or s[y, x] >= 40 or v[y, x] < 190:
            continue
        todo, seed = [(y, x)], page[y, x].astype(int)
        expected[y, x] = True
        while todo:
            a, b = todo.pop()
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < 40 and 0 <= p[1] < 60 and not walls[p] and not expected[p] and np.abs(page[p].astype(int) - seed).max() <= 12:
                    expected[p] = True
                    todo.append(p)
    got = detect.page_background(page, np.zeros(v.shape, bool), detect.Tuning())
    assert (got == expected).all() and not got[11, 12] and got[20, 20]
    rows = [(p, y, x, *map(int, page[y, x])) for p in (0, 1) for y in range(40) for x in range(60)]
    pixels = spark.createDataFrame(rows, "page_id long, y long, x long, b int, g int, r int")
    found = raster.background(pixels, raster.planes(pixels).where("v < 130").select("page_id", "y", "x"), 40, 60)
    assert {(r.page_id, r.y, r.x) for r in found.collect()} == {(p, int(y), int(x)) for p in (0, 1) for y, x in zip(*np.nonzero(expected))}


def test_walkway_matches_the_detector(spark):
    page = np.full((40, 60, 3), 250, np.uint8)
    page[5:9, 5:50] = 150
    page[20:30, 10:20] = 151
    page[24, 20:24] = (150, 40, 40)
    pixels = spark.createDataFrame([(0, y, x, *map(int, page[y, x])) for y in range(40) for x in range(60)], "page_id long, y long, x long, b int, g int, r int")
    expected = detect.walkway(page, detect.Tuning())
    assert {(r.y, r.x) for r in raster.walkway(pixels, 40, 60).collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(expected))}
    assert expected.sum() == 180


@pytest.mark.parametrize("k, tile", [(7, 16), (9, 256), (7, 5)])
def test_median_by_tile(spark, k, tile):
    """Pixels missing, values beyond a byte, tiles smaller than the page and the kernel."""
    r = np.random.default_rng(k)
    there = {(int(y), int(x)): int(r.integers(0, 900)) for y in range(30) for x in range(40) if r.random() < 0.7}
    rows = spark.createDataFrame([(3, y, x, v) for (y, x), v in there.items()], "page_id long, y int, x int, gray int")
    got = {(m.y, m.x): m.median for m in raster.median(rows, k, tile=tile).collect()}
    h = k // 2
    for (y, x), _ in there.items():
        near = sorted(there[p] for p in ((y + a, x + b) for a in range(-h, h + 1) for b in range(-h, h + 1)) if p in there)
        assert got[y, x] == near[(len(near) + 1) // 2 - 1]
    assert len(got) == len(there)


def test_modes(spark):
    boxes = spark.createDataFrame([(0, 1, 2, 3, 4)], "page_id long, x1 int, y1 int, x2 int, y2 int")
    got = raster.ensemble("both", color=boxes, bordered=boxes, opencv_strict=boxes)
    assert sorted((r.source, r.score, r.x2) for r in got.collect()) == [("bordered", 0.45, 3.0), ("color", 0.75, 3.0)]
    with pytest.raises(ValueError):
        raster.ensemble("none", color=boxes)
