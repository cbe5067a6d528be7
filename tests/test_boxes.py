"""Greedy operators against plain loops, and their semantics at the edges."""

import random

import numpy as np
import pytest

from gridmason.operators import labels, overlap, regions, suppress
from gridmason.operators.graph import components, union_find
from gridmason.sources import fixtures

POOL = "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double, source string"


def made(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 60), r.randint(0, 60)
        out.append((i % 2, i, float(x), float(y), float(x + r.randint(3, 30)), float(y + r.randint(3, 30)), r.choice([0.45, 0.75, 1.0]), r.choice(["bordered", "color", "opencv_strict"])))
    return out


def area(b):
    return max(0, b[4] - b[2]) * max(0, b[5] - b[3])


def shared(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def iou(a, b):
    union = area(a) + area(b) - shared(a, b)
    return shared(a, b) / union if union > 0 else 0.0


def ios(a, b):
    least = min(area(a), area(b))
    return shared(a, b) / least if least > 0 else 0.0


def is_block(big, pool):
    inner = [s for s in pool if area(s) < area(big) and ios(s, big) > 0.8]
    thin = any(max(s[4] - s[2], s[5] - s[3]) / max(1.0, min(s[4] - s[2], s[5] - s[3])) > 2.5 and area(s) < 15000 for s in inner)
    return len(inner) >= 2 and sum(ios(s, big) * area(s) for s in inner) >= 0.75 * area(big) and not thin


def plain_nms(pool, t, c):
    slots = []
    for b in sorted([b for b in pool if not is_block(b, pool)], key=lambda b: (-b[6], -area(b), b[1])):
        swap, drop = None, False
        for k, o in enumerate(slots):
            if iou(b, o) > t or ios(b, o) > c and area(b) <= area(o):
                drop = True
                break
            if ios(b, o) > c:
                swap = k
        if drop:
            continue
        if swap is None:
            slots.append(b)
        else:
            slots[swap] = b
    return {b[1] for b in slots}


@pytest.mark.parametrize("seed", range(3))
def test_nms_exact(spark, seed):
    pool = made(120, seed)
    got = {r.box_id for r in suppress.nms_exact(spark.createDataFrame(pool, POOL), 0.3, 0.7).collect()}
    assert got == set().union(*[plain_nms([b for b in pool if b[0] == p], 0.3, 0.7) for p in (0, 1)])


def test_cluster_is_near_greedy(spark):
    pool = fixtures.box_pool(spark, 400, 3).cache()
    greedy = {r.box_id for r in suppress.nms_exact(pool).collect()}
    cluster = {r.box_id for r in suppress.nms_cluster(pool).collect()}
    assert len(greedy & cluster) / len(greedy | cluster) >= 0.8, (len(greedy), len(cluster))


def test_drop_contained(spark):
    pool = made(100, 5)
    kept = []
    for b in sorted(pool, key=lambda b: (-area(b), b[1])):
        if not any(o[0] == b[0] and ios(b, o) >= 0.6 and area(o) > area(b) for o in kept):
            kept.append(b)
    frame = suppress.drop_contained(spark.createDataFrame(pool, POOL))
    assert {r.box_id for r in frame.collect()} == {b[1] for b in kept}
    assert {r.box_id for r in suppress.drop_contained(frame).collect()} == {b[1] for b in kept}


def test_recover_uncovered(spark):
    pool = made(80, 7)
    kept = [b for b in pool if b[7] == "opencv_strict"]
    cell = lambda b: (int((b[2] + b[4]) / 2 // 400), int((b[3] + b[5]) / 2 // 400))
    have, back = list(kept), set()
    for b in pool:
        if b[7] != "bordered":
            continue
        near = [o for o in have if o[0] == b[0] and max(abs(x - y) for x, y in zip(cell(o), cell(b))) <= 1]
        if not any(iou(b, o) >= 0.4 or shared(b, o) / area(b) >= 0.6 for o in near):
            have.append(b)
            back.add(b[1])
    got = regions.recover_uncovered(spark.createDataFrame(pool, POOL), spark.createDataFrame(kept, POOL))
    assert {r.box_id for r in got.collect()} == back


def test_recover_missing(spark):
    r = random.Random(2)
    items = [(0, i, f"F{i}" if i % 3 else "words only here", float(x := r.randint(0, 400)), float(y := r.randint(0, 400)), float(x + 20), float(y + 10)) for i in range(60)]
    boxes = [(0, 0, 0.0, 0.0, 100.0, 100.0, 1.0, "color")]
    have, expected = [(0.0, 0.0, 100.0, 100.0)], set()
    for _, i, text, x0, y0, x1, y1 in items:
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        if i % 3 and not any(a <= cx <= c and b <= cy <= d for a, b, c, d in have):
            expected.add(i)
            have.append((cx - 30, cy - 30, cx + 30, cy + 30))
    got = labels.recover_missing(spark.createDataFrame(boxes, POOL), spark.createDataFrame(items, "page_id long, span_id long, text string, x0 double, y0 double, x1 double, y1 double"))
    assert {r.span_id for r in got.collect()} == expected


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_union_find():
    assert union_find(6, np.array([5, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 4, 1]


def test_empty_pool(spark):
    empty = spark.createDataFrame([], POOL)
    assert suppress.nms_cluster(empty).count() == 0
    assert suppress.nms_exact(empty).count() == 0
    assert overlap.match_rate(empty, empty).first().rate == 1.0
    assert overlap.jaccard(empty, empty).first().jaccard == 1.0


def test_degenerate_boxes(spark):
    pool = spark.createDataFrame([(0, 1, 5.0, 5.0, 5.0, 9.0, 1.0, "color"), (0, 2, 5.0, 5.0, 9.0, 9.0, 1.0, "color"), (0, 3, 9.0, 9.0, 5.0, 5.0, 1.0, "color")], POOL)
    assert overlap.overlap_pairs(pool).count() == 0
    assert {r.box_id for r in suppress.nms_exact(pool).collect()} == {1, 2, 3}
