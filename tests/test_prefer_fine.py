"""prefer_fine against loops over each page, in parts of every size."""

import numpy as np
import pyarrow as pa
import pytest

from gridmason.operators import suppress
from gridmason.plans import catalog

SHAPES = "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double, area double, note string"


def boxes(n, pages, seed, side=60):
    r = np.random.default_rng(seed)
    low = r.integers(-side, 5 * side, (n, 2))
    b = np.concatenate([low, low + r.integers(0, 2 * side, (n, 2))], axis=1).astype(float)
    area = np.round((b[:, 2:] - b[:, :2]).prod(axis=1) * r.uniform(0.6, 1, n))
    return r.integers(0, pages, n), b, area


def test_prefer_fine_by_pages(spark):
    page, b, area = boxes(1500, 6, 1)
    rows = [(int(p), i, *map(float, c), float(a), f"n{i}") for i, (p, c, a) in enumerate(zip(page, b, area))]
    odd = [(None, 9000, 0.0, 0.0, 90.0, 90.0, 1.0, "x"), (0, None, 0.0, 0.0, 90.0, 90.0, 1.0, "y"), (1, 9001, None, 0.0, 90.0, 90.0, 1.0, "z"), (77, 1, 0.0, 0.0, 8.0, 8.0, None, "t"), (77, 2, 0.0, 0.0, 8.0, 8.0, 4.0, "u")]
    got = suppress.prefer_fine(spark.createDataFrame(rows + odd, SHAPES).repartition(5), 0.3, 0.5).collect()
    expected = []
    for p in range(6):
        of = np.flatnonzero(page == p)
        expected += of[suppress.finest(b[of], area[of], 0.3, 0.5)].tolist()
    # what has no page, no id or a missing corner meets nothing; a shape without an area comes last
    assert sorted(r.note for r in got) == sorted([*(f"n{i}" for i in expected), "x", "y", "z", "u"])
    assert 0 < len(expected) < 1500
    assert suppress.prefer_fine(spark.createDataFrame([], SHAPES)).count() == 0


@pytest.mark.parametrize("pairs, cells, band, block", [(1, 1, 7, 1), (50, 300, 16, 20), (1 << 19, 1 << 22, 128, 1 << 12)])
def test_parts_of_every_size(monkeypatch, pairs, cells, band, block):
    monkeypatch.setattr(suppress, "PAIRS", pairs)
    monkeypatch.setattr(suppress, "CELLS", cells)
    monkeypatch.setattr(suppress, "BAND", band)
    monkeypatch.setattr(suppress, "BLOCK", block)
    page, b, area = boxes(120, 2, 2, 30)
    there = (b[:, :2] < b[:, 2:]).all(axis=1)
    page, b, area = page[there], b[there], area[there]
    left, right = np.arange(0, len(b), 3), np.arange(0, len(b), 2)
    met = [pair for i, j in suppress.crossing(page, b, left, right) for pair in zip(i.tolist(), j.tolist())]
    shared = suppress.overlap_matrix(b)[0]
    assert sorted(met) == [(i, j) for i in left.tolist() for j in right.tolist() if page[i] == page[j] and shared[i, j] > 0]
    for p in range(2):
        of = np.flatnonzero(page == p)
        kept = of[suppress.fewest(page[of], b[of], np.argsort(area[of], kind="stable"), 0.3)]
        stay = kept[~suppress.covered(page[kept], b[kept], area[kept], 0.5, 4)]
        assert stay.tolist() == sorted(of[suppress.finest(b[of], area[of], 0.3, 0.5)].tolist()) and len(stay) < len(kept) < len(of)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_whole_pages(size):
    page = pa.array([None, None, 1, 2, 2, 2, 2, 2, 3, 5, 5], pa.int64())
    table = pa.table({"page_id": page, "n": pa.array(range(11))})
    parts = list(suppress.whole_pages(iter(table.to_batches(max_chunksize=size))))
    assert pa.concat_tables(parts).equals(table)
    seen = [set(p.column("page_id").to_pylist()) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen)) == 5


def test_prefer_fine_is_dealt_out_once(spark, data):
    plan = catalog.QUERIES["prefer_fine"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan and "Join" not in plan
