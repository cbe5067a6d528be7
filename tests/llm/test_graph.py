"""Components of edge tables: dense groups, in parts of every size."""

import random

import pyarrow as pa
import pytest

from gridmason.llm import graph


def least_reached(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("together", [1, 7, 1 << 20])
def test_spanning_stars_connect_the_same(together):
    r = random.Random(4)
    edges = [(a, b) for a, b in ((r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(70)) if a != b]
    batches = pa.table({"a": [a for a, _ in edges], "b": [b for _, b in edges]}).to_batches(max_chunksize=9)
    parts = list(graph._spanning(together)(iter(batches)))
    assert all(p.num_rows <= together for p in parts)
    kept = [(a, b) for p in parts for a, b in zip(p.column(0).to_pylist(), p.column(1).to_pylist())]
    assert least_reached(kept) == least_reached(edges) and all(a > b for a, b in kept)
    if together > len(edges):
        assert len(kept) == len(set(least_reached(edges))) - len(set(least_reached(edges).values()))


@pytest.mark.parametrize("together", [500, 1 << 20])
def test_dense_groups_give_the_rounds_few_edges(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    seen, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda edges, large: (seen.append(edges.count()), star(edges, large))[1])
    group = [(i + 100 * g, j + 100 * g) for g in range(2) for i in range(60) for j in range(60)] + [(500 + i, 501 + i) for i in range(40)]
    got = graph.components(spark.createDataFrame([*group, (None, 1)], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i + 100 * g: 100 * g for g in range(2) for i in range(60)}, **{500 + i: 500 for i in range(41)}}
    assert len(got) == 161 and seen[0] <= (158 if together > 3640 else 158 * 8)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
