"""Betweenness in batches of sources against counting paths in Python."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from lodestone.operators import graph


def scalar(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    nodes = {x for e in edges for x in e}
    steps, paths = {}, {}
    for s in nodes:
        steps[s], paths[s], queue = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in steps[s]:
                    steps[s][y] = steps[s][x] + 1
                    queue.append(y)
                if steps[s][y] == steps[s][x] + 1:
                    paths[s][y] += paths[s][x]
    far = 10**9
    through = {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in nodes for t in steps[s] if len({s, t, v}) == 3 and steps[s].get(v, far) + steps[v].get(t, far) == steps[s][t]) for v in nodes}
    return {v: x / ((len(nodes) - 1) * (len(nodes) - 2)) for v, x in through.items()}


@pytest.mark.parametrize("batch", [10_000, 9])
def test_batches_of_sources_equal_counting_paths(spark, batch):
    draw = random.Random(9)
    edges = [(draw.randrange(14), draw.randrange(14)) for _ in range(22)] + [(20, 21), (21, 22), (21, 21), (20, 21)]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(edges, "src int, dst int"), batch).collect()}
    expected = scalar(edges)
    assert set(got) == set(expected) and all(got[v] == pytest.approx(expected[v]) for v in expected)


def test_nodes_with_the_same_neighbours_are_one_source(spark, monkeypatch):
    draw = random.Random(4)
    edges = [(k, 100 + k % 3) for k in range(60)] + [(k, 103 + k % 2) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (103, 200), (300, 300), (301, 301)] + [(400 + draw.randrange(6), 400 + draw.randrange(6)) for _ in range(8)]
    taken = []
    whole = graph._dependencies
    monkeypatch.setattr(graph, "_dependencies", lambda sources, near: taken.append(sources.count()) or whole(sources, near))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(edges, "src int, dst int")).collect()}
    expected = scalar(edges)
    assert set(got) == set(expected) and all(got[v] == pytest.approx(expected[v]) for v in expected)
    assert sum(taken) < 22 < len(expected)
