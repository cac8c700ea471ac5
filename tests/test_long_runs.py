"""Graphs of long runs: few rounds, whatever the length; results as by brute force."""

import random

import pytest

from quarrylens.operators import graph
from test_whole_graph import _reach


def _rounds(spark, monkeypatch, make):
    made = []
    whole = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or whole(df))
    return make().collect(), len(made)


def test_long_rings_take_few_rounds(spark, monkeypatch):
    n = 200
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 3) for i in range(3)], "src long, dst long")
    got, rounds = _rounds(spark, monkeypatch, lambda: graph.strong_components(ring))
    assert {tuple(r) for r in got} == {(i, 0, n) for i in range(n)} | {(1000 + i, 1000, 3) for i in range(3)} and rounds < 60
    got, rounds = _rounds(spark, monkeypatch, lambda: graph.component_cycles(ring))
    assert {tuple(r) for r in got} == {(0, n), (1000, 3)} and rounds < 150


@pytest.mark.parametrize("seed", range(3))
def test_runs_between_other_nodes(spark, seed):
    r = random.Random(seed)
    edges, fresh = set(), 100
    for _ in range(14):  # random edges, each as a run of up to five edges
        a, b = r.randrange(8), r.randrange(8)
        for _ in range(r.randrange(5)):
            edges.add((a, fresh))
            a, fresh = fresh, fresh + 1
        edges.add((a, b))
    number = list(range(300))
    r.shuffle(number)
    edges = {(number[a], number[b]) for a, b in edges}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    far = _reach(edges)
    own = {n: {m for m in far[n] if n in far[m]} | {n} for n in far}
    want = {n: (min(x), len(x)) for n, x in own.items() if len(x) > 1}
    assert {x.node: (x.component, x.size) for x in graph.strong_components(df).collect()} == want
    cycles = {}
    for root in {c for c, _ in want.values()}:
        seen, front, d = set(), {root}, 0
        while root not in seen:
            front = {b for a, b in edges if a in front and a != b} - seen
            seen |= front
            d += 1
        cycles[root] = d
    assert {x.component: x.length for x in graph.component_cycles(df).collect()} == cycles
