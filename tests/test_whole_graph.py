"""Graph queries over all edges, against brute force."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from quarrylens.operators import graph

SF = "/root/testdata/sf0.001"


def _reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    far = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        far[n] = seen
    return far


def _check(components, dependents, edges):
    far = _reach(edges)
    want = {}
    for n in far:
        own = {m for m in far[n] if n in far[m]} | {n}
        if len(own) > 1:
            want[n] = (min(own), len(own))
    assert {r.node: (r.component, r.size) for r in components} == want
    count = {n: sum(n in far[m] for m in far if m != n) for n in far}
    assert {r.node: r.n_dependents for r in dependents} == {n: k for n, k in count.items() if k}


@pytest.mark.parametrize("seed", [1])
def test_components_and_dependents(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(16), r.randrange(16)) for _ in range(22)} | {(50, 50)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    _check(graph.strong_components(df).collect(), graph.dependents(df).collect(), edges)
    assert graph.strong_components(df.limit(0)).count() == 0 and graph.dependents(df.limit(0)).count() == 0


def test_whole_queries(spark):
    import __spark_entry__ as e

    customer = dict(zip(*(pq.read_table(f"{SF}/orders.parquet").column(c).to_pylist() for c in ("o_orderkey", "o_custkey"))))
    t = pq.read_table(f"{SF}/lineitem.parquet")
    edges = set()
    for o, s, p in zip(*(t.column(c).to_pylist() for c in ("l_orderkey", "l_suppkey", "l_partkey"))):
        c, p = customer[o] + 10**10, p + 2 * 10**10
        edges |= {(c, s), (s, p), (p, c)}
    run = lambda name: e.queries()[name](spark, SF).collect()
    _check(run("r02_strong_components_whole"), run("r05_transitive_dependents_whole"), edges)
    near, out = defaultdict(set), defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
        out[a].add(b)
    assert {r.node: r.n for r in run("r07_neighbours_whole")} == {n: len(x) for n, x in near.items()}
    cycles = sum((c, s) in edges for s in out if s < 10**10 for p in out[s] for c in out[p])
    assert [tuple(r) for r in run("r04_simple_cycles_whole")] == [(3, cycles)]
    assert {r.node: r.level for r in run("r09_levels_whole")} == {n: 0 if n >= 10**10 and n < 2 * 10**10 else 1 if n < 10**10 else 2 for n in near}
    assert [tuple(r) for r in run("r10_critical_path_whole")] == [(2, min(n for n in near if n >= 2 * 10**10))]
    ce = {n: len(out[n]) for n in near}
    ca = {n: len(near[n]) - sum(n != m and m in out[n] and n not in out[m] for m in near[n]) for n in near}
    assert {r.node: (r.ce, r.ca, r.instability) for r in run("g26_instability_whole")} == {n: (ce[n], ca[n], round(ce[n] / (ce[n] + ca[n]), 6)) for n in near}
    least = max(6, int(1.2 * sum(ce[n] + ca[n] for n in near) / len(near)))
    assert {r.node for r in run("g27_god_modules_whole")} == {n for n in near if ca[n] >= 2 and ce[n] >= 2 and ca[n] + ce[n] >= least}
    v = {n: ce[n] / (ce[n] + ca[n]) for n in near}
    assert {(r.src, r.dst) for r in run("j35_unstable_dependencies_whole")} == {(a, b) for a, b in edges if v[b] > v[a] + 0.01}
