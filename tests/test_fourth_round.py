"""Cases of the fourth round's findings."""

import numpy as np

from quarrylens.operators import semantic, vector_index
from quarrylens.plans.index_queries import shared


def _metrics(df, kind, name):
    """A metric of all operators of one kind in a collected DataFrame's plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        inner = {"AdaptiveSparkPlan": "executedPlan"}.get(p.nodeName()) or ("plan" if p.nodeName().endswith("QueryStage") else None)
        if inner:
            todo.append(getattr(p, inner)())
            continue
        if kind in p.nodeName() and p.metrics().contains(name):
            found.append(p.metrics().apply(name).value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_structures_are_compared_once_for_each_two_kinds(spark):
    """Copies: each pair of them met each 3-gram of both, though their multisets are one."""
    a, b = ([f"{x}{i} B{i} C{i}" for i in range(60)] for x in "AD")
    rows = [(f"f{i:03d}", f"load_{'x' if i < 100 else 'y'}", a if i < 100 else b) for i in range(200)] + [("g", "load_x", a[:45])]
    out = semantic.semantic_duplicates(spark.createDataFrame(rows, "key string, name string, ngrams array<string>"), "key", shared(spark, "t"), least=0.5)
    got = [tuple(r)[:2] + (round(r.structure, 6),) for r in out.collect()]
    # The lone one is near those of whole bodies; its neighbours are the first of them. The others find copies alone.
    assert got and all(b == "g" and s == 0.75 for _, b, s in got)
    assert max(_metrics(out, "Join", "numOutputRows")) < 2000


def test_searches_shuffle_each_query_once(spark, tmp_path):
    """Before, a query's vector was shuffled once for each list that it reads."""
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8))
    e = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, v array<double>")
    index = vector_index.build_index(e, "vec_id", "v", f"file://{tmp_path}/index", lists=30)
    out = vector_index.search_index(index, e, "vec_id", "v", 3, exact=True)
    got = {(q.query, q.id) for q in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(f"k{i:03d}", f"k{j:03d}") for i in range(600) for j in np.argsort(-s[i])[:3]}
    assert max(_metrics(out, "Exchange", "shuffleRecordsWritten")) <= 600


def test_documents_are_scanned_once_whatever_the_number_of_keys(spark, monkeypatch):
    """Before, each block of keys was a pass over the documents."""
    from quarrylens.llm import collocations

    monkeypatch.setattr(collocations, "BLOCK_KEYS", 5)
    monkeypatch.setattr(collocations, "PASS_KEYS", 5)
    monkeypatch.setattr(collocations, "HELD_CELLS", 7)
    kind, passes = type(spark.range(1)), []
    inner = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (passes.append(1), inner(self, *a, **b))[1])
    rows = [(f"w{i % 9} of w{i % 7} and, w{i % 9} of\n{'only' * (i == 3)}", "en" if i % 3 else None) for i in range(90)] + [("..", "xx"), (None, "en")]
    got = [tuple(r)[:7] for r in collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=10).collect()]
    assert len(passes) == 3
    count = lambda lang, phrase: sum(f" {phrase} " in f" {piece} " for t, x in rows[:90] if (x or "und") == lang for piece in t.replace("\n", ",").split(","))
    assert {r[2] for r in got} >= {"w1 of"} and all((a, n) == (count(lang, phrase), sum(len(t.replace(",", " ").split()) for t, x in rows[:90] if (x or "und") == lang)) for lang, _, phrase, a, _, _, n in got)


def test_large_sets_are_told_apart_before_they_are_moved(spark):
    """Sets of 1,500 words that share a third: 512 bits can't tell them apart. One near pair, and a group of near copies."""
    import random

    from pyspark.sql import functions as F

    from quarrylens.operators import joins

    r = random.Random(8)
    sets = {i: set(r.sample(range(3000), 1500)) for i in range(60)}
    sets |= {100 + i: (sets[0] - set(r.sample(sorted(sets[0]), 20))) | {5000 + i} for i in range(70)} | {200: set(sorted(sets[1])[: 1500 - 250]), 201: {7}, 202: set()}
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "id long, n int, w array<int>")
    out = joins.blocked_pairs(df, "id", "n", F.col("w"), width=None)
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x | y and len(x & y) >= 0.8 * len(x | y)}
    got = {(x.a, x.b): x.similarity for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and (1, 200) in want
    assert max(_metrics(out, "Join", "numOutputRows")) < len(want) + 300


def test_cycles_of_each_length(spark):
    """Against brute force; first nodes, and longest paths that don't close are not listed: before, the join on the last node gave every way of two edges."""
    import random

    from quarrylens.operators import graph

    r = random.Random(2)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(60)}

    def longer(path):
        for a, b in edges:
            if a == path[-1] and b == path[0] and len(path) > 1:
                yield path
            if a == path[-1] and b > path[0] and b not in path and len(path) < 5:
                yield from longer((*path, b))

    every = [p for n in range(14) for p in longer((n,))]
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    for longest in (2, 3, 4, 5):
        got = [tuple(x.path) for x in graph.simple_cycles(df, longest).collect()]
        assert sorted(got) == sorted(p for p in every if len(p) <= longest) and got
    # A node with 100 edges in and 100 out, of whose ways one closes.
    hub = spark.createDataFrame([(i, 1000) for i in range(100)] + [(1000, 2000 + i) for i in range(100)] + [(2000, 5)], "src long, dst long")
    out = graph.simple_cycles(hub, 3)
    assert [tuple(x.path) for x in out.collect()] == [(5, 1000, 2000)]
    assert max(_metrics(out, "Join", "numOutputRows")) < 500
