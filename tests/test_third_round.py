"""Cases of the third round's findings."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarrylens.operators import graph, joins, retrieval, vector_index
from quarrylens.plans import catalog, load_all


def _rows_of_joins(df):
    """Rows that each join of a collected DataFrame handed on."""
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        inner = {"AdaptiveSparkPlan": "executedPlan"}.get(p.nodeName()) or ("plan" if p.nodeName().endswith("QueryStage") else None)
        if inner:
            todo.append(getattr(p, inner)())
            continue
        if "Join" in p.nodeName():
            rows.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_exact_search_finds_what_probes_miss(spark, tmp_path):
    r = np.random.default_rng(11)
    x = r.normal(size=(40, 16)).repeat(20, axis=0) + r.normal(size=(800, 16)) * 0.7
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    asked = e.filter("vec_id % 8 = 0")
    index = vector_index.build_index(e, "vec_id", "v", f"file://{tmp_path}/index", lists=40)
    want = {(q.query, q.id) for q in retrieval.nearest(e, asked, "vec_id", "v", 5).collect()}
    found = lambda **how: {(q.query, q.id) for q in vector_index.search_index(index, asked, "vec_id", "v", 5, least=1, most=2, **how).collect()}
    assert found() != want and found(exact=True) == want
    # More than there are.
    assert vector_index.search_index(index, asked.limit(1), "vec_id", "v", 900, exact=True).count() == 799


def test_names_of_many_parts_are_compared_once(spark, tmp_path):
    """300 parts each of two names, a lone near one and a null."""
    import time

    load_all()
    x, y = "red tin box " * 20, "old oak lid " * 20
    names = [x] * 300 + [y] * 300 + [x + "ab", None]
    spark.createDataFrame([(i, n, "B", 1) for i, n in enumerate(names)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    start = time.monotonic()
    got = {tuple(r): r for r in catalog.QUERIES["f10_levenshtein"](spark, f"file://{tmp_path}").groupBy("distance").agg(F.count("*").alias("n"), F.min(F.col("b") - F.col("a")).alias("least")).collect()}
    assert set(got) == {(0, 300 * 299, 1), (2, 300, 301)} and time.monotonic() - start < 120


def test_paths_are_closed_on_both_ends(spark):
    """A hub with many ways on: closing a path by its last node alone would list all of them."""
    n = 300
    edges = [(0, i) for i in range(1, n)] + [(i, n) for i in range(1, n)] + [(n, -i) for i in range(1, n)] + [(n, 0)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = graph.simple_cycles(e, 3).select("length", "path")
    assert {(r.length, *r.path) for r in got.collect()} == {(3, 0, i, n) for i in range(1, n)}
    assert max(_rows_of_joins(got)) < 2 * n and "path" not in got.groupBy("length").count()._jdf.queryExecution().optimizedPlan().toString()


def test_basket_pairs_take_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    items = spark.range(1000).select((F.col("id") / 4).cast("long").alias("basket"), (F.col("id") * 7 % 30).alias("item"))
    want = {tuple(r) for r in joins.basket_pairs(items, "basket", "item").collect()}
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    out = joins.basket_pairs(items, "basket", "item")
    rows = items.distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == want and f", {rows // 50 + 1})" in plan


def test_near_findings_are_not_broadcast(spark, monkeypatch):
    from quarrylens.operators import dedup

    plans, cut = [], dedup.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(dedup, "cut", seen)
    rows = [(i, "s", f"f{i % 3}", i % 7, i % 7 + 1, f"one two {i % 2}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "finding_id long, signal string, file_path string, start_line long, end_line long, title string, value double")
    out = dedup.keep_first(df, F.struct(-F.col("value"), F.col("finding_id")))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def _dense_graph(spark):
    """Two dense components, one before the other, a node before them, a ring behind them and a path behind that."""
    r = random.Random(5)
    edges = {(a + r.randrange(50), a + r.randrange(50)) for a in (0, 100) for _ in range(4000)} | {(300, 7), (8, 107)}
    edges |= {(140, 200), (200, 201), (201, 202), (202, 200), (202, 210), (210, 211)}
    return spark.createDataFrame(sorted(edges), "src long, dst long"), {(a, b) for a, b in edges if a != b}


def _rows_cut(monkeypatch):
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def test_components_of_a_dense_graph_colour_few_edges(spark, monkeypatch):
    df, edges = _dense_graph(spark)
    seen, coloured = [], graph._coloured

    def colour(e):
        seen.append(e.count())
        return coloured(e)

    monkeypatch.setattr(graph, "_coloured", colour)
    got = {r.node: (r.component, r.size) for r in graph.strong_components(df).collect()}
    assert got == {n: (0, 50) for n in range(50)} | {n: (100, 50) for n in range(100, 150)} | {n: (200, 3) for n in (200, 201, 202)}
    assert sum(seen) * 2 < len(edges)


def test_dependents_of_a_dense_graph_write_its_edges_once(spark, monkeypatch):
    df, edges = _dense_graph(spark)
    rows = _rows_cut(monkeypatch)
    got = {r.node: r.n_dependents for r in graph.dependents(df).collect()}
    want = {n: 50 for n in range(50)} | {n: 100 for n in range(100, 150)} | {n: 103 for n in (200, 201, 202)} | {210: 104, 211: 105}
    assert got == want
    assert sum(rows) < 2.5 * len(edges), (sum(rows), len(edges))


def test_scores_of_a_document_are_summed_in_its_block(spark, monkeypatch):
    from collections import Counter
    from math import log

    monkeypatch.setattr(retrieval, "BLOCK", 64)
    monkeypatch.setattr(retrieval, "TERMS", 3)
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.choice((1, 1, 2)) for _ in range(n))
    docs = [(i, text(r.randrange(3, 30))) for i in range(400)] + [(400, ""), (401, "zz")]
    docs.append(docs[7])  # a document that comes twice
    asked = [(f"q{i}", text(6)) for i in range(70)]
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    out = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id string, text string"), "doc_id", tokens, "item_id", tokens, 4)
    got = {(x.query, x.doc): x.score for x in out.collect()}
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    tf = Counter((i, len(t.split()), w) for i, t in docs for w in t.split())
    df, want = Counter(w for _, _, w in tf), {}
    for name, query in asked:
        score = Counter()
        of = Counter(query.split())
        for (i, length, w), c in tf.items():
            score[i] += of[w] * log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * length / avg))
        want |= {(name, i): s for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4] if s > 0}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    # Before, each posting met each query that has its word.
    assert max(_rows_of_joins(out)) < 1000
