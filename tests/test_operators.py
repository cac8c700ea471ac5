import random

import numpy as np
from pyspark.sql import functions as F

from quarrylens.functions import exprs as X
from quarrylens.operators import graph, joins, retrieval, scoring, windows
from quarrylens.plans import signals
from quarrylens.sources import records, sinks


def test_queries_have_names_and_sql():
    import __spark_entry__ as e

    assert len(e.queries()) >= 100 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_dampening_by_hand(spark):
    one = spark.createDataFrame([("s", 0.5)], "signal string, score double")
    assert abs(scoring.signal_scores(one).first().signal_score - 0.1138) < 1e-4
    assert abs(scoring.signal_scores(one.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20))))).first().signal_score - 0.5) < 1e-12
    assert scoring.signal_scores(one.limit(0)).count() == 0


def test_grades_and_severities(spark):
    s = spark.createDataFrame([(0.19,), (0.2,), (0.4,), (0.6,), (0.8,)], "s double")
    assert [r.g for r in s.select(X.grade(F.col("s")).alias("g")).collect()] == list("ABCDF")
    assert [r.g for r in s.select(X.severity(F.col("s")).alias("g")).collect()] == ["info", "low", "medium", "high", "critical"]


def test_bounded_simplex():
    w = scoring.bounded_simplex({"a": 0.9, "b": 0.1, "c": 0.0}, 0.02, 0.4)
    assert abs(sum(w.values()) - 1) < 1e-9 and max(w.values()) <= 0.4 + 1e-12


def test_globs():
    import re

    for pattern, yes, no in (("src/**/*.py", "src/a/b.py", "src/a/b.ts"), ("src/**/*.py", "src/b.py", "x/src/b.py"), ("*.md", "a.md", "d/a.md"), ("a?c", "abc", "a/c")):
        r = re.compile(X.glob_regex(pattern))
        assert r.search(yes) and not r.search(no)


def test_ranges_against_nested_loops(spark):
    r = random.Random(1)
    ranges = [(i, r.choice("ab"), a := r.randint(0, 300), a + r.randint(-150, 150)) for i in range(60)]
    points = [(i, r.choice("ab"), r.randint(0, 300)) for i in range(60)]
    got = joins.point_in_range(spark.createDataFrame(ranges, "rid int, k string, s int, e int"), spark.createDataFrame(points, "pid int, k string, at int"), ["k"], "s", "e", "at", bin_size=32)
    want = sorted((i, j) for i, k, a, b in ranges for j, q, x in points if k == q and min(a, b) <= x <= max(a, b))
    assert sorted((x.rid, x.pid) for x in got.collect()) == want


def test_closure_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src int, dst int")
    c = {tuple(r) for r in graph.closure(e).collect()}
    assert (1, 1) in c and (2, 4) in c and (5, 5) in c and (4, 1) not in c
    assert {r.node for r in graph.strong_components(e).collect()} == {1, 2, 3}
    assert [r.path for r in graph.simple_cycles(e, 4).collect()] == [[1, 2, 3]]
    assert {r.node: r.level for r in graph.levels(e).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: 0, 7: 1}
    p = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)], "old int, new int")
    assert {r.old: r.new for r in graph.chase(p).collect()} == {1: 3, 2: 3, 4: None, 5: None}
    assert graph.closure(e.limit(0)).count() == 0


def test_anchored_bursts_by_hand(spark):
    d = spark.createDataFrame([("a", f"2024-01-{x:02d} 00:00:00") for x in (1, 2, 3, 4, 5, 9, 10)], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = windows.anchored_bursts(d, "k", "ts", 3, 3).collect()
    assert [(r["first"].day, r["last"].day, r.n) for r in got] == [(1, 4, 4)]


def test_average_rank(spark):
    d = spark.createDataFrame([(x,) for x in (5, 1, 5, 9)], "v int")
    assert sorted((r.v, r.p) for r in windows.average_rank(d, "v", "p").collect()) == [(1, 1.0), (5, 2.5), (5, 2.5), (9, 4.0)]


def test_hyperplane_recall(spark):
    """Close vectors (cosine about 0.95) are proposed together by one of the tables, as the loss for that many says, and few others are."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 64))
    y = x + r.normal(size=x.shape) * 0.3
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((x, y)))], "vec_id long, embedding array<double>")
    tables = next(n for n in range(1, 99) if retrieval.recall_loss(0.95, 12, n) < 0.02)
    b = retrieval.hyperplane_buckets(e, "vec_id", "embedding", 64, bits=12, tables=tables)
    c = {tuple(q) for q in b.join(b.toDF("other", "table", "bucket"), ["table", "bucket"]).filter("id < other").select("id", "other").distinct().collect()}
    close = [(i, 400 + i) for i in range(400)]
    assert sum(p in c for p in close) >= 0.95 * len(close) and len(c) < 0.05 * 800 * 799 / 2
    near = {(q.query, q.id) for q in retrieval.nearest(e, e.filter("vec_id < 400"), "vec_id", "embedding", 1).collect()}
    assert near == set(close)


def _tree(tmp_path):
    body = "\n".join(f"    x{i} = {i}" for i in range(8)) + "\n    if p:\n        p = 2"
    deep = "def deep(a, b):\n" + "".join("    " * (i + 1) + f"if a > {i}:\n" for i in range(6)) + "    " * 7 + "return a\n"
    files = {
        "pkg/a.py": f"import pkg.b\n\ndef one(p):\n{body}\n    return p\n\ndef unused():\n    pass\n\n{deep}",
        "pkg/b.py": f"import pkg.a\nfrom pkg.a import one\n\ndef two(p):\n{body}\n    return p\n\ntry:\n    one(1)\nexcept Exception:\n    pass\ntry:\n    one(2)\nexcept:\n    pass\ntry:\n    one(3)\nexcept Exception:\n    pass\n",
        "pkg/broken.py": "def (:\n",
        "web/a.ts": "let a = b as any; // @ts-ignore\n",
        "README.md": "See `pkg/` and `gone/`.\n",
        "pkg/keys.py": "api_key = 'sk-abcdefghijklmnop'\nname = 'plain'\nx = 1  # quarry:ignore[a, b] until:2024-05-01 reason: known\ny = 2  # quarry:context legacy, migration\n",
    }
    for p, c in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    return str(tmp_path)


def test_signals_over_a_tree(spark, tmp_path):
    source = records.files(spark, _tree(tmp_path), exclude=("**/*.lock",)).cache()
    assert {r.path: r.language for r in source.collect()}["web/a.ts"] == "typescript" and source.count() == 6
    t = signals.tables(source)
    assert t["parsed"].filter("error is not null").count() == 1
    found = signals.run(t).cache()
    got = {(r.signal, r.file_path) for r in found.collect()}
    assert {("circular_import", "pkg/a.py"), ("mutant_duplicate", "pkg/a.py"), ("guard_clause_deficit", "pkg/a.py"), ("broad_exception_monoculture", "pkg"), ("type_safety_bypass", "web/a.ts"), ("stale_docs", "README.md"), ("hardcoded_secret", "pkg/keys.py"), ("dead_code_accumulation", "pkg/a.py")} <= got
    assert ("hardcoded_secret", "pkg/a.py") not in got and all(0 <= r.score <= 1 for r in found.collect())
    s = records.suppressions(source).collect()
    assert len(s) == 1 and s[0].signals == ["a", "b"] and str(s[0].until) == "2024-05-01" and s[0].reason == "known"
    assert records.context_tags(source).first().tags == ["legacy", "migration"]
    assert sinks.sarif_results(found).count() == found.count() == sinks.annotations(found).count() and "| Signal |" in sinks.markdown(found)
    sinks.write_csv(found, f"{tmp_path}/out.csv")
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).count() == found.count()
    assert signals.runnable({"files"})["mutant_duplicate"] == "needs functions"


def test_logs(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"signal":"s","file_path":"f","verdict":"tp","source":"x","ts":"2024-01-02T03:04:05Z"}\nnot json\n{"signal":"s","verdict":"fp","ts":"bad"}\n')
    got = records.feedback_log(spark, f"{tmp_path}/f.jsonl").collect()
    assert len(got) == 2 and got[0].ts.hour == 3 and got[1].ts is None
    log = "\x1eh1\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00Z\x1fmsg\n3\t1\tsrc/a.py\n-\t-\tbin.png\n\x1eh1\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00Z\x1fmsg\n"
    commits, files = records.commits(spark.createDataFrame([(log,)], "value string"))
    assert commits.count() == 1 and commits.first().author == "Ann"


def test_principal_values():
    from quarrylens.operators.scoring import principal_values

    r = np.random.default_rng(1)
    m = np.corrcoef(r.normal(size=(5, 40)) + 2 * r.normal(size=(1, 40)))
    assert np.allclose(principal_values(m.tolist()), sorted(np.linalg.eigvalsh(m), reverse=True), atol=1e-3)
