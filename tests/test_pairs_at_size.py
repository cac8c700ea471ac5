"""Queries over pairs, on tables where the pairs themselves would be hundreds of millions: results follow from the tables' making."""

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import catalog, load_all


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    load_all()
    top = f"file://{tmp_path_factory.mktemp('pairs')}"
    k = F.col("id")
    name = F.when(k == 1, "lone word").when(k % 2 == 0, "red tin box").otherwise("red tin can")
    spark.range(1, 30_001).select(k.alias("p_partkey"), name.alias("p_name"), F.lit("B1").alias("p_brand"), F.lit("T1").alias("p_type"), F.lit(7).alias("p_size")).write.parquet(f"{top}/part.parquet")
    # Users end in 0, so that all files have one key.
    spark.range(30_000).select(k.alias("event_id"), (k * 10).alias("user_id"), F.lit("click").alias("event_type"), F.lit(5.0).alias("value"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(f"{top}/events.parquet")
    return top


def test_cohesion_of_many_units(spark, folder):
    n = 30_000
    got = [tuple(r) for r in catalog.QUERIES["g13_cohesion"](spark, folder).collect()]
    assert got == [("B1", n, round(min(0.79, 0.65 / n + 0.35 * (1 - (n - 1) / n)), 6))]


def test_first_pairs_of_a_large_bucket(spark, folder):
    assert [tuple(r) for r in catalog.QUERIES["t08_capped_pairs"](spark, folder).collect()] == [(7, 3)]


def test_files_that_are_not_parallel(spark, folder):
    names = sorted(f"src/m{u % 12}/f{u}.py" for u in range(0, 300_000, 10))
    want, later = {}, {}
    for i, a in enumerate(reversed(names)):
        m = a.split("/")[1]
        if n := i - later.get(m, 0):
            want[m] = want.get(m, 0) + n
        later[m] = later.get(m, 0) + 1
    assert {r.module: r.n for r in catalog.QUERIES["p18_parallel_pairs"](spark, folder).collect()} == want


def test_only_asked_parts_are_worked_out():
    from quarrylens.sources.python_ast import FIELDS, PARTS, describe

    text = "import os\nclass A:\n    pass\ndef f(a):\n    try:\n        return a > 1\n    except ValueError:\n        raise\n"
    whole = describe(text)
    assert describe(text, PARTS, FIELDS) == whole
    for part in ("imports", "handlers", "classes", "settings", "names"):
        got = describe(text, frozenset([part]))
        assert got[part] == whole[part] and not got["functions"]
    (f,) = describe(text, frozenset(["functions"]), frozenset(["cognitive", "boolean"]))["functions"]
    assert set(f) == {"name", "line", "end_line", "cognitive", "boolean"} and f.items() <= {k: v for k, v in whole["functions"][0].items()}.items()


def test_pairs_that_share_rare_words_alone(spark):
    """Sets that meet by a rare word but differ elsewhere are dropped before whole sets are shuffled: the join of candidates hands on near ones alone. None is lost."""
    import random

    from quarrylens.operators import joins

    r = random.Random(5)
    sets = {i: {f"rare{i % 40}"} | {f"w{x}" for x in r.sample(range(3000), 60)} for i in range(400)}
    for i in range(0, 400, 10):  # near ones: up to six words changed
        gone = r.sample(sorted(sets[i]), k := r.randrange(8))
        sets[1000 + i] = sets[i] - set(gone) | {f"new{i}.{x}" for x in range(k)}
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "id long, n int, w array<string>")
    out = joins.blocked_pairs(df, "id", "n", F.col("w"), width=None)
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    got = {(x.a, x.b): x.similarity for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and len(want) >= 30
    # What joins hand on, by Spark's own metrics: the first join (words with their counts) gives each set's words, those of candidates and whole sets only near pairs.
    rows, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        inner = {"AdaptiveSparkPlan": "executedPlan"}.get(p.nodeName()) or ("plan" if p.nodeName().endswith("QueryStage") else None)
        if inner:
            todo.append(getattr(p, inner)())
            continue
        if "Join" in p.nodeName():
            rows.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    words = sum(len(s) for s in sets.values())
    assert len(rows) >= 4 and all(n < 40 * len(want) for n in rows if n != words), rows
