"""Rows that differ in few columns, the shared folder's file system, plans without Python, and the linear scan for segments."""

import random
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from quarrylens.llm import chat_format, common, jaccard_join, mixing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_survivors_do_not_depend_on_the_order(spark):
    """Rows of one id and text that differ in source and language only: the same one stays whatever order they come in, and each is mixed for itself."""
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s0", 7), (1, text, "de", "s1", 7), (1, text, None, "s1", 7), (1, text, "en", "s0", 7), (2, text, "en", "s1", 7)]
    kept = [sorted(map(tuple, jaccard_join.keep_one(spark.createDataFrame(r, COLUMNS).coalesce(1)).collect())) for r in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1 and kept[0][0] in rows
    got = [tuple(r) for r in mixing.mixed(spark.createDataFrame(rows * 3, COLUMNS)).collect()]
    # Targets are cut at twice each source: no row more than twice its number, and no source takes another's words.
    assert all(got.count(r) <= 2 * (rows * 3).count(r) for r in set(got)) and {r[3] for r in got} == {"s0", "s1"} and {r for r in got if r[3] == "s1"} == {r for r in rows if r[3] == "s1"}


def test_row_hashes(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("a", "a")], "x string, y string").withColumn("m", F.create_map(F.lit("k"), "x"))
    assert df.select(common.row_hash(df)).distinct().count() == 4


def test_shared_folder_of_the_default_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "/some/folder"), _jvm=spark._jvm, _jsc=spark._jsc)
    try:
        assert common.shared_folder(session, "x").startswith("file:///some/folder/x-")
        conf.set("fs.defaultFS", "viewfs://store/")
        conf.set("fs.viewfs.mounttable.store.link./some", "file:///tmp")
        assert common.shared_folder(session, "x").startswith("viewfs://store/some/folder/x-")
    finally:
        conf.set("fs.defaultFS", old)


def test_chat_format_has_no_python(spark, tmp_path):
    rows = [(-(1 << 63), 0, "user", "least id"), (None, 0, "user", "no id"), (7, 1, "assistant", "b"), (7, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_format.op5_chat_format(spark, str(tmp_path))
    assert "Python" not in out._jdf.queryExecution().toString() and "PythonRDD" not in out._jdf.queryExecution().toRdd().toDebugString()
    assert sorted((r.conv_id is None, r.conv_id or 0, r.n_turns) for r in out.collect()) == [(False, -(1 << 63), 1), (False, -1, 2), (False, 7, 2), (True, 0, 1)]


def test_chat_ties_and_long_texts(spark):
    """Of equal means the longer path, then the smaller leaf; a very long text; columns named like the operator's own."""
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "short", 1.0), ("t", 3, 1, "assistant", "x" * 300_000, 1.0), ("t", 4, 3, "user", "more", 1.0), ("t", 5, 3, "user", "other", 1.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumns({"leaf": F.lit(1), "depth": F.lit(1), "piece": F.lit("p"), "start": F.lit(0)})
    (r,) = chat_format.read_back(chat_format.format_trees(m)).collect()
    assert r.leaf == 4 and [t.text for t in r.turns] == ["q", "x" * 300_000, "more"] and r.loss_text == "x" * 300_000


def test_segments_in_linear_time():
    """Far apart hits in a falling sum, where no candidate has a lesser sum before it; and rising ones."""

    def seconds(n, step):
        r = random.Random(n)
        at = [step * i for i in range(n)]
        score = [r.uniform(0.5, 3) for _ in at]
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            toxicity.maximal_segments(at, score, -0.05)
            best = min(best, time.perf_counter() - start)
        return best

    for step in (100, 37, 3):
        assert seconds(160_000, step) < 25 * seconds(16_000, step)
