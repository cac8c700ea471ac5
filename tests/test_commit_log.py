"""Commit logs read as batch and as stream, and their index."""

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import commit_log as L


def record(h, parents, day, message, *files, author="Ann"):
    stat = "".join(f"\n{a}\t{b}\t{p}" for a, b, p in files)
    return f"\x1e{h:0<12}\x1f{parents}\x1f{author}\x1fann@x.org\x1f{day}T10:00:00+00:00\x1f{message}\n\x1f{stat}\n"


LOG = "".join([
    record("a", "", "2024-01-05", "Add login page", (3, 1, "sub/a.py"), ("-", "-", "sub/img.png"), (5, 5, "other/b.py")), record("b", "a00000000000", "2024-02-10", "fix: crash on start\n\nbody\nCo-authored-by: Bot <noreply@cursor.sh>", (1, 0, "sub/a.py")),
    record("c", "b00000000000 a00000000000", "2024-03-01", "Merge branch x"), record("d", "c00000000000", "2024-03-02", "Implement user session cache", (9, 0, "sub/c d.py"), author=""), record("short", "", "no time", "x"),
])


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.txt").write_text(LOG)
    return tmp_path


def test_parse(spark, folder):
    c = L.parse_log(L.read_log(spark, str(folder / "log")), prefix="sub").orderBy("ts").collect()
    assert [x.hash[0] for x in c] == ["a", "b", "c", "d"] and [len(x.parents) for x in c] == [0, 1, 2, 1] and c[3].author == "unknown"
    assert [(f.path, f.insertions, f.deletions) for f in c[0].files] == [("a.py", 3, 1), ("img.png", 0, 0)] and c[3].files[0].path == "c d.py" and c[2].files == []
    since = F.lit("2024-02-01").cast("timestamp")
    assert L.parse_log(L.read_log(spark, str(folder / "log")), since=since, include=("**/a.py",)).select("hash").first()[0][0] == "b"
    assert L.changed_files(L.parse_log(L.read_log(spark, str(folder / "log")))).count() == 5


def test_classes(spark, folder):
    c = L.parse_log(L.read_log(spark, str(folder / "log")))
    got = {x.hash[0]: x for x in L.classified(c).collect()}
    assert [got[h].is_merge for h in "abcd"] == [False, False, True, False] and [got[h].is_defect for h in "abcd"] == [False, True, False, False]
    assert [got[h].confidence for h in "abcd"] == [0.15, 0.95, 0.0, 0.4] and [got[h].by_tool for h in "abcd"] == [False, True, False, False]
    assert {x.hash[0]: x.by_tool for x in L.classified(c, 0.2).collect()} == {"a": False, "b": True, "c": False, "d": True}
    files = spark.createDataFrame([("CLAUDE.md",), (".cursor/rules",), ("src/x.py",)], "path string")
    assert tuple(L.tool_boost(files).first()) == (["claude", "cursor"], 0.15) and tuple(L.tool_boost(files.filter("path like 'src%'")).first()) == ([], 0.0)


def test_index(spark, folder):
    at = str(folder / "index")
    every = L.parse_log(L.read_log(spark, str(folder / "log")))
    first = every.filter("hash < 'c'")
    names = lambda since=None: sorted(x.hash[0] for x in L.indexed(spark, at, since).collect())
    assert names() == [] and L.update_index(first, "b00000000000", at) == "created" and names() == ["a", "b"]
    assert L.update_index(first, "b00000000000", at) == "current" and L.update_index(every, "d00000000000", at) == "appended" and names() == ["a", "b", "c", "d"]
    since = F.lit("2024-02-15").cast("timestamp")
    assert names(since) == ["c", "d"]
    plan = L.indexed(spark, at, since)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1].split("\n")[0]
    # A head whose log doesn't hold the last one: another generation.
    other = every.filter("hash like 'a%' or hash like 'd%'").withColumn("hash", F.regexp_replace("hash", "^d", "e"))
    assert L.update_index(other, "e00000000000", at) == "rebuilt" and names() == ["a", "e"]


def test_stream(spark, folder):
    """The same commits as a stream, in two runs with one checkpoint; a batch that comes twice adds nothing."""
    at, state = str(folder / "streamed"), str(folder / "state")

    def run():
        q = L.parse_log(L.stream_log(spark, str(folder / "log"))).writeStream.foreachBatch(L.append_batches(at)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    want = {tuple(x[:2]) for x in L.parse_log(L.read_log(spark, str(folder / "log"))).select("hash", F.col("ts").cast("string")).collect()}
    assert {tuple(x) for x in L.indexed(spark, at).select("hash", F.col("ts").cast("string")).collect()} == want
    (folder / "log/2.txt").write_text(record("f", "d00000000000", "2024-04-01", "more") + record("a", "", "2024-01-05", "Add login page"))
    run()
    L.append_batches(at)(L.parse_log(L.read_log(spark, str(folder / "log/2.txt"))), 7)
    assert sorted(x.hash[0] for x in L.indexed(spark, at).collect()) == ["a", "b", "c", "d", "f"] and L._manifest(spark, at)[2][0] == "f"
