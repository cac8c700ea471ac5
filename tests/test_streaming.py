from pyspark.sql import functions as F

from quarrylens.streaming import incremental as I


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def _events(spark, tmp_path, n=3):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(n):
        d.filter(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_totals_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    view = lambda d: I.signal_totals(d.select(F.col("event_type").alias("signal"), (F.col("value") / 100).alias("score")))
    want = {r.signal: (r.n, round(r.s, 6)) for r in view(batch).collect()}
    got = _drain(view(stream), "totals", "complete")
    assert {r.signal: (r.n, round(r.s, 6)) for r in got.collect()} == want


def test_commits_arrive_once(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    twice = lambda d: d.select(F.col("event_id").cast("string").alias("hash"), "ts").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")
    assert _drain(I.commits_once(twice(stream), "60 days"), "once").count() == batch.count()


def test_carried_over_equals_last_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    q = stream.select("user_id", "event_id").writeStream.foreachBatch(I.carried_over(f"{tmp_path}/t", ["user_id"])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = I.current(spark, f"{tmp_path}/t", "user_id long, event_id long")
    assert last.select("user_id").distinct().count() == batch.select("user_id").distinct().count()
    per_batch = last.join(batch.select("event_id", (F.col("event_id") % 3).alias("b")), "event_id").groupBy("user_id").agg(F.countDistinct("b").alias("n"))
    assert per_batch.agg(F.max("n")).first()[0] == 1


def test_lifecycle(spark, tmp_path):
    d = spark.createDataFrame([("k", "seen", 1), ("k", "seen", 2), ("k", "gone", 3), ("k", "seen", 4), ("j", "gone", 1)], "key string, kind string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _drain(I.lifecycle(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")), "life").collect()
    assert [(r.key, r.state) for r in got] == [("k", "open"), ("k", "resolved"), ("k", "open")]


def test_outcome_join_runs(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    side = lambda d, kind: d.filter(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("key"), "ts")
    got = _drain(I.outcomes(side(stream, "error"), side(stream, "purchase"), "2 days", "60 days"), "outcomes")
    want = side(batch, "error").join(side(batch, "purchase").select(F.col("key").alias("k2"), F.col("ts").alias("fixed")), F.expr("key = k2 and fixed >= ts and fixed <= ts + interval 2 days"))
    assert got.filter("fixed is not null").count() == want.count()


def test_blocking(spark):
    new = spark.createDataFrame([("high",)], "severity string")
    assert I.blocking_reasons(new, 0.0, 0.1, expired=False, parse_errors=0) == ["new critical or high finding"]
    assert I.blocking_reasons(new.limit(0), 0.2, 0.1, expired=True, parse_errors=1) == ["score rose", "baseline expired", "files did not parse"]
    assert I.blocking_reasons(new.limit(0), 0.0, 0.1, expired=False, parse_errors=0, detection_failed=True, nothing_changed=True) == ["changes could not be detected"] and not I.blocking_reasons(new.limit(0), 0.0, 0.1, expired=False, parse_errors=0, detection_failed=True)


def test_rerun(spark):
    schema = "signal string, score double, file_path string, symbol string, line int, detail string"
    before = spark.createDataFrame([("a", 0.5, "x.py", "f", 1, "t 1"), ("a", 0.5, "y.py", "g", 1, "t 2"), ("wide", 0.4, "x.py", None, 1, "w"), ("wide", 0.4, "y.py", None, 1, "w")], schema)
    fresh = spark.createDataFrame([("a", 0.5, "x.py", "f", 9, "t 7"), ("a", 0.9, "x.py", "h", 2, "n"), ("wide", 0.9, "x.py", None, 3, "not local")], schema)
    weights = spark.createDataFrame([("a", 0.5), ("wide", 0.5)], "signal string, weight double")
    r = I.rerun(before, fresh, spark.createDataFrame([("x.py",), ("gone.py",)], "path string"), ("a",), weights)
    assert sorted((x.signal, x.file_path, x.symbol or "", x.estimated) for x in r.findings.collect()) == [("a", "x.py", "f", False), ("a", "x.py", "h", False), ("a", "y.py", "g", False), ("wide", "x.py", "", True), ("wide", "y.py", "", False)]
    assert [x.symbol for x in r.new.collect()] == ["h"] and r.resolved.count() == 0
    d = r.delta.first()
    assert d.direction == "degrading" and d.delta == round(d.after - d.before, 4) > 0
    r = I.rerun(before, fresh.limit(0), spark.createDataFrame([("x.py",)], "path string"), ("a",), weights)
    assert [x.symbol for x in r.resolved.collect()] == ["f"] and r.delta.first().direction == "improving"


def test_left_out_tests(spark, tmp_path):
    from quarrylens.sources import records

    for p in ("tests/test_a.py", "tests/data.txt", "src/b.py", "venv/tests/test_c.py", "old/test_d.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert sorted(r.path for r in records.left_out_tests(spark, str(tmp_path), ("**/tests/**", "old/**")).collect()) == ["tests/test_a.py"]
