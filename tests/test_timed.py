"""Streams with timers against the batch over the same events, restarts included."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.streaming.timed import Baselines, Leases, replayed, tracked

SCHEMA = "task string, ts timestamp, seq long, event string, worker string, head string, stash string, changed int"


def history(kinds, n=240, seed=1):
    r = random.Random(seed)
    at = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(n):
        at += pd.Timedelta(seconds=r.randint(0, 120))
        rows.append((f"t{r.randint(0, 5)}", at.to_pydatetime(), i, r.choice(kinds), r.choice("ab"), r.choice(("h1", "h1", "h1", "h2")), r.choice(("", "", "", "s")), r.choice((0, 3, 20))))
    return rows


@pytest.mark.parametrize(("machine", "kinds"), [(Leases(300, 3), ("claim", "claim", "renew", "done", "fail", "add")), (Baselines(900, 10), ("store", "probe", "probe"))])
def test_stream_equals_batch(spark, tmp_path, machine, kinds):
    rows = history(kinds)
    r = random.Random(4)
    # Delivered in four files, somewhat out of order; the query is started anew for each.
    late = sorted(rows, key=lambda x: x[2] + r.randint(0, 6))
    tick = ("tick", rows[-1][1] + timedelta(hours=1), 10**6, "tick", None, None, None, 0)
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [late[:70], late[70:100], late[100:], [tick], [(*tick[:1], tick[1] + timedelta(hours=1), *tick[2:])]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        q = tracked(stream, machine, "task", "30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(out).collect() if x.key != "tick")
    end = tick[1] - timedelta(minutes=30)
    want = sorted(tuple(x) for x in replayed(spark.createDataFrame(rows, SCHEMA), machine, "task", pd.Timestamp(end)).collect())
    # The clock's last event may carry the stream further than the first did.
    assert want and [x for x in got if x[1] <= end] == want


def test_leases(spark):
    t = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [("a", t(0), 1, "claim", "w"), ("a", t(10), 2, "claim", "v"), ("a", t(300), 3, "claim", "v"), ("a", t(400), 4, "done", "w"), ("a", t(700), 5, "claim", "x"), ("b", t(5), 6, "claim", "w"), ("b", t(200), 7, "renew", "w"), ("b", t(450), 8, "done", "w"), ("b", t(460), 9, "claim", "w"), ("c", None, 10, "claim", "w")]
    df = spark.createDataFrame(rows, "task string, ts timestamp, seq long, event string, worker string")
    got = [(x.key, int(x.ts.timestamp() - t(0).timestamp()), x.change, x["count"]) for x in replayed(df, Leases(300, 3), "task", pd.Timestamp(t(2000))).orderBy("key", "ts", F.col("count")).collect()]
    assert [x for x in got if x[0] == "a"] == [("a", 0, "claimed", 0), ("a", 10, "rejected", 0), ("a", 300, "reclaimed", 1), ("a", 300, "claimed", 1), ("a", 600, "reclaimed", 2), ("a", 700, "claimed", 2), ("a", 1000, "failed", 3)]
    assert [x for x in got if x[0] == "b"] == [("b", 5, "claimed", 0), ("b", 200, "renewed", 0), ("b", 450, "done", 0), ("b", 460, "rejected", 0)] and not [x for x in got if x[0] == "c"]


def test_baselines(spark):
    t = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    e = lambda s, kind, head="h", stash="", changed=0: ("r", t(s), s, kind, None, head, stash, changed)
    rows = [e(0, "probe"), e(1, "store"), e(5, "probe"), e(6, "probe", changed=11), e(7, "probe"), e(8, "store", changed=12), e(9, "probe", changed=30), e(10, "probe", head="g"), e(11, "store"), e(12, "probe", stash="s"), e(20, "store"), e(2000, "probe")]
    got = [x.change for x in replayed(spark.createDataFrame(rows, SCHEMA), Baselines(), "task").orderBy("ts").collect()]
    assert got == ["missing", "stored", "valid", "files", "missing", "stored", "valid", "head", "stored", "stash", "stored", "expired", "missing"]
    assert replayed(spark.createDataFrame([], SCHEMA), Baselines(), "task").count() == 0
