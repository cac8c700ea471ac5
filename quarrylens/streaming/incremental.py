"""The incremental path on Structured Streaming; each result equals a batch recompute."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signal_totals(findings: DataFrame) -> DataFrame:
    """(count, sum) a signal, kept up to date; finalise with ``scoring.dampened``."""
    return findings.groupBy("signal").agg(F.count("*").alias("n"), F.sum("score").alias("s"))


def commits_once(commits: DataFrame, late: str = "1 day") -> DataFrame:
    """Each commit once, however often it is delivered within the watermark."""
    return commits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def outcomes(scans: DataFrame, fixes: DataFrame, within: str = "30 days", silence: str = "60 days") -> DataFrame:
    """Scan findings (key, ts) and the fixes (key, ts) that follow within a window; null once the silence has passed."""
    a = scans.withWatermark("ts", silence).alias("a")
    b = fixes.select(F.col("key").alias("fix_key"), F.col("ts").alias("fixed")).withWatermark("fixed", silence).alias("b")
    return a.join(b, F.expr(f"key = fix_key and fixed >= ts and fixed <= ts + interval {within}"), "leftOuter").drop("fix_key")


def windowed(events: DataFrame, length: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), *by).agg(F.count("*").alias("n"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Open findings by key: ``seen`` opens or keeps, ``gone`` resolves. Emits key, state, opened, resolved on each change."""

    def step(key: tuple, batches, state):
        opened = state.get[0] if state.exists else None
        rows = []
        for pdf in batches:
            for kind, ts in zip(pdf.kind, pdf.ts, strict=True):
                rows.append((ts, kind))
        out = []
        for ts, kind in sorted(rows):
            if kind == "seen" and opened is None:
                opened = ts
                out.append((key[0], "open", ts, None))
            elif kind == "gone" and opened is not None:
                out.append((key[0], "resolved", opened, ts))
                opened = None
        if opened is None and state.exists:
            state.remove()
        elif opened is not None:
            state.update((opened,))
        yield pd.DataFrame(out, columns=["key", "state", "opened", "resolved"]).astype({"opened": "datetime64[us]", "resolved": "datetime64[us]"})

    return events.groupBy("key").applyInPandasWithState(step, "key string, state string, opened timestamp, resolved timestamp", "opened timestamp", "append", "NoTimeout")


def current(spark: SparkSession, path: str, schema: str, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a table of ``carried_over``: of each bucket its newest version (older than epoch ``before``). ``only`` reads some buckets."""
    d = spark.read.schema(f"{schema}, bucket int, epoch long").parquet(path)
    d = d if only is None else d.filter(F.col("bucket").isin(only))
    d = d if before is None else d.filter(F.col("epoch") < before)
    newest = d.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return d.join(F.broadcast(newest), ["bucket", "epoch"]).drop("bucket", "epoch")  # a row a bucket


def carried_over(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of current rows in which each batch replaces the rows of the keys it names.

    Rows lie in buckets of their keys' hash. A batch writes new versions of the buckets it touches only, so its cost follows the batch; one that runs
    again replaces its own versions. ``current`` reads the table.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
            if not touched:
                return
            rows = batch
            if epoch:
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema if f.name != "bucket")
                try:
                    old = current(spark, path, schema, epoch, touched).join(batch.select(*keys).distinct(), keys, "left_anti")
                    rows = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).unionByName(batch)
                except AnalysisException as e:  # no batch before had rows
                    if e.getCondition() != "PATH_NOT_FOUND":
                        raise
            rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
        finally:
            batch.unpersist()

    return merge


class Rerun(NamedTuple):
    findings: DataFrame
    new: DataFrame
    resolved: DataFrame
    delta: DataFrame


def rerun(previous: DataFrame, fresh: DataFrame, changed: DataFrame, local_signals: tuple[str, ...], weights: DataFrame, noise: float = 0.001) -> Rerun:
    """What an analysis of changed files alone makes of the findings before it.

    ``changed``: path of each file that was changed or removed; ``fresh``: findings of ``local_signals`` (those that follow from one file) in changed files. Earlier findings of such signals in those files are replaced; all others are
    carried over, and those of other signals in changed files are marked ``estimated``, since nothing has looked at them again. ``new`` and ``resolved`` are told by symbol and stable title; ``delta`` is one row: before, after,
    delta and direction of the composite score.
    """
    from ..operators import scoring
    from ..operators.versions import new_findings

    touched = changed.select(F.col("path").alias("file_path")).distinct().withColumn("touched", F.lit(True))
    old = previous.join(touched, "file_path", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    local = F.col("signal").isin(*local_signals)
    carried = old.filter(~(F.col("touched") & local)).withColumn("estimated", F.col("touched")).drop("touched")
    after = carried.unionByName(fresh.filter(local).withColumn("estimated", F.lit(False)))
    title = "title" if "title" in previous.columns else "detail"
    score = lambda d, name: scoring.composite(scoring.signal_scores(d), weights).agg(F.coalesce(F.first("composite"), F.lit(0.0)).alias(name))
    delta = score(previous, "before").crossJoin(F.broadcast(score(after, "after")))  # one row each
    d = F.round(F.col("after") - F.col("before"), 4)
    way = F.when(d > noise, "degrading").when(d < -noise, "improving").otherwise("stable")
    return Rerun(after, new_findings(after, previous, title), new_findings(previous, after, title), delta.select("before", "after", d.alias("delta"), way.alias("direction")))


def blocking_reasons(new: DataFrame, delta: float, most_delta: float, *, expired: bool, parse_errors: int, detection_failed: bool = False, nothing_changed: bool = False) -> list[str]:
    """Why a change isn't safe to commit (empty: it is). That nothing changed counts only if the changes couldn't be found out."""
    out = []
    if detection_failed and nothing_changed:
        out.append("changes could not be detected")
    for severity in ("critical", "high"):
        if not new.filter(F.col("severity") == severity).isEmpty():
            out.append("new critical or high finding")
            break
    if delta > most_delta:
        out.append("score rose")
    if expired:
        out.append("baseline expired")
    if parse_errors:
        out.append("files did not parse")
    return out
