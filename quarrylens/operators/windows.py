"""Sequence logic: ranks, trends, gates, streaks, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, of a time with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """1-based rank with ties averaged, from counts of distinct values. These are range-partitioned and summed in two levels: ranges against each other, and
    values within a range, so no task sees all of them."""
    from .graph import cut

    c = df.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(F.col(value).asc_nulls_first())
    c = cut(c.select(F.col(value).alias("__v"), "__n", F.spark_partition_id().alias("__p")))
    ranges = c.groupBy("__p").agg(F.sum("__n").alias("__t"))
    ranges = ranges.select(F.col("__p").alias("__q"), (F.sum("__t").over(Window.orderBy("__p")) - F.col("__t")).alias("__b"))  # a row a range
    within = F.sum("__n").over(Window.partitionBy("__p").orderBy(F.col("__v").asc_nulls_first())) - F.col("__n")
    c = c.withColumn("__w", within).join(ranges, F.col("__p") == F.col("__q")).select("__v", (F.col("__b") + F.col("__w") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(c, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def z_scores(df: DataFrame, values: list[str], limit: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds z_<value> for each value, against mean and sample deviation of the group; 0 where that is below .001. One aggregate gives all statistics."""
    s = df.groupBy(*by).agg(*(f for v in values for f in (F.avg(v).alias(f"__m_{v}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"__s_{v}"))))
    j = df.join(s, list(by)) if by else df.crossJoin(F.broadcast(s))  # one row
    for v in values:
        z = F.when(F.col(f"__s_{v}") < 0.001, 0.0).otherwise((F.col(v) - F.col(f"__m_{v}")) / F.col(f"__s_{v}"))
        j = j.withColumn(f"z_{v}", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return j.drop(*(f"__{k}_{v}" for v in values for k in "ms"))


def trend(df: DataFrame, scope: list[str], order: str, score: str, noise: float = 0.005, last: int = 5) -> DataFrame:
    """Previous score, delta, direction, the last scores before this one and their mean."""
    w = Window.partitionBy(*scope).orderBy(order)
    before = w.rowsBetween(-last, -1)
    delta = F.round(F.col(score) - F.lag(score).over(w), 4)
    way = F.when(delta.isNull(), "baseline").when(delta < -noise, "improving").when(delta > noise, "degrading").otherwise("stable")
    return df.withColumn("previous", F.lag(score).over(w)).withColumn("delta", delta).withColumn("direction", way).withColumn("recent_mean", F.avg(score).over(before)).withColumn("depth", F.count("*").over(before))


def islands(df: DataFrame, by: list[str], order: list, flag: Column) -> DataFrame:
    """Number the runs of equal ``flag`` in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((F.lag("__f").over(w) != F.col("__f")).cast("int"), F.lit(1))
    return df.withColumn("__f", flag).withColumn("__c", changed).withColumn("island", F.sum("__c").over(w)).withColumnRenamed("__f", "flag").drop("__c")


def streaks(df: DataFrame, by: list[str], order: list, flag: Column, at: str, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` flagged rows: first and last ``at``, and length."""
    g = islands(df, by, order, flag).filter("flag").groupBy(*by, "island").agg(F.count("*").alias("length"), F.min(at).alias("onset"), F.max(at).alias("last"))
    return g.filter(F.col("length") >= least).drop("island")


def anchored_bursts(df: DataFrame, by: str, ts: str, window_days: float, least: int) -> DataFrame:
    """Greedy, non-overlapping groups: everything within ``window_days`` of the group's first event, if there are enough.

    The anchor makes each group depend on the one before, so the times of a stretch without a gap of ``window_days`` are folded in order. What
    is folded is the stretch's array of times (8 bytes an event), inside a native aggregate().
    """
    span = int(window_days * 86_400_000_000)
    # A burst must end where the next event is further away than the window, so each stretch between such gaps is folded by itself.
    at = df.select(by, micros(ts).alias("__t"))
    w = Window.partitionBy(by).orderBy("__t")
    at = at.withColumn("__s", F.sum(F.when(F.col("__t") - F.lag("__t").over(w) <= span, 0).otherwise(1)).over(w))
    times = at.groupBy(by, "__s").agg(F.array_sort(F.collect_list("__t")).alias("times"))
    zero = F.struct(F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    close = lambda s: F.when(s["n"] >= least, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"))))).otherwise(s["done"])
    step = lambda s, x: F.when(s["first"].isNotNull() & (x - s["first"] <= span), F.struct(s["done"].alias("done"), s["first"].alias("first"), x.alias("last"), (s["n"] + 1).alias("n"))).otherwise(F.struct(close(s).alias("done"), x.alias("first"), x.alias("last"), F.lit(1).cast("bigint").alias("n")))
    bursts = times.select(by, F.explode(F.aggregate("times", zero, step, close)).alias("b"))
    return bursts.select(by, F.timestamp_micros("b.first").cast("timestamp_ntz").alias("first"), F.timestamp_micros("b.last").cast("timestamp_ntz").alias("last"), F.col("b.n").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, first in the order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
