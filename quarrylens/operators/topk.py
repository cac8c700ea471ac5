"""Top-k selections with a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: list[str], order: list, k: int, salts: int = 1, salt_by: str | None = None) -> DataFrame:
    """The k first of each group. With ``salts``, first within shares of the group, so a hot group isn't sorted in one task."""
    rank = lambda d, by: d.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")
    if salts > 1 and salt_by:
        df = rank(df, [*keys, F.pmod(F.xxhash64(salt_by), F.lit(salts))])
    return rank(df, keys)


def diverse_top_k(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The best of every group first, then whatever scores highest, k in all.

    Only the k best of each group can be chosen, so the global order is over k rows a group.
    """
    order = [F.col(score).desc(), F.col(key)]
    best = top_k_per_group(df, [group], order, k, salts=16, salt_by=key)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return best.withColumn("__late", (nth > 1).cast("int")).orderBy("__late", *order).limit(k).drop("__late")


def quota_top_k(df: DataFrame, group: str, by: str, score: str, key: str, k: int, quota: int, least: float = 0.5) -> DataFrame:
    """k rows with their ``step``: 0, of each group the best score of at least ``least`` without impact (``by`` 0); 1, the ``quota`` of greatest ``by``; 2, of each group
    that isn't among those the greatest, if its score is at least ``least``; 3, the rest. Within a step by ``by``, then ``key``.

    A row beyond the k best of its group by ``by`` can only be chosen for its score, so few rows a group are ordered together.
    """
    order = [F.col(by).desc(), F.col(key)]
    best = top_k_per_group(df, [group], order, k, salts=16, salt_by=key).withColumn("__s", F.lit(False))
    first = top_k_per_group(df, [group], [F.col(score).desc(), F.col(key)], 1, salts=16, salt_by=key).withColumn("__s", F.lit(True))
    rows = best.unionByName(first).groupBy(*df.columns).agg(F.bool_or("__s").alias("__s"))
    rows = rows.withColumn("__p", F.row_number().over(Window.orderBy(*order))).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))  # k rows a group
    seen = F.min("__p").over(Window.partitionBy(group)) <= quota
    step = F.when((F.col(by) == 0) & (F.col(score) >= least) & F.col("__s"), 0).when(F.col("__p") <= quota, 1).when((F.col("__n") == 1) & (F.col(score) >= least) & ~seen, 2).otherwise(3)
    return rows.withColumn("step", step).orderBy("step", *order).limit(k).drop("__s", "__p", "__n")
