"""From findings to scores, weights, gates and calibration. All are grouped aggregates with map-side combining."""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
BREADTH_CAP = 4.0
UNKNOWN_WEIGHT = 0.1


def dampened(total: Column, n: Column, k: int = K) -> Column:
    """Mean score, dampened by how many findings stand behind it: full at k."""
    return total / n * F.least(F.lit(1.0), F.log1p(n) / log1p(k))


def signal_scores(findings: DataFrame, by: tuple[str, ...] = (), k: int = K, least: int = 1) -> DataFrame:
    g = findings.groupBy(*by, "signal").agg(F.sum("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.select(*by, "signal", "n", dampened(F.col("s"), F.col("n"), k).alias("signal_score"))


def composite(scores: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean over the signals that have a score; 0 without weight."""
    j = scores.join(weights, "signal")
    g = j.groupBy(*by).agg(F.sum(F.col("weight") * F.col("signal_score")).alias("ws"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    return g.select(*by, F.when(F.col("w") < 0.001, 0.0).otherwise(F.least(F.lit(1.0), F.col("ws") / F.col("w"))).alias("composite"))


def impact(findings: DataFrame, weights: DataFrame, cap: float = BREADTH_CAP) -> DataFrame:
    """Weight x score x breadth; breadth grows with the log of related files."""
    j = findings.join(weights, "signal", "left")
    breadth = F.least(F.lit(cap), 1 + F.log1p("n_related"))
    return j.withColumn("impact", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)) * F.col("score") * breadth)


def recalibrated(findings: DataFrame, weights: DataFrame, cap: float = 0.4) -> DataFrame:
    """Signals with more than their share of findings lose weight; weights sum to what they did."""
    g = findings.groupBy("signal").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    j = weights.join(g, "signal", "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(every))
    j = j.withColumn("raw", F.col("weight") * F.when(F.col("share") > cap, F.greatest(F.lit(0.5), 1 - (F.col("share") - cap))).otherwise(1.0))
    return j.select("signal", "share", (F.col("raw") * F.sum("weight").over(every) / F.sum("raw").over(every)).alias("new_weight"))


def feedback_metrics(feedback: DataFrame, by: str = "signal") -> DataFrame:
    """Precision, recall and F1 from verdicts tp, fp and fn; 1 where undefined."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    g = feedback.groupBy(by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def calibrated_weights(weights: DataFrame, metrics: DataFrame, enough: int = 20, boost: float = 0.1) -> DataFrame:
    """Move each weight toward weight x precision as evidence grows; misses add a little; never below .001."""
    j = weights.join(metrics, "signal", "left").na.fill(0, ["tp", "fp", "fn"])
    seen = F.col("tp") + F.col("fp")
    sure = F.least(F.lit(1.0), (seen + F.col("fn")) / enough)
    precision = F.when(seen == 0, 1.0).otherwise(F.col("tp") / seen)
    miss = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("fn") / (F.col("tp") + F.col("fn")))
    new = F.col("weight") * (1 - sure) + F.col("weight") * precision * sure + boost * F.col("weight") * miss * sure
    return j.select("signal", sure.alias("confidence"), F.greatest(F.lit(0.001), new).alias("new_weight"))


def effort(outcomes: DataFrame, least: int = 10) -> DataFrame:
    """Median days to fix, and its label, for signals with enough resolved outcomes."""
    g = outcomes.filter("days_to_fix is not null and not suppressed").groupBy("signal").agg(F.median("days_to_fix").alias("median_days"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.withColumn("effort", F.when(F.col("median_days") <= 1, "low").when(F.col("median_days") <= 5, "medium").otherwise("high"))


def fleiss_kappa(ratings: DataFrame, subject: str, category: str) -> DataFrame:
    """Agreement of raters over subjects that all have the same number of ratings."""
    cell = ratings.groupBy(subject, category).agg(F.count("*").alias("__k"))
    per = cell.groupBy(subject).agg(F.sum("__k").alias("n"), F.sum(F.col("__k") * (F.col("__k") - 1)).alias("pairs"))
    observed = per.agg(F.avg(F.col("pairs") / (F.col("n") * (F.col("n") - 1))).alias("po"))
    shares = cell.groupBy(category).agg(F.sum("__k").alias("__k")).withColumn("p", F.col("__k") / F.sum("__k").over(Window.partitionBy()))
    chance = shares.agg(F.sum(F.col("p") * F.col("p")).alias("pe"))
    return observed.crossJoin(chance).select("po", "pe", F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    n = pairs.groupBy(a, b).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left = n.groupBy(F.col(a).alias("v")).agg(F.sum("c").alias("x"))
    right = n.groupBy(F.col(b).alias("v")).agg(F.sum("c").alias("y"))
    chance = left.join(right, "v").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.col("xy") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(po.alias("po"), pe.alias("pe"), F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def bounded_simplex(weights: dict[str, float], low: float, high: float) -> dict[str, float]:
    """The nearest weights within [low, high] that sum to 1 (bisection on the shift). For a handful of signals, on the driver."""
    names = sorted(weights)
    a, b = -1.0 - max(weights.values()), 1.0 + max(1.0, *(abs(w) for w in weights.values()))
    for _ in range(100):
        mid = (a + b) / 2
        if sum(min(high, max(low, weights[n] + mid)) for n in names) > 1:
            b = mid
        else:
            a = mid
    return {n: min(high, max(low, weights[n] + a)) for n in names}


def correlations(events: DataFrame, entity: str, kind: str) -> DataFrame:
    """a, b, r: Pearson's correlation (4 digits) of the counts of each two kinds over all entities, absent ones 0. From sums of products of the counts that are
    there, so the matrix is never filled."""
    m = events.groupBy(entity, kind).agg(F.count("*").cast("double").alias("n"))
    total = events.agg(F.countDistinct(entity).cast("double").alias("N"))  # one number
    one = m.groupBy(kind).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = m.select(entity, F.col(kind).alias("a"), F.col("n").alias("x")).join(m.select(entity, F.col(kind).alias("b"), F.col("n").alias("y")), entity).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    grid = one.toDF("a", "sa", "qa").crossJoin(one.toDF("b", "sb", "qb")).join(both, ["a", "b"], "left").crossJoin(F.broadcast(total))  # kinds squared
    cov = F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb") / F.col("N")
    spread = F.sqrt((F.col("qa") - F.col("sa") ** 2 / F.col("N")) * (F.col("qb") - F.col("sb") ** 2 / F.col("N")))
    return grid.select("a", "b", F.round(cov / F.nullif(spread, F.lit(0.0)), 4).alias("r"))


def principal_values(matrix: list[list[float]], most: int = 6, rounds: int = 200) -> list[float]:
    """The largest eigenvalues of a small symmetric matrix, by power iteration with deflation."""
    import numpy as np

    m, out = np.array(matrix, float), []
    for _ in range(min(most, len(m))):
        v = np.ones(len(m)) + np.arange(len(m)) * 1e-3
        for _ in range(rounds):
            w = m @ v
            norm = np.linalg.norm(w)
            if norm < 1e-12:
                break
            v = w / norm
        value = float(v @ m @ v) / float(v @ v)
        out.append(value)
        m = m - value * np.outer(v, v) / float(v @ v)
    return out
