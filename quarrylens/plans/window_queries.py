"""Sequence queries: histories, trends, gates, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .catalog import COMMITS, Tables, query, r6


@query("g06_file_histories", f"WITH {COMMITS} SELECT file, count(*) AS n_commits, count(DISTINCT author) AS n_authors, count(*) FILTER (WHERE is_tool) AS n_tool, count(*) FILTER (WHERE is_fix) AS n_fix, round(count(*) FILTER (WHERE ts >= TIMESTAMP '2001-07-02 00:00:00') / 30.0 * 7, 6) AS per_week, min(ts) AS first_seen, max(ts) AS last_seen FROM changes JOIN commits USING (commit) GROUP BY file")
def g06(t: Tables) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    j = t.changes().join(t.commits(), "commit")
    return j.groupBy("file").agg(F.count("*").alias("n_commits"), F.countDistinct("author").alias("n_authors"), n(F.col("is_tool")).alias("n_tool"), n(F.col("is_fix")).alias("n_fix"), r6(n(F.col("ts") >= F.to_timestamp(F.lit("2001-07-02 00:00:00"))) / 30.0 * 7).alias("per_week"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


_COUNTS = f"{COMMITS}, h AS (SELECT file, CAST(count(*) AS DOUBLE) AS churn, CAST(count(DISTINCT author) AS DOUBLE) AS authors, CAST(count(*) FILTER (WHERE is_fix) AS DOUBLE) AS fixes FROM changes JOIN commits USING (commit) GROUP BY file)"
_Z = "greatest(-5.0, least(5.0, CASE WHEN coalesce(stddev_samp({0}) OVER (), 0) < 0.001 THEN 0 ELSE ({0} - avg({0}) OVER ()) / stddev_samp({0}) OVER () END))"


@query("w01_volatility", f"WITH {_COUNTS}, z AS (SELECT file, {_Z.format('churn')} AS zc, {_Z.format('authors')} AS za, {_Z.format('fixes')} AS zf FROM h) SELECT file, round(greatest(0.0, least(1.0, (zc + za + zf) / 3 / 3)), 6) AS score FROM z WHERE greatest(zc, za, zf) >= 1.5 AND greatest(0.0, least(1.0, (zc + za + zf) / 3 / 3)) >= 0.2")
def w01(t: Tables) -> DataFrame:
    h = t.changes().join(t.commits(), "commit").groupBy("file").agg(F.count("*").cast("double").alias("churn"), F.countDistinct("author").cast("double").alias("authors"), F.sum(F.col("is_fix").cast("double")).alias("fixes"))
    h = W.z_scores(h, ["churn", "authors", "fixes"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z_churn") + F.col("z_authors") + F.col("z_fixes")) / 3 / 3))
    return h.filter(F.greatest("z_churn", "z_authors", "z_fixes") >= 1.5).withColumn("score", score).filter("score >= 0.2").select("file", r6("score").alias("score"))


_DAYS = "d AS (SELECT event_type AS scope, CAST(ts AS DATE) AS day, round(avg(value) / 100, 6) AS score FROM events GROUP BY 1, 2)"


def _days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("scope"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 100, 6).alias("score"))


@query("w02_trend", f"WITH {_DAYS}, x AS (SELECT *, lag(score) OVER w AS previous, round(score - lag(score) OVER w, 4) AS delta, avg(score) OVER (PARTITION BY scope ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rm, count(*) OVER (PARTITION BY scope ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS depth FROM d WINDOW w AS (PARTITION BY scope ORDER BY day)) SELECT scope, CAST(day AS VARCHAR) AS day, score, previous, delta, CASE WHEN delta IS NULL THEN 'baseline' WHEN delta < -0.005 THEN 'improving' WHEN delta > 0.005 THEN 'degrading' ELSE 'stable' END AS direction, round(rm, 6) AS recent_mean, depth FROM x")
def w02(t: Tables) -> DataFrame:
    return W.trend(_days(t), ["scope"], "day", "score").withColumn("recent_mean", r6("recent_mean")).withColumn("day", F.col("day").cast("string"))


@query("w03_delta_gate", f"WITH {_DAYS}, x AS (SELECT *, avg(score) OVER (PARTITION BY scope ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rm FROM d) SELECT scope, CAST(day AS VARCHAR) AS day, coalesce(round(score - rm, 6) <= 0.05, true) AS passed FROM x")
def w03(t: Tables) -> DataFrame:
    x = W.trend(_days(t), ["scope"], "day", "score")
    return x.select("scope", F.col("day").cast("string").alias("day"), F.coalesce(r6(F.col("score") - F.col("recent_mean")) <= 0.05, F.lit(True)).alias("passed"))


@query("w04_last_distinct", "WITH r AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS k FROM r WHERE rn = 1) SELECT user_id, count(*) AS n, max(value) FILTER (WHERE k = 1) AS last_value, max(value) FILTER (WHERE k = 3) AS first_value FROM l WHERE k <= 3 GROUP BY user_id")
def w04(t: Tables) -> DataFrame:
    l = W.latest(t.events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    l = l.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_type"))).filter("k <= 3")
    return l.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("last_value"), F.max(F.when(F.col("k") == 3, F.col("value"))).alias("first_value"))


@query("w05_last_two_runs", f"WITH {_DAYS}, x AS (SELECT *, lag(score) OVER (PARTITION BY scope ORDER BY day) AS previous, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS rn FROM d) SELECT scope, round(score - previous, 6) AS delta, CASE WHEN score - previous > 0.01 THEN 'worse' WHEN score - previous < -0.01 THEN 'better' ELSE 'same' END AS verdict FROM x WHERE rn = 1")
def w05(t: Tables) -> DataFrame:
    w = Window.partitionBy("scope")
    x = _days(t).withColumn("previous", F.lag("score").over(w.orderBy("day"))).withColumn("rn", F.row_number().over(w.orderBy(F.col("day").desc()))).filter("rn = 1")
    d = F.col("score") - F.col("previous")
    return x.select("scope", r6(d).alias("delta"), F.when(d > 0.01, "worse").when(d < -0.01, "better").otherwise("same").alias("verdict"))


@query("w06_anchored_bursts", """WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, k, ts, ts AS anchor, 1 AS grp FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.ts, CASE WHEN o.ts <= r.anchor + INTERVAL 3 DAY THEN r.anchor ELSE o.ts END, CASE WHEN o.ts <= r.anchor + INTERVAL 3 DAY THEN r.grp ELSE r.grp + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, grp HAVING count(*) >= 3""")
def w06(t: Tables) -> DataFrame:
    return W.anchored_bursts(t.events.filter("event_type = 'error'"), "user_id", "ts", 3, 3)


@query("w07_streaks", "WITH f AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS bad FROM events), c AS (SELECT *, CASE WHEN bad = lag(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS ch FROM f), g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM c) SELECT user_id, count(*) AS length, min(ts) AS onset, max(ts) AS last FROM g WHERE bad GROUP BY user_id, isl HAVING count(*) >= 4")
def w07(t: Tables) -> DataFrame:
    return W.streaks(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view"), "ts", 4)


@query("w08_half_trend", f"WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY day) AS k, count(*) OVER (PARTITION BY scope) AS n FROM d), m AS (SELECT scope, avg(CASE WHEN k <= n // 2 THEN score END) AS a, avg(CASE WHEN k > n // 2 THEN score END) AS b FROM r GROUP BY scope) SELECT scope, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN b < a * 0.98 THEN 'improving' WHEN b > a * 1.02 THEN 'degrading' ELSE 'stable' END AS trend FROM m")
def w08(t: Tables) -> DataFrame:
    w = Window.partitionBy("scope")
    r = _days(t).withColumn("k", F.row_number().over(w.orderBy("day"))).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    m = r.groupBy("scope").agg(F.avg(F.when(F.col("k") <= half, F.col("score"))).alias("a"), F.avg(F.when(F.col("k") > half, F.col("score"))).alias("b"))
    return m.select("scope", r6("a").alias("first_half"), r6("b").alias("second_half"), F.when(F.col("b") < F.col("a") * 0.98, "improving").when(F.col("b") > F.col("a") * 1.02, "degrading").otherwise("stable").alias("trend"))


@query("w09_deduplicated_feedback", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id) AS rn FROM events) SELECT event_id, user_id, event_type FROM r WHERE rn = 1")
def w09(t: Tables) -> DataFrame:
    source = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return W.latest(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], [source, F.col("ts").desc(), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("w10_canonical_variant", "WITH v AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rn FROM v) SELECT p_brand, p_name AS canonical, n FROM r WHERE rn = 1")
def w10(t: Tables) -> DataFrame:
    return W.latest(t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n")), ["p_brand"], [F.col("n").desc(), "p_name"]).select("p_brand", F.col("p_name").alias("canonical"), "n")


@query("g09_fragmentation", "WITH v AS (SELECT p_type, p_brand, count(DISTINCT p_name) AS variants, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand, variants, round((1 - 1.0 / variants) * least(1.5, 1 + 0.04 * greatest(n - 2, 0)), 6) AS score FROM v WHERE variants >= 2")
def g09(t: Tables) -> DataFrame:
    v = t.part.groupBy("p_type", "p_brand").agg(F.countDistinct("p_name").alias("variants"), F.count("*").alias("n")).filter("variants >= 2")
    return v.select("p_type", "p_brand", "variants", r6((1 - 1.0 / F.col("variants")) * F.least(F.lit(1.5), 1 + 0.04 * F.greatest(F.col("n") - 2, F.lit(0)))).alias("score"))


@query("w13_convergence", "WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id FROM events), l AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d), u AS (SELECT event_type, user_id, count(*) AS hits, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS in_last FROM l WHERE k <= 4 GROUP BY 1, 2) SELECT event_type, count(*) FILTER (WHERE hits = 4) AS stable_ids, round(count(*) FILTER (WHERE hits = 4) / CAST(sum(in_last) AS DOUBLE), 6) AS convergence FROM u GROUP BY event_type")
def w13(t: Tables) -> DataFrame:
    d = t.events.select("event_type", F.to_date("ts").alias("day"), "user_id").distinct()
    last = d.select("event_type", "day").distinct().withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("day").desc()))).filter("k <= 4")
    u = d.join(last, ["event_type", "day"]).groupBy("event_type", "user_id").agg(F.count("*").alias("hits"), F.max((F.col("k") == 1).cast("int")).alias("in_last"))
    stable = F.sum((F.col("hits") == 4).cast("long"))
    return u.groupBy("event_type").agg(stable.alias("stable_ids"), r6(stable / F.sum("in_last")).alias("convergence"))


@query("w14_end_to_end_slope", f"WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS k FROM d), m AS (SELECT scope, max(score) FILTER (WHERE k = 1) AS last, max(score) FILTER (WHERE k = 8) AS first FROM r WHERE k <= 8 GROUP BY scope) SELECT scope, round((last - first) / 7, 6) AS slope FROM m")
def w14(t: Tables) -> DataFrame:
    r = _days(t).withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("day").desc()))).filter("k <= 8")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("score")))
    return r.groupBy("scope").agg(r6((at(1) - at(8)) / 7).alias("slope"))


@query("w15_ols_slope", f"WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS k FROM d) SELECT scope, round(regr_slope(score, CAST(8 - k AS DOUBLE)), 6) AS slope FROM r WHERE k <= 8 GROUP BY scope")
def w15(t: Tables) -> DataFrame:
    r = _days(t).withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("day").desc()))).filter("k <= 8")
    return r.groupBy("scope").agg(r6(F.regr_slope("score", (8 - F.col("k")).cast("double"))).alias("slope"))


@query("w16_tail_streak", f"WITH {_DAYS}, x AS (SELECT *, score > lag(score) OVER (PARTITION BY scope ORDER BY day) AS up FROM d), b AS (SELECT scope, max(day) FILTER (WHERE NOT coalesce(up, false)) AS stop FROM x GROUP BY scope) SELECT b.scope, count(x.day) AS n_degrading FROM b LEFT JOIN x ON x.scope = b.scope AND x.day > b.stop GROUP BY b.scope")
def w16(t: Tables) -> DataFrame:
    x = _days(t).withColumn("up", F.coalesce(F.col("score") > F.lag("score").over(Window.partitionBy("scope").orderBy("day")), F.lit(False)))
    b = x.groupBy("scope").agg(F.max(F.when(~F.col("up"), F.col("day"))).alias("stop"))
    return x.join(b, "scope").groupBy("scope").agg(F.sum((F.col("day") > F.col("stop")).cast("long")).alias("n_degrading"))


@query("w18_average_rank", "SELECT c_custkey, CAST(rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS DOUBLE) AS place FROM customer")
def w18(t: Tables) -> DataFrame:
    return W.average_rank(t.customer, "c_nationkey", "place").select("c_custkey", "place")


@query("w19_remediation", "WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id FROM events), p AS (SELECT event_type, day, lead(day) OVER (PARTITION BY event_type ORDER BY day) AS nxt FROM (SELECT DISTINCT event_type, day FROM d)), g AS (SELECT d.event_type, d.day, count(*) AS n_resolved FROM d JOIN p ON p.event_type = d.event_type AND p.day = d.day LEFT JOIN d x ON x.event_type = d.event_type AND x.day = p.nxt AND x.user_id = d.user_id WHERE p.nxt IS NOT NULL AND x.user_id IS NULL GROUP BY 1, 2) SELECT event_type, CAST(day AS VARCHAR) AS day, n_resolved FROM g")
def w19(t: Tables) -> DataFrame:
    d = t.events.select("event_type", F.to_date("ts").alias("day"), "user_id").distinct()
    p = d.select("event_type", "day").distinct().withColumn("nxt", F.lead("day").over(Window.partitionBy("event_type").orderBy("day"))).filter("nxt is not null")
    x = d.select("event_type", F.col("day").alias("nxt"), "user_id")
    return d.join(p, ["event_type", "day"]).join(x, ["event_type", "nxt", "user_id"], "left_anti").groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_resolved"))


@query("g19_recurring_clusters", "WITH c AS (SELECT event_type AS signal, user_id % 12 AS module, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n, count(DISTINCT user_id) AS files, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE value > 120 GROUP BY 1, 2) SELECT signal, module, n, files, round(days / 30.0, 6) AS rate, first_seen, last_seen FROM c WHERE n >= 3 AND days / 30.0 >= 0.5")
def g19(t: Tables) -> DataFrame:
    c = t.events.filter("value > 120").groupBy(F.col("event_type").alias("signal"), (F.col("user_id") % 12).alias("module")).agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"), F.countDistinct("user_id").alias("files"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return c.filter("n >= 3 and days / 30.0 >= 0.5").select("signal", "module", "n", "files", r6(F.col("days") / 30.0).alias("rate"), "first_seen", "last_seen")


@query("w20_context_score", "WITH h AS (SELECT user_id, count(*) AS churn, count(DISTINCT event_type) AS kinds, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id, round(0.5 * greatest(0.0, 1 - date_diff('day', CAST(seen AS DATE), DATE '2024-01-31') / 365.0) + 0.3 * least(1.0, churn / 100.0) + 0.2 * least(1.0, kinds / 5.0), 6) AS score FROM h")
def w20(t: Tables) -> DataFrame:
    h = t.events.groupBy("user_id").agg(F.count("*").alias("churn"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("seen"))
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("seen"))
    return h.select("user_id", r6(0.5 * F.greatest(F.lit(0.0), 1 - age / 365.0) + 0.3 * F.least(F.lit(1.0), F.col("churn") / 100.0) + 0.2 * F.least(F.lit(1.0), F.col("kinds") / 5.0)).alias("score"))
