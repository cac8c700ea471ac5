"""Scoring, calibration and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import scoring as S
from .catalog import FINDINGS, SEVERITY_SQL, WEIGHTS_SQL, Tables, query, r6

_DAMP = "{s} / {n} * least(1.0, ln(1 + {n}) / ln(21))"
_SIGNALS = f"sig AS (SELECT signal, count(*) AS n, sum(score) / count(*) * least(1.0, ln(1 + count(*)) / ln(21)) AS signal_score FROM findings GROUP BY signal)"


@query("g01_signal_scores", f"WITH {FINDINGS}, {_SIGNALS} SELECT signal, n, round(signal_score, 6) AS signal_score FROM sig")
def g01(t: Tables) -> DataFrame:
    return S.signal_scores(t.findings()).select("signal", "n", r6("signal_score").alias("signal_score"))


@query("g02_composite_score", f"WITH {FINDINGS}, {WEIGHTS_SQL}, {_SIGNALS}, c AS (SELECT least(1.0, sum(weight * signal_score) / sum(weight)) AS composite FROM sig JOIN weights USING (signal)) SELECT round(composite, 6) AS composite, CASE WHEN composite >= 0.8 THEN 'F' WHEN composite >= 0.6 THEN 'D' WHEN composite >= 0.4 THEN 'C' WHEN composite >= 0.2 THEN 'B' ELSE 'A' END AS grade FROM c")
def g02(t: Tables) -> DataFrame:
    return S.composite(S.signal_scores(t.findings()), t.weights()).select(r6("composite").alias("composite"), X.grade(F.col("composite")).alias("grade"))


@query("g03_module_scores", f"WITH {FINDINGS}, {WEIGHTS_SQL}, sig AS (SELECT module, signal, sum(score) / count(*) * least(1.0, ln(1 + count(*)) / ln(21)) AS s FROM findings GROUP BY module, signal) SELECT module, round(least(1.0, sum(weight * s) / sum(weight)), 6) AS composite FROM sig JOIN weights USING (signal) GROUP BY module")
def g03(t: Tables) -> DataFrame:
    return S.composite(S.signal_scores(t.findings(), ("module",)), t.weights(), ("module",)).select("module", r6("composite").alias("composite"))


_IMPACT = "imp AS (SELECT f.*, coalesce(weight, 0.1) * score * least(4.0, 1 + ln(1 + n_related)) AS impact FROM findings f LEFT JOIN weights USING (signal))"


@query("g04_impact", f"WITH {FINDINGS}, {WEIGHTS_SQL}, {_IMPACT} SELECT finding_id, round(impact, 6) AS impact FROM imp")
def g04(t: Tables) -> DataFrame:
    return S.impact(t.findings(), t.weights()).select("finding_id", r6("impact").alias("impact"))


@query("g05_recalibrated_weights", f"WITH {FINDINGS}, {WEIGHTS_SQL}, g AS (SELECT signal, weight, count(finding_id) AS n FROM weights LEFT JOIN findings USING (signal) GROUP BY signal, weight), s AS (SELECT *, n / sum(n) OVER () AS share FROM g), r AS (SELECT *, weight * CASE WHEN share > 0.2 THEN greatest(0.5, 1 - (share - 0.2)) ELSE 1 END AS raw FROM s) SELECT signal, round(share, 6) AS share, round(raw * sum(weight) OVER () / sum(raw) OVER (), 6) AS new_weight FROM r")
def g05(t: Tables) -> DataFrame:
    return S.recalibrated(t.findings(), t.weights(), cap=0.2).select("signal", r6("share").alias("share"), r6("new_weight").alias("new_weight"))


@query("p08_path_overrides", f"""WITH {FINDINGS}, o(pattern, skip, factor) AS (VALUES ('^src/m1[^/]*/.*$', 'click', 0.5), ('^src/m1/.*$', 'error', 0.25), ('^src/m[23]/.*$', '', 2.0)),
m AS (SELECT f.finding_id, f.signal, f.score, o.skip, o.factor, row_number() OVER (PARTITION BY f.finding_id ORDER BY length(o.pattern) DESC NULLS LAST) AS rn FROM findings f LEFT JOIN o ON regexp_matches(f.file_path, o.pattern))
SELECT finding_id, round(score * coalesce(factor, 1.0), 6) AS weighted FROM m WHERE rn = 1 AND coalesce(skip, '') <> signal""")
def p08(t: Tables) -> DataFrame:
    o = t.spark.createDataFrame([("^src/m1[^/]*/.*$", "click", 0.5), ("^src/m1/.*$", "error", 0.25), ("^src/m[23]/.*$", "", 2.0)], "pattern string, skip string, factor double")
    # The rules are a configuration: a few rows, each tested against every path. The longest pattern wins.
    j = t.findings().join(F.broadcast(o), F.expr("file_path rlike pattern"), "left").groupBy("finding_id", "signal", "score").agg(F.max_by(F.struct("skip", "factor"), F.length("pattern")).alias("o"))
    return j.filter(F.coalesce("o.skip", F.lit("")) != F.col("signal")).select("finding_id", r6(F.col("score") * F.coalesce("o.factor", F.lit(1.0))).alias("weighted"))


@query("p11_severity_gate", f"WITH {FINDINGS} SELECT module, count(*) FILTER (WHERE score >= 0.6) AS at_or_above, count(*) FILTER (WHERE score >= 0.6) = 0 AS passed FROM findings GROUP BY module")
def p11(t: Tables) -> DataFrame:
    n = F.sum((X.severity_rank(X.severity(F.col("score"))) <= X.SEVERITY_RANK["high"]).cast("long"))
    return t.findings().groupBy("module").agg(n.alias("at_or_above"), (n == 0).alias("passed"))


@query("f13_severity", f"WITH {FINDINGS} SELECT {SEVERITY_SQL.format('score')} AS severity, count(*) AS n FROM findings GROUP BY 1")
def f13(t: Tables) -> DataFrame:
    return t.findings().groupBy(X.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"))


# Verdicts: of each labelled document, quality says whether a finding was right, toxic whether one was missed; the language is the signal.
_FEEDBACK = "fb AS (SELECT lang AS signal, CASE WHEN toxic = 1 THEN 'fn' WHEN quality = 1 THEN 'tp' ELSE 'fp' END AS verdict FROM labels JOIN documents USING (doc_id))"
_METRICS = "m AS (SELECT signal, count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'fn') AS fn FROM fb GROUP BY signal)"


def _feedback(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("signal"), F.when(F.col("toxic") == 1, "fn").when(F.col("quality") == 1, "tp").otherwise("fp").alias("verdict"))


@query("g15_feedback_counts", f"WITH {_FEEDBACK}, {_METRICS} SELECT * FROM m")
def g15(t: Tables) -> DataFrame:
    return _feedback(t).groupBy("signal").pivot("verdict", ["tp", "fp", "fn"]).count().na.fill(0)


@query("g16_feedback_metrics", f"WITH {_FEEDBACK}, {_METRICS}, r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM m) SELECT signal, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r")
def g16(t: Tables) -> DataFrame:
    return S.feedback_metrics(_feedback(t)).select("signal", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("g17_calibrated_weights", f"WITH {_FEEDBACK}, {_METRICS}, w(signal, weight) AS (VALUES ('de', 0.2), ('en', 0.4), ('es', 0.3), ('xx', 0.1)), j AS (SELECT w.signal, CAST(weight AS DOUBLE) AS weight, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM w LEFT JOIN m USING (signal)), c AS (SELECT *, least(1.0, (tp + fp + fn) / 20) AS sure, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE fn / (tp + fn) END AS miss FROM j) SELECT signal, round(sure, 6) AS confidence, round(greatest(0.001, weight * (1 - sure) + weight * p * sure + 0.1 * weight * miss * sure), 6) AS new_weight FROM c")
def g17(t: Tables) -> DataFrame:
    w = t.spark.createDataFrame([("de", 0.2), ("en", 0.4), ("es", 0.3), ("xx", 0.1)], "signal string, weight double")
    return S.calibrated_weights(w, S.feedback_metrics(_feedback(t))).select("signal", r6("confidence").alias("confidence"), r6("new_weight").alias("new_weight"))


@query("g18_effort", "WITH o AS (SELECT o_orderpriority AS signal, date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) AS days_to_fix, o_orderstatus = 'P' AS suppressed FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate GROUP BY o_orderkey, o_orderpriority, o_orderdate, o_orderstatus) SELECT signal, count(*) AS n, round(median(days_to_fix), 6) AS median_days, CASE WHEN median(days_to_fix) <= 1 THEN 'low' WHEN median(days_to_fix) <= 5 THEN 'medium' ELSE 'high' END AS effort FROM o WHERE NOT suppressed GROUP BY signal HAVING count(*) >= 10")
def g18(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem.select("l_orderkey", "l_shipdate"), F.expr("o_orderkey = l_orderkey and l_shipdate >= o_orderdate"))
    o = j.groupBy("o_orderkey", F.col("o_orderpriority").alias("signal"), "o_orderdate", (F.col("o_orderstatus") == "P").alias("suppressed")).agg(F.datediff(F.min("l_shipdate"), "o_orderdate").alias("days_to_fix"))
    return S.effort(o).select("signal", "n", r6("median_days").alias("median_days"), "effort")


@query("g22_merge_report", "SELECT o_orderstatus AS author_type, count(*) AS n, round(avg(o_totalprice), 4) AS mean_delta, round(coalesce(stddev_pop(o_totalprice), 0), 4) AS spread, count(*) FILTER (WHERE o_totalprice > 250000) AS regressing FROM orders GROUP BY o_orderstatus")
def g22(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("author_type")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_delta"), F.round(F.coalesce(F.stddev_pop("o_totalprice"), F.lit(0.0)), 4).alias("spread"), F.sum((F.col("o_totalprice") > 250000).cast("long")).alias("regressing"))


@query("g23_grouped_findings", f"WITH {FINDINGS} SELECT module, {SEVERITY_SQL.format('score')} AS severity, count(*) AS n, min(finding_id) AS first_id, max(finding_id) AS last_id FROM findings GROUP BY 1, 2")
def g23(t: Tables) -> DataFrame:
    return t.findings().groupBy("module", X.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"), F.min("finding_id").alias("first_id"), F.max("finding_id").alias("last_id"))


@query("g24_scope_risk", f"WITH {FINDINGS}, {WEIGHTS_SQL}, r AS (SELECT module, sum(weight * score * s) / sum(weight * s) AS risk FROM (SELECT module, weight, score, 5 - CASE WHEN score >= 0.8 THEN 0 WHEN score >= 0.6 THEN 1 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 3 ELSE 4 END AS s FROM findings JOIN weights USING (signal)) GROUP BY module) SELECT module, round(risk, 6) AS risk, CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM r")
def g24(t: Tables) -> DataFrame:
    j = t.findings().join(t.weights(), "signal").withColumn("s", 5 - X.severity_rank(X.severity(F.col("score"))))
    g = j.groupBy("module").agg((F.sum(F.col("weight") * F.col("score") * F.col("s")) / F.sum(F.col("weight") * F.col("s"))).alias("risk"))
    return g.select("module", r6("risk").alias("risk"), F.when(F.col("risk") >= 0.7, "high").when(F.col("risk") >= 0.4, "medium").otherwise("low").alias("level"))


@query("g25_partial_scores", f"WITH {FINDINGS}, old AS (SELECT signal, count(*) AS n, sum(score) AS s FROM findings WHERE finding_id % 10 <> 0 GROUP BY signal), new AS (SELECT signal, count(*) AS n, sum(score) AS s FROM findings WHERE finding_id % 10 = 0 GROUP BY signal), u AS (SELECT signal, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY signal) SELECT signal, n, round({_DAMP.format(s='s', n='n')}, 6) AS signal_score FROM u")
def g25(t: Tables) -> DataFrame:
    f = t.findings()
    part = lambda x: x.groupBy("signal").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    u = part(f.filter("finding_id % 10 <> 0")).unionByName(part(f.filter("finding_id % 10 = 0"))).groupBy("signal").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return u.select("signal", "n", r6(S.dampened(F.col("s"), F.col("n"))).alias("signal_score"))


@query("g30_fleiss_kappa", "WITH r AS (SELECT doc_id, quality AS c FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, CAST(doc_id % 2 AS INTEGER) FROM labels), cell AS (SELECT doc_id, c, count(*) AS k FROM r GROUP BY doc_id, c), per AS (SELECT doc_id, sum(k) AS n, sum(k * (k - 1)) AS p FROM cell GROUP BY doc_id), o AS (SELECT avg(p / (n * (n - 1))) AS po FROM per), s AS (SELECT sum(x * x) AS pe FROM (SELECT sum(k) / sum(sum(k)) OVER () AS x FROM cell GROUP BY c)) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM o, s")
def g30(t: Tables) -> DataFrame:
    r = t.labels.select("doc_id", F.explode(F.array("quality", "toxic", (F.col("doc_id") % 2).cast("int"))).alias("c"))
    return S.fleiss_kappa(r, "doc_id", "c").select(*(r6(c).alias(c) for c in ("po", "pe", "kappa")))


@query("g30_cohen_kappa", "WITH n AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY 1, 2), t AS (SELECT sum(c) AS t, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same FROM n), x AS (SELECT sum(l.x * r.y) AS xy FROM (SELECT a AS v, sum(c) AS x FROM n GROUP BY a) l JOIN (SELECT b AS v, sum(c) AS y FROM n GROUP BY b) r USING (v)) SELECT round(same / t, 6) AS po, round(xy / (t * t), 6) AS pe, round((same / t - xy / (t * t)) / (1 - xy / (t * t)), 6) AS kappa FROM t, x")
def g30b(t: Tables) -> DataFrame:
    return S.cohen_kappa(t.labels, "quality", "toxic").select(*(r6(c).alias(c) for c in ("po", "pe", "kappa")))


@query("g31_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def g31(t: Tables) -> DataFrame:
    from ..operators.windows import average_rank

    x = t.customer.join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).count(), "c_custkey", "left").na.fill(0, ["count"])
    x = average_rank(average_rank(x, "c_acctbal", "a"), "count", "b")
    return x.agg(r6(F.corr("a", "b")).alias("rho"), F.count("*").alias("n"))


@query("g32_signal_matrix", "WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT u.user_id, coalesce(max(CASE WHEN event_type = 'click' THEN n END), 0) AS click, coalesce(max(CASE WHEN event_type = 'view' THEN n END), 0) AS view, coalesce(max(CASE WHEN event_type = 'error' THEN n END), 0) AS error FROM m u GROUP BY u.user_id) SELECT round(corr(click, view), 4) AS click_view, round(corr(click, error), 4) AS click_error, round(corr(view, error), 4) AS view_error FROM p")
def g32(t: Tables) -> DataFrame:
    p = t.events.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count().na.fill(0)
    return p.agg(*(F.round(F.corr(a, b), 4).alias(f"{a}_{b}") for a, b in (("click", "view"), ("click", "error"), ("view", "error"))))


@query("g33_false_positive_rate", f"WITH {_FEEDBACK} SELECT signal, count(*) AS n, round(count(*) FILTER (WHERE verdict = 'fp') / nullif(count(*) FILTER (WHERE verdict IN ('tp', 'fp')), 0), 6) AS fp_rate FROM fb GROUP BY signal HAVING count(*) >= 10")
def g33(t: Tables) -> DataFrame:
    f = F.col("verdict")
    g = _feedback(t).groupBy("signal").agg(F.count("*").alias("n"), r6(F.avg(F.when(f.isin("tp", "fp"), (f == "fp").cast("double")))).alias("fp_rate"))
    return g.filter("n >= 10")


@query("g35_ratings", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_size, round(median(n_chars), 4) AS median_size, round(100.0 * count(*) FILTER (WHERE n_chars >= 2000) / count(*), 4) AS percent_long FROM documents GROUP BY lang")
def g35(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_size"), F.round(F.median("n_chars"), 4).alias("median_size"), F.round(100 * F.avg((F.col("n_chars") >= 2000).cast("double")), 4).alias("percent_long"))


@query("g36_top_signals", f"WITH {FINDINGS} SELECT signal, count(*) AS n FROM findings GROUP BY signal ORDER BY n DESC, signal LIMIT 3")
def g36(t: Tables) -> DataFrame:
    return t.findings().groupBy("signal").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "signal").limit(3)


@query("g37_weight_sensitivity", f"WITH {FINDINGS}, {WEIGHTS_SQL}, sig AS (SELECT module, signal, sum(score) / count(*) * least(1.0, ln(1 + count(*)) / ln(21)) AS s FROM findings GROUP BY module, signal), grid AS (SELECT signal AS bent, f AS factor FROM weights, (VALUES (0.5), (1.5)) v(f)), c AS (SELECT bent, factor, module, sum(CASE WHEN signal = bent THEN weight * factor ELSE weight END * s) / sum(CASE WHEN signal = bent THEN weight * factor ELSE weight END) AS c FROM grid, sig JOIN weights USING (signal) GROUP BY bent, factor, module) SELECT bent, CAST(factor AS DOUBLE) AS factor, module, round(c, 6) AS composite, CAST(rank() OVER (PARTITION BY bent, factor ORDER BY round(c, 9) DESC, module) AS INTEGER) AS place FROM c")
def g37(t: Tables) -> DataFrame:
    grid = t.weights().select(F.col("signal").alias("bent"), F.explode(F.array(F.lit(0.5), F.lit(1.5))).alias("factor"))
    # The grid has two rows a signal, so this multiplies the module scores by a constant.
    j = S.signal_scores(t.findings(), ("module",)).join(t.weights(), "signal").crossJoin(F.broadcast(grid))
    j = j.withColumn("weight", F.when(F.col("signal") == F.col("bent"), F.col("weight") * F.col("factor")).otherwise(F.col("weight")))
    c = j.groupBy("bent", "factor", "module").agg((F.sum(F.col("weight") * F.col("signal_score")) / F.sum("weight")).alias("c"))
    return c.select("bent", "factor", "module", r6("c").alias("composite"), F.rank().over(Window.partitionBy("bent", "factor").orderBy(F.round("c", 9).desc(), "module")).alias("place"))


@query("g39_outcome_summary", "SELECT o_orderpriority AS signal, o_orderstatus AS edit_kind, count(*) AS n, count(*) FILTER (WHERE o_totalprice < 150000) AS improving, count(*) FILTER (WHERE o_totalprice > 350000) AS regressing, round(CASE WHEN count(*) FILTER (WHERE o_totalprice < 150000 OR o_totalprice > 350000) >= 5 THEN count(*) FILTER (WHERE o_totalprice < 150000) / count(*) FILTER (WHERE o_totalprice < 150000 OR o_totalprice > 350000) END, 6) AS confidence FROM orders GROUP BY 1, 2")
def g39(t: Tables) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    up, down = n(F.col("o_totalprice") < 150000), n(F.col("o_totalprice") > 350000)
    return t.orders.groupBy(F.col("o_orderpriority").alias("signal"), F.col("o_orderstatus").alias("edit_kind")).agg(F.count("*").alias("n"), up.alias("improving"), down.alias("regressing"), r6(F.when(up + down >= 5, up / (up + down))).alias("confidence"))


@query("t01_priority_sort", f"WITH {FINDINGS}, {WEIGHTS_SQL}, {_IMPACT}, r AS (SELECT finding_id, impact, CASE WHEN score >= 0.8 THEN 0 WHEN score >= 0.6 THEN 1 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 3 ELSE 4 END AS sev, file_path, start_line FROM imp) SELECT finding_id, sev, round(impact, 6) AS impact FROM r ORDER BY sev, round(impact, 9) DESC, file_path, start_line, finding_id LIMIT 50")
def t01(t: Tables) -> DataFrame:
    f = S.impact(t.findings(), t.weights()).withColumn("sev", X.severity_rank(X.severity(F.col("score"))))
    return f.orderBy("sev", F.round("impact", 9).desc(), "file_path", "start_line", "finding_id").limit(50).select("finding_id", "sev", r6("impact").alias("impact"))


@query("t11_capped_rules", f"WITH {FINDINGS}, d AS (SELECT signal, module, max(score) AS score FROM findings GROUP BY signal, module), r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, module) AS rn FROM d) SELECT signal, module, round(score, 6) AS score FROM r WHERE rn <= 4 ORDER BY score DESC, signal, module LIMIT 15")
def t11(t: Tables) -> DataFrame:
    d = t.findings().groupBy("signal", "module").agg(F.max("score").alias("score"))
    r = d.withColumn("rn", F.row_number().over(Window.partitionBy("signal").orderBy(F.col("score").desc(), "module"))).filter("rn <= 4")
    return r.orderBy(F.col("score").desc(), "signal", "module").limit(15).select("signal", "module", r6("score").alias("score"))


@query("t13_diverse_top_k", f"WITH {FINDINGS}, {WEIGHTS_SQL}, {_IMPACT}, r AS (SELECT finding_id, signal, impact, row_number() OVER (PARTITION BY signal ORDER BY round(impact, 9) DESC, finding_id) AS nth FROM imp), s AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, round(impact, 9) DESC, finding_id) AS place FROM r) SELECT finding_id, signal, round(impact, 6) AS impact FROM s WHERE place <= 20")
def t13(t: Tables) -> DataFrame:
    from ..operators.topk import diverse_top_k

    f = S.impact(t.findings(), t.weights()).withColumn("rank_by", F.round("impact", 9))
    return diverse_top_k(f, "signal", "rank_by", "finding_id", 20).select("finding_id", "signal", r6("impact").alias("impact"))


@query("a02_effort_estimate", f"WITH {FINDINGS}, h(signal, hours) AS (VALUES ('click', 2.0), ('error', 0.5)) SELECT signal, count(*) AS n, CAST(round(count(*) * coalesce(max(hours), 1.0), 1) AS DOUBLE) AS hours FROM findings LEFT JOIN h USING (signal) GROUP BY signal")
def a02(t: Tables) -> DataFrame:
    h = t.spark.createDataFrame([("click", 2.0), ("error", 0.5)], "signal string, hours double")
    return t.findings().groupBy("signal").agg(F.count("*").alias("n")).join(h, "signal", "left").select("signal", "n", F.round(F.col("n") * F.coalesce("hours", F.lit(1.0)), 1).alias("hours"))


@query("a04_traffic_light", f"WITH {FINDINGS}, g AS (SELECT module, avg(score) AS s, bool_or(score >= 0.995) AS critical, bool_or(score >= 0.6) AS high FROM findings GROUP BY module) SELECT module, CASE WHEN s >= 0.65 OR critical THEN 'RED' WHEN s >= 0.35 OR high THEN 'YELLOW' ELSE 'GREEN' END AS light FROM g")
def a04(t: Tables) -> DataFrame:
    s, red, high = F.avg("score"), F.bool_or(F.col("score") >= 0.995), F.bool_or(F.col("score") >= 0.6)
    return t.findings().groupBy("module").agg(F.when((s >= 0.65) | red, "RED").when((s >= 0.35) | high, "YELLOW").otherwise("GREEN").alias("light"))


@query("a08_top_signal_scores", f"WITH {FINDINGS} SELECT signal, round(max(score), 6) AS score, count(*) AS n FROM findings WHERE score < 0.99 GROUP BY signal")
def a08(t: Tables) -> DataFrame:
    return t.findings().filter("score < 0.99").groupBy("signal").agg(r6(F.max("score")).alias("score"), F.count("*").alias("n"))
