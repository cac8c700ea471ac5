"""Rows whose whole contract the shorter queries of the same row leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import windows as W
from ..operators.topk import quota_top_k, top_k_per_group
from .catalog import COMMITS, FINDINGS, SEVERITY_SQL, WEIGHTS_SQL, Tables, query, r6
from .scoring_queries import _IMPACT
from .window_queries import _COUNTS, _Z

_NO_WEIGHT = "imp AS (SELECT *, CASE WHEN signal = 'signup' THEN 0.0 ELSE i END AS impact FROM (SELECT f.*, coalesce(weight, 0.1) * score * least(4.0, 1 + ln(1 + n_related)) AS i FROM findings f LEFT JOIN weights USING (signal)))"


@query("t13_quota_top_k", f"""WITH {FINDINGS}, {WEIGHTS_SQL}, {_NO_WEIGHT}, o AS (SELECT finding_id, signal, score, impact, row_number() OVER (ORDER BY round(impact, 9) DESC, finding_id) AS place, row_number() OVER (PARTITION BY signal ORDER BY round(impact, 9) DESC, finding_id) AS nth,
row_number() OVER (PARTITION BY signal ORDER BY score DESC, finding_id) AS by_score FROM imp), q AS (SELECT DISTINCT signal FROM o WHERE place <= 10),
p AS (SELECT *, CASE WHEN impact = 0 AND score >= 0.5 AND by_score = 1 THEN 0 WHEN place <= 10 THEN 1 WHEN nth = 1 AND score >= 0.5 AND signal NOT IN (SELECT signal FROM q) THEN 2 ELSE 3 END AS step FROM o)
SELECT finding_id, signal, round(impact, 6) AS impact, step FROM p QUALIFY row_number() OVER (ORDER BY step, round(impact, 9) DESC, finding_id) <= 20""")
def t13(t: Tables) -> DataFrame:
    """One row a signal without impact, then the quota of greatest impact, one of each unseen signal, and the rest by impact."""
    f = S.impact(t.findings(), t.weights()).withColumn("impact", F.when(F.col("signal") == "signup", 0.0).otherwise(F.col("impact")))
    return quota_top_k(f.withColumn("by", F.round("impact", 9)), "signal", "by", "score", "finding_id", 20, 10).select("finding_id", "signal", r6("impact").alias("impact"), "step")


@query("g34_bootstrap_interval", """WITH x AS (SELECT doc_id % 50 AS fold, quality, n_chars > 400 AS hit FROM labels JOIN documents USING (doc_id)), f AS (SELECT fold, count(*) FILTER (WHERE quality = 1 AND hit) AS tp, count(*) FILTER (WHERE quality = 0 AND hit) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT hit) AS fn FROM x GROUP BY fold),
d AS (SELECT b, CAST('0x' || substr(md5('42:' || b || ':' || i), 1, 8) AS BIGINT) % 50 AS fold FROM range(2000) r(b), range(50) s(i)), s AS (SELECT b, 2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1 FROM d JOIN f USING (fold) GROUP BY b),
o AS (SELECT coalesce(f1, 1.0) AS f1, row_number() OVER (ORDER BY coalesce(f1, 1.0)) - 1 AS i FROM s) SELECT round(max(CASE WHEN i = 50 THEN f1 END), 6) AS low, round(max(CASE WHEN i = 1950 THEN f1 END), 6) AS high FROM o""")
def g34(t: Tables) -> DataFrame:
    """The order statistics of the pooled F1 of 2,000 resamples of 50 folds, drawn by a hash of seed, resample and place, so that runs agree."""
    x = t.labels.join(t.documents.select("doc_id", (F.col("n_chars") > 400).alias("hit")), "doc_id").withColumn("fold", F.col("doc_id") % 50)
    good = F.col("quality") == 1
    f = x.groupBy("fold").agg(F.count_if(good & F.col("hit")).alias("tp"), F.count_if(~good & F.col("hit")).alias("fp"), F.count_if(good & ~F.col("hit")).alias("fn"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), "b", "i")), 1, 8), 16, 10).cast("long") % 50
    d = t.spark.range(2000).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("b", draw.alias("fold"))  # 100,000 rows, whatever the tables hold
    s = d.join(f, "fold").groupBy("b").agg((2.0 * F.sum("tp") / F.nullif(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(0))).alias("f1"))
    o = F.array_sort(F.collect_list(F.coalesce("f1", F.lit(1.0))))
    return s.agg(o.alias("o")).select(r6(F.col("o")[50]).alias("low"), r6(F.col("o")[1950]).alias("high"))


@query("g32_correlations", """WITH m AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, event_type, coalesce(n, 0) AS n FROM u CROSS JOIN k LEFT JOIN m USING (user_id, event_type))
SELECT a.event_type AS a, b.event_type AS b, round(corr(a.n, b.n), 4) AS r FROM p a JOIN p b USING (user_id) GROUP BY 1, 2""")
def g32(t: Tables) -> DataFrame:
    return S.correlations(t.events, "user_id", "event_type")


@query("g32_components")
def g32_pca(t: Tables) -> DataFrame:
    """Principal components of the matrix of signals: value, share and running share of each. Of a matrix of signals, so small whatever the table holds."""
    rows = S.correlations(t.events, "user_id", "event_type").collect()
    names = sorted({r.a for r in rows})
    values = S.principal_values([[next((r.r or 0.0) for r in rows if (r.a, r.b) == (x, y)) for y in names] for x in names])
    total, run, out = float(len(names)), 0.0, []
    for k, v in enumerate(values, 1):
        run += v / total
        out.append((k, round(v, 4), round(v / total, 4), round(run, 4)))
    return t.spark.createDataFrame(out, "component int, value double, share double, upto double")


@query("j34_undocumented", "WITH refs AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"/([a-z]+)\"', 1)) AS link FROM pages), words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS link FROM benchmark) SELECT source, count(*) AS n FROM documents WHERE source NOT IN (SELECT link FROM refs) AND source NOT IN (SELECT link FROM words) GROUP BY source")
def j34(t: Tables) -> DataFrame:
    """The other direction: folders that no text names."""
    refs = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), F.lit(1))).alias("source"))
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("source"))
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).filter("source is not null").join(refs.union(words).distinct(), "source", "left_anti")


@query("t12_recommendations", f"WITH {FINDINGS}, b AS (SELECT title, max(score) AS score FROM findings WHERE score >= 0.4 GROUP BY title), r AS (SELECT title, score, row_number() OVER (ORDER BY score DESC, title) AS place FROM b) SELECT title, round(score, 6) AS score FROM r WHERE place <= 10")
def t12(t: Tables) -> DataFrame:
    """The ten best of distinct titles, of at least medium severity."""
    b = t.findings().filter("score >= 0.4").groupBy("title").agg(F.max("score").alias("score"))
    return b.orderBy(F.desc("score"), "title").limit(10).select("title", r6("score").alias("score"))


@query("a07_dismissals_by_row", f"WITH {FINDINGS}, d AS (SELECT DISTINCT signal || file_path AS k FROM findings WHERE score >= 0.99 AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= 3 + finding_id % 14) SELECT signal, count(*) AS n FROM findings WHERE signal || file_path NOT IN (SELECT k FROM d) GROUP BY signal")
def a07(t: Tables) -> DataFrame:
    """Dismissals that each have a time to live of their own."""
    f = t.findings().withColumn("k", F.concat("signal", "file_path"))
    d = f.filter((F.col("score") >= 0.99) & (F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) <= 3 + F.col("finding_id") % 14)).select("k").distinct()
    return f.join(d, "k", "left_anti").groupBy("signal").agg(F.count("*").alias("n"))


@query("j15_misaligned_modules", f"""WITH {COMMITS}, x AS (SELECT o_custkey % 50 AS module, file, ts FROM changes JOIN commits USING (commit) JOIN orders ON o_orderkey = commit), e AS (SELECT avg(CASE WHEN ts < TIMESTAMP '1996-01-01 00:00:00' THEN 1.0 ELSE 0.0 END) >= 0.1 AS enough FROM x),
n AS (SELECT module, file FROM x GROUP BY 1, 2 HAVING min(ts) >= TIMESTAMP '1996-01-01 00:00:00') SELECT module, count(*) AS n_new, CAST(least(1.0, 0.25 * count(*)) AS DOUBLE) AS score FROM n, e WHERE enough GROUP BY module""")
def j15(t: Tables) -> DataFrame:
    """Files new to a module, with the score; nothing where less than a tenth is established."""
    x = t.changes().join(t.orders.select(F.col("o_orderkey").alias("commit"), (F.col("o_custkey") % 50).alias("module"), F.col("o_orderdate").alias("ts")), "commit")
    cut = F.lit("1996-01-01 00:00:00").cast(dict(x.dtypes)["ts"])
    enough = x.agg((F.avg((F.col("ts") < cut).cast("double")) >= 0.1).alias("enough"))  # one value
    n = x.groupBy("module", "file").agg(F.min("ts").alias("first")).filter(F.col("first") >= cut)
    return n.crossJoin(F.broadcast(enough)).filter("enough").groupBy("module").agg(F.count("*").alias("n_new")).withColumn("score", F.least(F.lit(1.0), 0.25 * F.col("n_new")))


@query("w01_volatility_by_tool", f"""WITH {_COUNTS}, a AS (SELECT file, avg(CASE WHEN is_tool THEN 1.0 ELSE 0.0 END) AS tool FROM changes JOIN commits USING (commit) GROUP BY file), z AS (SELECT file, {_Z.format('churn')} AS zc, {_Z.format('authors')} AS za, {_Z.format('fixes')} AS zf FROM h),
s AS (SELECT file, greatest(zc, za, zf) AS top, greatest(0.0, least(1.0, (zc + za + zf) / 3 / 3)) * CASE WHEN tool > 0.02 THEN 1.3 ELSE 1.0 END AS s FROM z JOIN a USING (file)), m AS (SELECT file % 7 AS space, avg(CASE WHEN top >= 0.4 THEN 1.0 ELSE 0.0 END) AS bursty FROM s GROUP BY 1)
SELECT file, round(CASE WHEN bursty >= 0.5 THEN least(s, 0.45) ELSE least(s, 1.0) END, 6) AS score FROM s JOIN m ON space = file % 7 WHERE top >= 1.5 AND s >= 0.2""")
def w01(t: Tables) -> DataFrame:
    """Volatility with the boost for files that tools write, capped in workspaces (here seven) where most files are active."""
    c = t.changes().join(t.commits(), "commit")
    h = c.groupBy("file").agg(F.count("*").cast("double").alias("churn"), F.countDistinct("author").cast("double").alias("authors"), F.sum(F.col("is_fix").cast("double")).alias("fixes"), F.avg(F.col("is_tool").cast("double")).alias("tool"))
    h = W.z_scores(h, ["churn", "authors", "fixes"]).withColumn("top", F.greatest("z_churn", "z_authors", "z_fixes"))
    h = h.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z_churn") + F.col("z_authors") + F.col("z_fixes")) / 3 / 3)) * F.when(F.col("tool") > 0.02, 1.3).otherwise(1.0)).withColumn("space", F.col("file") % 7)
    m = h.groupBy("space").agg(F.avg((F.col("top") >= 0.4).cast("double")).alias("bursty"))
    s = F.when(F.col("bursty") >= 0.5, F.least("s", F.lit(0.45))).otherwise(F.least("s", F.lit(1.0)))
    return h.join(m, "space").filter("top >= 1.5 and s >= 0.2").select("file", r6(s).alias("score"))


@query("r12_blast_by_source", f"""WITH {FINDINGS}, c AS (SELECT DISTINCT module FROM findings WHERE score > 0.999), e AS (SELECT 'src/m' || i AS a, 'src/m' || (i + 5) % 12 AS b FROM range(12) r(i)), d(id, scope, level) AS (VALUES ('d1', 'src/m1', 'high'), ('d2', 'src/m[23]', 'medium')),
i AS (SELECT 'arch' AS kind, b AS target, 'medium' AS severity FROM e JOIN c ON module = a UNION SELECT 'adr', id, level FROM d JOIN c ON regexp_full_match(module, scope) UNION SELECT 'policy', signal, {SEVERITY_SQL.format('max(score)')} FROM findings WHERE score > 0.999 GROUP BY signal)
SELECT kind, target, severity FROM i""")
def r12(t: Tables) -> DataFrame:
    """What a change of modules touches: modules one edge on, decisions over their paths, and signals that fire in them."""
    f = t.findings().filter("score > 0.999")
    c = f.select("module").distinct()
    e = t.spark.range(12).select(F.concat(F.lit("src/m"), "id").alias("module"), F.concat(F.lit("src/m"), (F.col("id") + 5) % 12).alias("target"))
    d = F.broadcast(t.spark.createDataFrame([("d1", "src/m1", "high"), ("d2", "src/m[23]", "medium")], "target string, scope string, severity string"))  # a configuration
    row = lambda df, kind, severity="severity": df.select(F.lit(kind).alias("kind"), "target", F.col(severity).alias("severity") if severity in df.columns else F.lit(severity).alias("severity"))
    from ..functions.exprs import severity

    arch = row(e.join(c, "module"), "arch", "medium")
    adr = row(c.join(d, F.expr("module rlike concat('^', scope, '$')")), "adr")
    policy = row(f.groupBy(F.col("signal").alias("target")).agg(severity(F.max("score")).alias("severity")), "policy")
    return arch.unionByName(adr).unionByName(policy).distinct()


@query("p10_precedence", f"""WITH {FINDINGS}, rules(place, pattern, context) AS (VALUES (1, 'f1[0-9]*[.]py$', 'fixture'), (2, '^src/m[0-3]/', 'migration'), (3, '/m1', 'docs')), m AS (SELECT finding_id, min(place) AS place FROM findings JOIN rules ON regexp_matches(file_path, pattern) GROUP BY 1)
SELECT coalesce(context, 'production') AS context, context IS NULL AS operational, count(*) AS n FROM findings LEFT JOIN m USING (finding_id) LEFT JOIN rules USING (place) GROUP BY 1, 2""")
def p10(t: Tables) -> DataFrame:
    """The first of the configured rules that matches a path; findings without one are operational."""
    rules = F.broadcast(t.spark.createDataFrame([(1, "f1[0-9]*[.]py$", "fixture"), (2, "^src/m[0-3]/", "migration"), (3, "/m1", "docs")], "place int, pattern string, context string"))  # a configuration
    f = t.findings().select("finding_id", "file_path").join(rules, F.expr("file_path rlike pattern"), "left").groupBy("finding_id").agg(F.min_by("context", "place").alias("context"))
    return f.groupBy(F.coalesce("context", F.lit("production")).alias("context"), F.col("context").isNull().alias("operational")).agg(F.count("*").alias("n"))


@query("p14_deferred_by_table", f"""WITH {FINDINGS}, areas(place, pattern, area) AS (VALUES (1, '^src/m4/.*$', 'legacy'), (2, '^src/m5/f[^/]*$', 'frozen'), (3, '^src/m9/.*[.]py$', 'later')), m AS (SELECT finding_id, min(place) AS place FROM findings JOIN areas ON regexp_matches(file_path, pattern) GROUP BY 1)
SELECT area, count(*) AS n FROM findings LEFT JOIN m USING (finding_id) LEFT JOIN areas USING (place) GROUP BY 1""")
def p14(t: Tables) -> DataFrame:
    """Areas by the first of a table of globs."""
    from ..functions.exprs import glob_regex

    rows = [(k, glob_regex(g), a) for k, (g, a) in enumerate((("src/m4/**", "legacy"), ("src/m5/f*", "frozen"), ("src/m9/**.py", "later")), 1)]
    areas = F.broadcast(t.spark.createDataFrame(rows, "place int, pattern string, area string"))  # a configuration
    f = t.findings().select("finding_id", "file_path").join(areas, F.expr("file_path rlike pattern"), "left").groupBy("finding_id").agg(F.min_by("area", "place").alias("area"))
    return f.groupBy("area").agg(F.count("*").alias("n"))
