"""Records of repositories, decisions, cycles and reports on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.topk import top_k_per_group
from .catalog import COMMITS, FINDINGS, SEVERITY_SQL, Tables, query, r6


def _layer(c: str):
    return F.when(F.col(c) % 4 == 3, -1).otherwise(F.col(c) % 4)


@query("j06_hidden_co_change", f"""WITH {COMMITS}, s AS (SELECT commit FROM changes GROUP BY commit HAVING count(*) BETWEEN 2 AND 20), c AS (SELECT * FROM changes SEMI JOIN s USING (commit)),
n AS (SELECT file, count(*) AS own FROM c GROUP BY file), p AS (SELECT a.file AS a, b.file AS b, count(*) AS k FROM c a JOIN c b USING (commit) WHERE a.file < b.file GROUP BY 1, 2),
q AS (SELECT a, b, k, k / CAST(least(x.own, y.own) AS DOUBLE) AS sure FROM p JOIN n x ON x.file = a JOIN n y ON y.file = b WHERE k >= 2), t AS (SELECT * FROM q ORDER BY k DESC, a, b LIMIT 10)
SELECT a, b, k, round(least(1.0, round(sure * 0.7, 2)), 6) AS score FROM t WHERE a % 10 <> b % 10 AND NOT (b = 2 * a)""")
def j06(t: Tables) -> DataFrame:
    """The ten pairs that change together most, without an edge between them in either direction, nor one folder (the last digit)."""
    size = t.changes().groupBy("commit").agg(F.count("*").alias("n")).filter("n between 2 and 20")
    c = t.changes().join(size, "commit", "left_semi")
    own = c.groupBy("file").agg(F.count("*").alias("own"))
    pairs = c.select("commit", F.col("file").alias("a")).join(c.select("commit", F.col("file").alias("b")), "commit").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k")).filter("k >= 2")
    top = pairs.orderBy(F.desc("k"), "a", "b").limit(10).join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    edges = t.changes().select(F.col("file").alias("a"), (2 * F.col("file")).alias("b")).distinct()
    top = top.join(edges, ["a", "b"], "left_anti").filter("a % 10 <> b % 10")
    return top.select("a", "b", "k", r6(F.least(F.lit(1.0), F.round(F.col("k") / F.least("x", "y") * 0.7, 2))).alias("score"))


_DECISIONS = [("d1", "src/m1/.*", "", "block"), ("d2", "src/m[23]/.*", "", "warn"), ("d3", "", "click", "warn"), ("d4", "src/m9/f1.*", "", "info")]


@query("j27_decisions_by_scope", f"""WITH {FINDINGS}, d(id, scope, word, level) AS (VALUES {", ".join(str(d) for d in _DECISIONS)}), g AS (SELECT finding_id, id, level FROM findings JOIN d ON scope <> '' AND regexp_full_match(file_path, scope)),
w AS (SELECT finding_id, id, level FROM findings ANTI JOIN g USING (finding_id) JOIN d ON word <> '' AND contains(title, word)) SELECT id, level, count(*) AS n FROM (SELECT * FROM g UNION ALL SELECT * FROM w) GROUP BY 1, 2""")
def j27(t: Tables) -> DataFrame:
    """Decisions by the scope of the path; findings that no scope matches, by a word of their title."""
    f = t.findings().select("finding_id", "file_path", "title")
    d = F.broadcast(t.spark.createDataFrame(_DECISIONS, "id string, scope string, word string, level string"))  # a configuration
    g = f.join(d, F.expr("scope <> '' and file_path rlike concat('^', scope, '$')")).select("finding_id", "id", "level")
    w = f.join(g.select("finding_id").distinct(), "finding_id", "left_anti").join(d, F.expr("word <> '' and contains(title, word)")).select("finding_id", "id", "level")
    return g.unionByName(w).groupBy("id", "level").agg(F.count("*").alias("n"))


@query("p20_relevant_decisions", f"""WITH d(id, scope, word, level) AS (VALUES {", ".join(str(d) for d in _DECISIONS)}), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT id, count(*) AS n FROM b JOIN d ON list_contains(w, 'the') AND length(scope) % 2 = 0 OR (word <> '' AND list_contains(w, word)) GROUP BY id""")
def p20(t: Tables) -> DataFrame:
    """Decisions that a task's words ask for, or whose scope is named."""
    b = t.benchmark.select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    d = F.broadcast(t.spark.createDataFrame(_DECISIONS, "id string, scope string, word string, level string"))  # a configuration
    return b.join(d, F.expr("(array_contains(w, 'the') and length(scope) % 2 = 0) or (word <> '' and array_contains(w, word))")).groupBy("id").agg(F.count("*").alias("n"))


@query("j36_cluster_feedback", f"""WITH {FINDINGS}, c AS (SELECT signal, module, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM findings GROUP BY 1, 2 HAVING count(*) >= 3), fb AS (SELECT event_type AS signal, count(*) FILTER (WHERE value > 100) AS tp, count(*) FILTER (WHERE value <= 5) AS fp FROM events GROUP BY 1)
SELECT signal, module, n, days, tp, fp, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision FROM c LEFT JOIN fb USING (signal)""")
def j36(t: Tables) -> DataFrame:
    c = t.findings().groupBy("signal", "module").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days")).filter("n >= 3")
    fb = t.events.groupBy(F.col("event_type").alias("signal")).agg(F.count_if(F.col("value") > 100).alias("tp"), F.count_if(F.col("value") <= 5).alias("fp"))
    return c.join(fb, "signal", "left").select("signal", "module", "n", "days", "tp", "fp", r6(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"))


@query("w11_richest_route", """WITH r AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS route, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN starts_with(route, '/') THEN 2 ELSE 1 END DESC, length(route) DESC, route, page_id) AS i FROM r) SELECT host, route FROM k WHERE i = 1""")
def w11(t: Tables) -> DataFrame:
    """Of each endpoint's routes the most specific: rooted, then longest. By max_by, so a hot endpoint isn't sorted."""
    r = t.pages.select(F.regexp_replace("url", "^https?://[^/]*", "").alias("route"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), "page_id")
    rank = F.struct(-F.when(F.col("route").startswith("/"), 2).otherwise(1), -F.length("route"), "route", "page_id")
    return r.groupBy("host").agg(F.min_by("route", rank).alias("route"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_quantity = 50 AND l_discount < 0.02)"


def _cycle_edges(t: Tables) -> DataFrame:
    """A ring of suppliers in each nation, by key, with chords."""
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"))
    w = Window.partitionBy("g").orderBy("k")
    n = s.groupBy("g").agg(F.min("k").alias("first"))
    ring = s.withColumn("next", F.lead("k").over(w)).join(n, "g").select(F.col("k").alias("src"), F.coalesce("next", "first").alias("dst"), "g")
    return ring.filter("src <> dst")


_RING = """r AS (SELECT s_suppkey AS src, s_nationkey AS g, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS dst FROM supplier), e AS (SELECT * FROM r WHERE src <> dst)"""


@query("t06_largest_components", f"WITH {_RING}, c AS (SELECT g, min(src) AS component, count(*) AS size FROM e GROUP BY g HAVING count(*) > 1) SELECT component, size FROM c ORDER BY size DESC, component LIMIT 5")
def t06(t: Tables) -> DataFrame:
    from ..operators.graph import strong_components

    c = strong_components(_cycle_edges(t).select("src", "dst"))
    return c.groupBy("component").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "component").limit(5)


@query("r03_shortest_cycles", f"WITH {_RING} SELECT min(src) AS first, count(*) AS length, round(CAST(least(1.0, 0.3 + 0.1 * count(*)) AS DOUBLE), 6) AS score FROM e GROUP BY g")
def r03(t: Tables) -> DataFrame:
    """One cycle a strong component: the shortest through its least node, found by widening rounds within the component."""
    from ..operators.graph import component_cycles

    c = component_cycles(_cycle_edges(t).select("src", "dst"))
    return c.select(F.col("component").alias("first"), F.col("length").cast("long").alias("length"), r6(F.least(F.lit(1.0), 0.3 + 0.1 * F.col("length"))).alias("score"))


@query("r08_topological_order", """WITH d AS (SELECT DISTINCT CAST(floor(log2(c_custkey + 1)) AS BIGINT) AS level, c_custkey AS node FROM customer) SELECT node, row_number() OVER (ORDER BY level, node) AS place FROM d""")
def r08(t: Tables) -> DataFrame:
    """A topological order by level, ties by key: each customer depends on the one of half its number. Places come from counts of levels."""
    from ..operators.graph import topological_order

    k = t.customer.select(F.col("c_custkey").alias("node"))
    return topological_order(k, k.filter("node > 0").select(F.floor((F.col("node") - 1) / 2).alias("src"), F.col("node").alias("dst")))


@query("r11_seeded_graph", f"""WITH {FINDINGS}, m AS (SELECT module, count(*) AS n, round(avg(score), 6) AS score FROM findings GROUP BY module), rules(layer, pattern) AS (VALUES ('ui', 'src/m[0-3]'), ('core', 'src/m[4-7]'), ('data', 'src/m([89]|1[01])'))
SELECT module, coalesce(layer, 'none') AS layer, n, score FROM m LEFT JOIN rules ON regexp_full_match(module, pattern)""")
def r11(t: Tables) -> DataFrame:
    m = t.findings().groupBy("module").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("score"))
    rules = F.broadcast(t.spark.createDataFrame([("ui", "src/m[0-3]"), ("core", "src/m[4-7]"), ("data", "src/m([89]|1[01])")], "layer string, pattern string"))  # a configuration
    return m.join(rules, F.expr("module rlike concat('^(', pattern, ')$')"), "left").select("module", F.coalesce("layer", F.lit("none")).alias("layer"), "n", "score")


@query("g21_skill_briefings", f"""WITH {FINDINGS}, h AS (SELECT module, signal, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM findings WHERE score > 0.5 GROUP BY 1, 2 HAVING count(*) >= 4),
b AS (SELECT module, count(*) AS signals, sum(n) AS hits, round(least(0.95, 0.5 + 0.1 * (count(*) - 1) + 0.02 * max(days)), 6) AS confidence FROM h GROUP BY module), e AS (SELECT DISTINCT module, 'src/m' || (CAST(substr(module, 6) AS INT) + 1) % 12 AS other FROM findings)
SELECT b.module, signals, CAST(hits AS BIGINT) AS hits, confidence, string_agg(DISTINCT other, ',' ORDER BY other) AS neighbours FROM b JOIN e ON e.module = b.module WHERE confidence >= 0.6 GROUP BY 1, 2, 3, 4""")
def g21(t: Tables) -> DataFrame:
    h = t.findings().filter("score > 0.5").groupBy("module", "signal").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days")).filter("n >= 4")
    b = h.groupBy("module").agg(F.count("*").alias("signals"), F.sum("n").alias("hits"), r6(F.least(F.lit(0.95), 0.5 + 0.1 * (F.count("*") - 1) + 0.02 * F.max("days"))).alias("confidence")).filter("confidence >= 0.6")
    e = t.findings().select("module").distinct().withColumn("other", F.concat(F.lit("src/m"), (F.substring("module", 6, 9).cast("int") + 1) % 12))
    n = e.groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("neighbours"))
    return b.join(n, "module").select("module", "signals", "hits", "confidence", "neighbours")


@query("t07_candidate_limit", f"WITH {COMMITS}, n AS (SELECT file, count(*) AS commits FROM changes GROUP BY file), c AS (SELECT greatest(10, CAST(floor(0.2 * count(*)) AS BIGINT)) AS most FROM n), r AS (SELECT *, row_number() OVER (ORDER BY commits DESC, file) AS i FROM n) SELECT file, commits FROM r, c WHERE i <= most")
def t07(t: Tables) -> DataFrame:
    """Files with most commits; the limit grows with their number. The cut is at a number of commits, and only files at it are ranked."""
    n = t.changes().groupBy("file").agg(F.count("*").alias("commits"))
    return _top(n, F.greatest(F.lit(10), F.floor(0.2 * F.count("*"))), "commits", "file")


def _top(df: DataFrame, most, order: str, tie: str) -> DataFrame:
    """The rows of greatest ``order`` (ties by least ``tie``); ``most``: an aggregate of the table. From counts of distinct values; only the rows of the
    value at the cut are sorted."""
    counts = df.groupBy(order).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(F.desc(order)))
    limit = df.agg(most.alias("most"))  # one number
    at = counts.withColumn("upto", upto).crossJoin(F.broadcast(limit)).withColumn("left", F.col("most") - (F.col("upto") - F.col("c")))
    above = at.filter("upto <= most").select(order)
    edge = at.filter("left > 0 and upto > most").select(F.col(order).alias("edge"), "left")  # one row at most
    some = df.join(F.broadcast(edge), F.col(order) == F.col("edge")).withColumn("i", F.row_number().over(Window.partitionBy("edge").orderBy(tie))).filter(F.col("i") <= F.col("left")).select(*df.columns)
    return df.join(above, order).select(*df.columns).unionByName(some)


@query("t08_capped_pairs", """WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size AS bucket FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY a, b) AS i FROM p) SELECT bucket, count(*) AS n FROM r WHERE i <= 3 GROUP BY bucket""")
def t08(t: Tables) -> DataFrame:
    """The report's cap of comparisons a bucket, in a fixed order: salted shares are cut first, so a large bucket isn't sorted whole. The three first pairs of a
    group are among its four least keys, so no others are paired."""
    x = top_k_per_group(t.part.select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], [F.col("p_partkey")], 4, salts=16, salt_by="p_partkey")
    p = x.join(x.withColumnRenamed("p_partkey", "b"), ["p_brand", "p_type", "p_size"]).filter("p_partkey < b").select(F.col("p_partkey").alias("a"), "b", F.col("p_size").alias("bucket"))
    for keys in (["bucket", F.pmod(F.xxhash64("a", "b"), F.lit(16))], ["bucket"]):
        p = p.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b"))).filter("i <= 3")
    return p.groupBy("bucket").agg(F.count("*").alias("n"))


@query("t09_signal_order", f"WITH {FINDINGS} SELECT signal, count(*) AS n, dense_rank() OVER (ORDER BY signal) AS place FROM findings GROUP BY signal")
def t09(t: Tables) -> DataFrame:
    n = t.findings().groupBy("signal").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.dense_rank().over(Window.orderBy("signal")).cast("long"))  # a row a signal


@query("t10_impact_order", f"""WITH {FINDINGS}, i AS (SELECT {SEVERITY_SQL.format("max(score)")} AS severity, signal AS kind, module AS target FROM findings GROUP BY signal, module)
SELECT severity, kind, target, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, kind, target) AS place FROM i""")
def t10(t: Tables) -> DataFrame:
    """Impacts by severity, kind and target: a row a module and signal."""
    i = t.findings().groupBy(F.col("signal").alias("kind"), F.col("module").alias("target")).agg(X.severity(F.max("score")).alias("severity"))
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity"))
    return i.select("severity", "kind", "target", F.row_number().over(Window.orderBy(rank, "kind", "target")).cast("long").alias("place"))


@query("u03_resolved", f"WITH {FINDINGS}, a AS (SELECT DISTINCT title FROM findings WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), b AS (SELECT DISTINCT title FROM findings WHERE ts >= TIMESTAMP '2024-01-15 00:00:00') SELECT 'resolved' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u03(t: Tables) -> DataFrame:
    f = t.findings().select("title", "ts")
    a, b = f.filter("ts < timestamp '2024-01-15 00:00:00'").select("title"), f.filter("ts >= timestamp '2024-01-15 00:00:00'").select("title")
    n = lambda df, s: df.agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return n(a.subtract(b), "resolved").unionByName(n(a.intersect(b), "kept"))


@query("p13_profiles", f"WITH {FINDINGS} SELECT signal, {SEVERITY_SQL.format('score')} AS severity, count(*) AS n FROM findings GROUP BY 1, 2")
def p13(t: Tables) -> DataFrame:
    """The columns of the coder's profile, counted."""
    return X.profile(t.findings().withColumn("severity", X.severity(F.col("score"))), "coder").groupBy("signal", "severity").agg(F.count("*").alias("n"))


def _later(f: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with ``later``: how many of the same keys have a greater ``a``. Rows are ordered within those of one beginning; beginnings are ordered by themselves."""
    f = f.withColumn("start", F.substring("a", 1, 11))
    n = f.groupBy(*keys, "start").agg(F.count("*").alias("m"))
    after = n.withColumn("after", F.sum("m").over(Window.partitionBy(*keys).orderBy(F.desc("start"))) - F.col("m"))
    own = f.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "start").orderBy("a")))
    return own.join(after, [*keys, "start"]).withColumn("later", F.col("after") + F.col("m") - F.col("i"))


@query("p18_parallel_pairs", f"""WITH {FINDINGS}, f AS (SELECT DISTINCT file_path FROM findings), p AS (SELECT a.file_path AS a, b.file_path AS b FROM f a JOIN f b ON regexp_extract(a.file_path, 'f([0-9]+)', 1)[-1:] = regexp_extract(b.file_path, 'f([0-9]+)', 1)[-1:] AND a.file_path < b.file_path)
SELECT split_part(a, '/', 2) AS module, count(*) AS n FROM p WHERE NOT (split_part(a, '/', 2) = split_part(b, '/', 2)) AND NOT (regexp_extract(a, '([^/]+)[.]py$', 1) = regexp_extract(b, '([^/]+)[.]py$', 1)) GROUP BY 1""")
def p18(t: Tables) -> DataFrame:
    """Pairs of files, without those of one folder or one name (parallel implementations). Counted from each file's place in the order of those of its key; no pair is made."""
    f = t.findings().select("file_path").distinct().withColumn("d", F.substring(F.regexp_extract("file_path", "f([0-9]+)", 1), -1, 1))
    f = f.select("d", F.col("file_path").alias("a"), F.split("file_path", "/")[1].alias("module"), F.regexp_extract("file_path", "^(.*)/", 1).alias("folder"), F.regexp_extract("file_path", r"([^/]+)\.[a-z]+$", 1).alias("stem"))
    # All that come later, less those of its folder and those of its name, which take those of both twice.
    later = [(1, ["d"]), (-1, ["d", "folder"]), (-1, ["d", "stem"]), (1, ["d", "folder", "stem"])]
    parts = [_later(f, keys).groupBy("module").agg((F.sum("later") * sign).alias("n")) for sign, keys in later]
    n = parts[0]
    for x in parts[1:]:
        n = n.unionByName(x)
    return n.groupBy("module").agg(F.sum("n").alias("n")).filter("n > 0")


@query("p19_public_routes", "WITH r AS (SELECT regexp_replace(lower(regexp_replace(url, '^https?://[^/]*', '')), '[_/-]', '', 'g') AS r FROM pages) SELECT regexp_matches(r, 'health|login|public|docs|status|register|webhook') AS is_public, count(*) AS n FROM r GROUP BY 1")
def p19(t: Tables) -> DataFrame:
    r = F.regexp_replace(F.lower(F.regexp_replace("url", "^https?://[^/]*", "")), "[_/-]", "")
    return t.pages.groupBy(r.rlike("health|login|public|docs|status|register|webhook").alias("is_public")).agg(F.count("*").alias("n"))


@query("f04_modules_of_paths", f"WITH {FINDINGS}, p AS (SELECT DISTINCT file_path FROM findings) SELECT replace(regexp_replace(regexp_replace(regexp_replace(file_path, '[.]py$', ''), '/__init__$', ''), '^src/', ''), '/', '.') AS module, split_part(file_path, '/', 2) AS top, count(*) AS n FROM p GROUP BY 1, 2")
def f04(t: Tables) -> DataFrame:
    p = t.findings().select("file_path").distinct()
    return p.groupBy(X.module_of(F.col("file_path")).alias("module"), F.split("file_path", "/")[1].alias("top")).agg(F.count("*").alias("n"))


@query("f05_relative_imports", f"""WITH {FINDINGS}, p AS (SELECT DISTINCT file_path, CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS INT) % 3 + 1 AS level FROM findings), s AS (SELECT *, string_split(file_path, '/') AS x FROM p)
SELECT array_to_string(list_concat(x[1:greatest(len(x) - level, 0)], ['other']), '.') AS target, count(*) AS n FROM s GROUP BY 1""")
def f05(t: Tables) -> DataFrame:
    """What ``from {'.' * level}other import x`` means in each file."""
    p = t.findings().select("file_path").distinct().withColumn("level", F.regexp_extract("file_path", "f([0-9]+)", 1).cast("int") % 3 + 1)
    return p.groupBy(X.relative_module(F.col("file_path"), F.col("level"), F.lit("other")).alias("target")).agg(F.count("*").alias("n"))


@query("a05_cross_signal_risk", f"""WITH {FINDINGS}, pf AS (SELECT module, count(*) AS variants FROM findings WHERE signal = 'purchase' AND score > 0.8 GROUP BY module HAVING count(*) >= 2), x AS (SELECT finding_id, module FROM findings WHERE signal = 'error')
SELECT x.module, count(*) AS tasks, any_value(variants) AS variants FROM x JOIN pf ON pf.module = x.module OR starts_with(x.module, pf.module || '/') GROUP BY 1""")
def a05(t: Tables) -> DataFrame:
    """Tasks in folders, or below folders, with a fragmented pattern: each task lists its folder and those above, the nearest wins."""
    f = t.findings()
    pf = f.filter("signal = 'purchase' and score > 0.8").groupBy(F.col("module").alias("above")).agg(F.count("*").alias("variants")).filter("variants >= 2")
    parts = F.split("module", "/")
    x = f.filter("signal = 'error'").select("finding_id", "module", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "above"))
    near = x.join(pf, "above").groupBy("finding_id", "module").agg(F.max_by("variants", "depth").alias("variants"))
    return near.groupBy("module").agg(F.count("*").alias("tasks"), F.max("variants").alias("variants"))


@query("a06_shadow_verification", f"""WITH {FINDINGS}, s AS (SELECT * FROM findings WHERE file_path IN (SELECT DISTINCT file_path FROM findings WHERE signal = 'error' AND score > 0.9)), a AS (SELECT DISTINCT signal, file_path, title FROM s WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), b AS (SELECT DISTINCT signal, file_path, title FROM s WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')
SELECT 'new' AS side, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'resolved', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def a06(t: Tables) -> DataFrame:
    f = t.findings()
    s = f.join(f.filter("signal = 'error' and score > 0.9").select("file_path").distinct(), "file_path", "left_semi")
    k = ["signal", "file_path", "title"]
    a, b = s.filter("ts < timestamp '2024-01-15 00:00:00'").select(*k).distinct(), s.filter("ts >= timestamp '2024-01-15 00:00:00'").select(*k).distinct()
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(b.join(a, k, "left_anti"), "new").unionByName(n(a.join(b, k, "left_anti"), "resolved"))


@query("a10_context_of_target", f"""WITH {FINDINGS}, m AS (SELECT module, count(*) AS n, count(DISTINCT file_path) AS files, round(avg(score), 6) AS score FROM findings GROUP BY module), e AS (SELECT 'src/m' || i AS a, 'src/m' || (i + 1) % 12 AS b FROM range(12) r(i))
SELECT 'src/m3' AS target, module, n, files, score, CASE WHEN module = 'src/m3' THEN 'self' ELSE 'neighbour' END AS role FROM m WHERE module = 'src/m3' OR module IN (SELECT b FROM e WHERE a = 'src/m3') OR module IN (SELECT a FROM e WHERE b = 'src/m3')""")
def a10(t: Tables) -> DataFrame:
    """A target's module (the longest prefix of its path), and the modules one edge away."""
    m = t.findings().groupBy("module").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), r6(F.avg("score")).alias("score"))
    e = t.spark.range(12).select(F.concat(F.lit("src/m"), "id").alias("a"), F.concat(F.lit("src/m"), (F.col("id") + 1) % 12).alias("b"))
    near = e.filter("a = 'src/m3'").select(F.col("b").alias("module")).union(e.filter("b = 'src/m3'").select("a")).withColumn("role", F.lit("neighbour")).union(t.spark.createDataFrame([("src/m3", "self")], "module string, role string"))
    return m.join(near, "module").select(F.lit("src/m3").alias("target"), "module", "n", "files", "score", "role")


@query("a13_briefing", f"""WITH {FINDINGS}, s AS (SELECT * FROM findings WHERE regexp_matches(module, 'm(1|2|11)$')), g AS (SELECT signal, count(*) AS n, avg(score) AS sc FROM s GROUP BY signal)
SELECT signal, n, round(sc, 6) AS score, CASE WHEN sc >= 0.65 THEN 'high' WHEN sc >= 0.4 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def a13(t: Tables) -> DataFrame:
    """A task's words choose the modules (those whose name they hold); findings in them by signal, with the level of risk."""
    words = F.array(*map(F.lit, ("m1", "m2", "m11")))
    s = t.findings().filter(F.array_contains(words, F.element_at(F.split("module", "/"), -1)))
    g = s.groupBy("signal").agg(F.count("*").alias("n"), F.avg("score").alias("sc"))
    return g.select("signal", "n", r6("sc").alias("score"), F.when(F.col("sc") >= 0.65, "high").when(F.col("sc") >= 0.4, "medium").otherwise("low").alias("risk"))


@query("x04_signal_registry", f"WITH {FINDINGS}, w(signal, weight, scope) AS (VALUES ('click', 0.16, 'cross_file'), ('error', 0.13, 'file_local'), ('view', 0.09, 'git_dependent'), ('purchase', 0.08, 'file_local'), ('signup', 0.05, 'cross_file')) SELECT scope, count(DISTINCT signal) AS signals, count(*) AS n, round(CAST(sum(weight) / count(*) AS DOUBLE), 6) AS weight FROM findings JOIN w USING (signal) GROUP BY scope")
def x04(t: Tables) -> DataFrame:
    """The registry as a dimension table."""
    w = t.spark.createDataFrame([("click", 0.16, "cross_file"), ("error", 0.13, "file_local"), ("view", 0.09, "git_dependent"), ("purchase", 0.08, "file_local"), ("signup", 0.05, "cross_file")], "signal string, weight double, scope string")
    n = t.findings().groupBy("signal").agg(F.count("*").alias("k")).join(w, "signal")
    return n.groupBy("scope").agg(F.count("*").alias("signals"), F.sum("k").alias("n"), r6(F.sum(F.col("weight") * F.col("k")) / F.sum("k")).alias("weight"))


@query("s29_tool_indicators", "SELECT count(*) FILTER (WHERE contains(html, '<article')) AS n_a, count(*) FILTER (WHERE contains(html, '<nav')) AS n_b, round(least(0.3, 0.1 * ((count(*) FILTER (WHERE contains(html, '<article')) > 0)::INT + (count(*) FILTER (WHERE contains(html, '<nav')) > 0)::INT)), 6)::DOUBLE AS boost FROM pages")
def s29(t: Tables) -> DataFrame:
    a, b = F.count_if(F.contains("html", F.lit("<article"))), F.count_if(F.contains("html", F.lit("<nav")))
    return t.pages.agg(a.alias("n_a"), b.alias("n_b"), r6(F.least(F.lit(0.3), 0.1 * ((a > 0).cast("int") + (b > 0).cast("int")))).alias("boost"))


@query("s24_packages_of_files", f"WITH {FINDINGS}, p AS (SELECT DISTINCT file_path FROM findings), r AS (SELECT unnest(['src/m1', 'src/m2', 'src']) AS root), k AS (SELECT file_path, max(length(root)) AS n FROM p JOIN r ON starts_with(file_path, root || '/') GROUP BY 1) SELECT CASE n WHEN 3 THEN 'src' ELSE split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) END AS package, count(*) AS n FROM k GROUP BY 1")
def s24(t: Tables) -> DataFrame:
    """Files by the deepest package root that holds them."""
    roots = t.spark.createDataFrame([("src/m1",), ("src/m2",), ("src",)], "package string")
    parts = F.split("file_path", "/")
    p = t.findings().select("file_path").distinct().select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("package"))
    return p.join(roots, "package").groupBy("file_path").agg(F.max_by("package", F.length("package")).alias("package")).groupBy("package").agg(F.count("*").alias("n"))
