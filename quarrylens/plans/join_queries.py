"""Join, set and novelty queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import joins as J
from ..operators.graph import cut
from ..operators.windows import micros
from .catalog import COMMITS, FINDINGS, Tables, query, r6

_BASKET = f"{COMMITS}, sz AS (SELECT commit, count(*) AS n FROM changes GROUP BY commit HAVING count(*) BETWEEN 2 AND 20), b AS (SELECT c.commit, c.file, 1.0 / (n - 1) AS v FROM changes c JOIN sz USING (commit)), pr AS (SELECT x.file AS a, y.file AS b, sum(x.v) AS w, count(*) AS n_shared FROM b x JOIN b y ON x.commit = y.commit AND x.file < y.file GROUP BY 1, 2), own AS (SELECT file, sum(v) AS v FROM b GROUP BY file), conf AS (SELECT a, pr.b, w, n_shared, w / least(l.v, r.v) AS confidence FROM pr JOIN own l ON l.file = a JOIN own r ON r.file = pr.b)"


@query("j04_co_change_pairs", f"WITH {_BASKET} SELECT a, b, n_shared, round(w, 6) AS w, round(confidence, 6) AS confidence FROM conf WHERE w >= 1.0 AND confidence >= 0.01")
def j04(t: Tables) -> DataFrame:
    p = J.confident(J.basket_pairs(t.changes(), "commit", "file"), 1.0, 0.01)
    return p.select("a", "b", "n_shared", r6("w").alias("w"), r6("confidence").alias("confidence"))


_WEIGHTED = f"{COMMITS}, wc AS (SELECT c.commit, c.file, CASE WHEN is_tool THEN 0.5 ELSE 1.0 END * CASE WHEN is_fix THEN 0.35 ELSE 1.0 END AS v FROM changes c JOIN commits USING (commit)), sz AS (SELECT commit, count(*) AS n FROM wc GROUP BY commit HAVING count(*) BETWEEN 2 AND 20), b AS (SELECT wc.* FROM wc JOIN sz USING (commit)), own AS (SELECT file, sum(v) AS v FROM b GROUP BY file), pr AS (SELECT x.file AS a, y.file AS b, sum(x.v) AS w FROM b x JOIN b y ON x.commit = y.commit AND x.file < y.file GROUP BY 1, 2), conf AS (SELECT a, pr.b, w, w / least(l.v, r.v) AS confidence FROM pr JOIN own l ON l.file = a JOIN own r ON r.file = pr.b), sc AS (SELECT *, least(0.79, 0.55 * confidence + 0.45 * least(1.0, w / 8)) AS score FROM conf WHERE w >= 2.5), known AS (SELECT DISTINCT p_partkey % 100 AS x, (p_partkey // 7) % 100 AS y FROM part)"


@query("j05_hidden_coupling", f"WITH {_WEIGHTED} SELECT a, b, round(w, 6) AS w, round(score, 6) AS score FROM sc WHERE NOT EXISTS (SELECT 1 FROM known WHERE (x = a AND y = b) OR (x = b AND y = a)) ORDER BY round(score, 9) DESC, a, b LIMIT 10")
def j05(t: Tables) -> DataFrame:
    c = t.commits().withColumn("v", F.when(F.col("is_tool"), 0.5).otherwise(1.0) * F.when(F.col("is_fix"), 0.35).otherwise(1.0))
    p = J.basket_pairs(t.changes().join(c.select("commit", "v"), "commit"), "commit", "file", weight=F.col("v"), shape="given")
    p = J.confident(p, 2.5, 0.0).withColumn("score", F.least(F.lit(0.79), 0.55 * F.col("confidence") + 0.45 * F.least(F.lit(1.0), F.col("w") / 8)))
    links = t.part.select((F.col("p_partkey") % 100).alias("x"), (F.floor(F.col("p_partkey") / 7) % 100).alias("y"))
    links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return p.join(links, ["a", "b"], "left_anti").orderBy(F.round("score", 9).desc(), "a", "b").limit(10).select("a", "b", r6("w").alias("w"), r6("score").alias("score"))


_SUPP = "supp AS (SELECT 'src/m' || CAST(user_id % 12 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) || '.py' AS file_path, event_id % 397 + 1 AS line, CASE WHEN value > 250 THEN NULL ELSE 'click' END AS only_signal, CAST(ts AS DATE) AS until FROM events WHERE event_type = 'signup' AND value > 100)"


def _suppressions(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'signup' and value > 100").select(F.format_string("src/m%d/f%d.py", F.col("user_id") % 12, "user_id").alias("file_path"), (F.col("event_id") % 397 + 1).alias("line"), F.when(F.col("value") <= 250, "click").alias("only_signal"), F.to_date("ts").alias("until"))


@query("j07_suppressed_findings", f"WITH {FINDINGS}, {_SUPP} SELECT f.finding_id, count(*) AS n_suppressions FROM findings f JOIN supp s ON f.file_path = s.file_path AND s.line BETWEEN f.start_line AND f.end_line AND s.until >= DATE '2024-01-10' AND (s.only_signal IS NULL OR s.only_signal = f.signal) GROUP BY f.finding_id")
def j07(t: Tables) -> DataFrame:
    s = _suppressions(t).filter("until >= date '2024-01-10'")
    j = J.point_in_range(t.findings(), s, ["file_path"], "start_line", "end_line", "line").filter("only_signal is null or only_signal = signal")
    return j.groupBy("finding_id").agg(F.count("*").alias("n_suppressions"))


@query("p09_active_findings", f"WITH {FINDINGS}, {_SUPP}, hit AS (SELECT DISTINCT f.finding_id FROM findings f JOIN supp s ON f.file_path = s.file_path AND s.line BETWEEN f.start_line AND f.end_line AND (s.only_signal IS NULL OR s.only_signal = f.signal)) SELECT signal, count(*) AS active FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM hit) GROUP BY signal")
def p09(t: Tables) -> DataFrame:
    f = t.findings()
    hit = J.point_in_range(f, _suppressions(t), ["file_path"], "start_line", "end_line", "line").filter("only_signal is null or only_signal = signal").select("finding_id").distinct()
    return f.join(hit, "finding_id", "left_anti").groupBy("signal").agg(F.count("*").alias("active"))


@query("i09_expired_suppressions", f"WITH {_SUPP} SELECT file_path, line FROM supp WHERE until < DATE '2024-01-10'")
def i09(t: Tables) -> DataFrame:
    return _suppressions(t).filter("until < date '2024-01-10'").select("file_path", "line")


@query("j08_context_tags", f"WITH {FINDINGS}, {_SUPP} SELECT f.finding_id, string_agg(DISTINCT coalesce(s.only_signal, 'any'), ',' ORDER BY coalesce(s.only_signal, 'any')) AS tags, round(max(f.score) * 0.5, 6) AS score FROM findings f JOIN supp s ON f.file_path = s.file_path AND s.line BETWEEN f.start_line AND f.end_line GROUP BY f.finding_id")
def j08(t: Tables) -> DataFrame:
    j = J.point_in_range(t.findings(), _suppressions(t), ["file_path"], "start_line", "end_line", "line")
    return j.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("only_signal", F.lit("any")))), ",").alias("tags"), r6(F.max("score") * 0.5).alias("score"))


_SCOPES = "scopes AS (SELECT 'src/m' || CAST(user_id % 12 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) || '.py' AS file_path, event_id AS scope_id, event_id % 380 AS s, event_id % 380 + 10 + event_id % 90 AS e FROM events WHERE event_type = 'purchase')"


@query("j09_innermost_scope", f"WITH {FINDINGS}, {_SCOPES}, r AS (SELECT finding_id, scope_id, row_number() OVER (PARTITION BY finding_id ORDER BY e - s, s DESC, scope_id DESC) AS rn, e - s AS span FROM findings f JOIN scopes p ON f.file_path = p.file_path AND f.start_line BETWEEN s AND e) SELECT finding_id, span FROM r WHERE rn = 1")
def j09(t: Tables) -> DataFrame:
    s = F.col("event_id") % 380
    scopes = t.events.filter("event_type = 'purchase'").select(F.format_string("src/m%d/f%d.py", F.col("user_id") % 12, "user_id").alias("file_path"), F.col("event_id").alias("scope_id"), s.alias("s"), (s + 10 + F.col("event_id") % 90).alias("e"))
    got = J.innermost(t.findings().select("finding_id", "file_path", "start_line"), scopes, ["file_path"], "start_line", "s", "e", "finding_id")
    return got.select("finding_id", (F.col("e") - F.col("s")).alias("span"))


@query("j10_outcome_window", "WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS fixed FROM events WHERE event_type = 'purchase'), m AS (SELECT e.event_id, e.ts, min(fixed) AS first_after FROM e LEFT JOIN p ON e.user_id = p.user_id AND fixed >= e.ts AND fixed <= e.ts + INTERVAL 2 DAY GROUP BY e.event_id, e.ts) SELECT event_id, CASE WHEN first_after IS NOT NULL THEN 'tp' WHEN ts < TIMESTAMP '2024-01-25 00:00:00' THEN 'fp' ELSE 'open' END AS verdict, first_after FROM m")
def j10(t: Tables) -> DataFrame:
    e, p = t.events.filter("event_type = 'error'"), t.events.filter("event_type = 'purchase'")
    m = J.first_within(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "ts", 2, "event_id")
    return m.select("event_id", F.when(F.col("first_after").isNotNull(), "tp").when(F.col("ts") < F.to_timestamp(F.lit("2024-01-25 00:00:00")), "fp").otherwise("open").alias("verdict"), F.col("first_after").cast("timestamp_ntz").alias("first_after"))


@query("j12_history_enrichment", f"WITH {FINDINGS}, h AS (SELECT user_id, count(*) AS n_events, sum(value) AS total FROM events GROUP BY user_id) SELECT signal, round(avg(n_events), 6) AS churn, count(*) AS n FROM findings LEFT JOIN h USING (user_id) GROUP BY signal")
def j12(t: Tables) -> DataFrame:
    h = t.events.groupBy("user_id").agg(F.count("*").alias("n_events"))
    return t.findings().join(h, "user_id", "left").groupBy("signal").agg(r6(F.avg("n_events")).alias("churn"), F.count("*").alias("n"))


@query("j13_dead_symbols", "WITH used AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01 00:00:00'), d AS (SELECT p_brand, count(*) AS n_dead FROM part WHERE p_partkey NOT IN (SELECT p FROM used) GROUP BY p_brand HAVING count(*) >= 2), a AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n_dead, round(least(1.0, 0.8 * n_dead / n + 0.02 * n_dead), 6) AS score FROM d JOIN a USING (p_brand)")
def j13(t: Tables) -> DataFrame:
    used = t.lineitem.filter("l_shipdate >= timestamp '2001-06-01 00:00:00'").select(F.col("l_partkey").alias("p_partkey"))
    g = t.part.join(used.distinct().withColumn("used", F.lit(True)), "p_partkey", "left").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("used").isNull().cast("long")).alias("n_dead")).filter("n_dead >= 2")
    return g.select("p_brand", "n_dead", r6(F.least(F.lit(1.0), 0.8 * F.col("n_dead") / F.col("n") + 0.02 * F.col("n_dead"))).alias("score"))


@query("j14_phantom_references", "WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark), m AS (SELECT doc_id, count(DISTINCT w) AS n FROM u WHERE length(w) > 12 AND w NOT IN (SELECT w FROM k) GROUP BY doc_id) SELECT doc_id, n, round(least(1.0, 0.3 + 0.15 * n), 6) AS score FROM m")
def j14(t: Tables) -> DataFrame:
    u = t.documents.select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w")).filter("length(w) > 12")
    k = t.benchmark.select(F.explode(X.words(F.col("text"))).alias("w")).distinct()
    return u.join(k, "w", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", "n", r6(F.least(F.lit(1.0), 0.3 + 0.15 * F.col("n"))).alias("score"))


@query("j15_novel_dependencies", f"WITH {COMMITS}, x AS (SELECT o_orderpriority AS module, file, ts FROM changes JOIN commits USING (commit) JOIN orders ON o_orderkey = commit), o AS (SELECT DISTINCT module, file FROM x WHERE ts < TIMESTAMP '1995-02-01 00:00:00'), n AS (SELECT DISTINCT module, file FROM x WHERE ts >= TIMESTAMP '1995-02-01 00:00:00') SELECT module, count(*) AS n_new FROM (SELECT * FROM n EXCEPT SELECT * FROM o) GROUP BY module")
def j15(t: Tables) -> DataFrame:
    x = t.changes().join(t.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("module"), F.col("o_orderdate").alias("ts")), "commit")
    return J.novelty(x, "module", "file", "ts", F.to_timestamp(F.lit("1995-02-01 00:00:00"))).groupBy("module").agg(F.count("*").alias("n_new"))


@query("j16_near_duplicate_pairs", """WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS w FROM documents), k AS (SELECT min(doc_id) AS id, count(*) AS n, w FROM s WHERE len(w) > 0 GROUP BY w),
e AS (SELECT id, n, len(w) AS size, unnest(w) AS w FROM k), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k, max(x.size) AS sa, max(y.size) AS sb, max(x.n) AS na, max(y.n) AS nb FROM e x JOIN e y ON x.w = y.w AND x.id < y.id AND least(x.size, y.size) >= 0.8 * greatest(x.size, y.size) GROUP BY 1, 2)
SELECT a, b, round(k / (sa + sb - k), 6) AS similarity, na AS copies_a, nb AS copies_b FROM c WHERE k >= 0.8 * (sa + sb - k) UNION ALL SELECT id, id, 1.0, n, n FROM k WHERE n > 1""")
def j16(t: Tables) -> DataFrame:
    """Pairs of classes of documents whose word sets have a similarity of 0.8 or more, with the numbers of their copies; a class of several documents also with
    itself. Classes are named by their least document, so copies are never expanded into pairs."""
    # Texts are cut into words once, and classes found once; both are read by several joins.
    d = cut(t.documents.select("doc_id", F.array_distinct(F.transform(X.words(F.col("text")), lambda x: F.xxhash64(x))).alias("w")).filter(F.size("w") > 0))
    n = cut(J.set_classes(d, "doc_id", F.col("w")).groupBy(F.col("class").alias("doc_id")).agg(F.count("*").alias("copies")))
    one = cut(d.join(n, "doc_id").withColumn("n", F.size("w")))
    pairs = J.blocked_pairs(one, "doc_id", "n", F.col("w"), width=None).select("a", "b", r6("similarity").alias("similarity"))
    pairs = pairs.join(n.toDF("a", "copies_a"), "a").join(n.toDF("b", "copies_b"), "b").select("a", "b", "similarity", "copies_a", "copies_b")
    return pairs.unionByName(n.filter("copies > 1").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b")))


@query("j17_exact_duplicates", "SELECT sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS body, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def j17(t: Tables) -> DataFrame:
    body = F.sha2(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), 256)
    return t.documents.groupBy(body.alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("j19_version_divergence", "WITH a AS (SELECT l_suppkey AS m, l_partkey % 50 AS f, count(DISTINCT l_returnflag) AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2), b AS (SELECT l_suppkey AS m, l_partkey % 50 AS f, count(DISTINCT l_returnflag) AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2) SELECT m, count(*) AS compared, count(*) FILTER (WHERE a.k <> b.k) AS diverged, round(least(1.0, 2.0 * count(*) FILTER (WHERE a.k <> b.k) / count(*)), 6) AS score FROM a JOIN b USING (m, f) GROUP BY m")
def j19(t: Tables) -> DataFrame:
    side = lambda c, n: t.lineitem.filter(c).groupBy(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 50).alias("f")).agg(F.countDistinct("l_returnflag").alias(n))
    j = side("l_shipdate < timestamp '1998-01-01 00:00:00'", "k").join(side("l_shipdate >= timestamp '1998-01-01 00:00:00'", "q"), ["m", "f"])
    bad = F.sum((F.col("k") != F.col("q")).cast("long"))
    return j.groupBy("m").agg(F.count("*").alias("compared"), bad.alias("diverged"), r6(F.least(F.lit(1.0), 2.0 * bad / F.count("*"))).alias("score"))


_FP = "substr(sha256(signal || chr(0) || file_path || chr(0) || trim(regexp_replace(title, '[0-9]+', 'N', 'g'))), 1, 16)"


@query("f07_fingerprints", f"WITH {FINDINGS} SELECT finding_id, {_FP} AS fingerprint FROM findings")
def f07(t: Tables) -> DataFrame:
    return t.findings().select("finding_id", X.fingerprint(F.col("signal"), F.col("file_path"), X.stable_title(F.col("title"))).alias("fingerprint"))


@query("j20_baseline_diff", f"WITH {FINDINGS}, f AS (SELECT *, {_FP} AS fp FROM findings), base AS (SELECT DISTINCT fp FROM f WHERE ts < TIMESTAMP '2024-01-02 00:00:00') SELECT signal, count(*) FILTER (WHERE fp IN (SELECT fp FROM base)) AS known, count(*) FILTER (WHERE fp NOT IN (SELECT fp FROM base)) AS new FROM f GROUP BY signal")
def j20(t: Tables) -> DataFrame:
    f = t.findings().withColumn("fp", X.fingerprint(F.col("signal"), F.col("file_path"), X.stable_title(F.col("title"))))
    out = J.new_and_known(f, f.filter("ts < timestamp '2024-01-02 00:00:00'").select("fp"), ["fp"])
    return out.groupBy("signal").agg(F.sum(F.col("is_known").cast("long")).alias("known"), F.sum((~F.col("is_known")).cast("long")).alias("new"))


_HALVES = "b AS (SELECT file_path || signal || CAST(start_line AS VARCHAR) AS k, CAST(floor(max(score) * 5) AS BIGINT) AS v FROM findings WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), a AS (SELECT file_path || signal || CAST(start_line AS VARCHAR) AS k, CAST(floor(max(score) * 5) AS BIGINT) AS v FROM findings WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = t.findings().withColumn("k", F.concat("file_path", "signal", F.col("start_line").cast("string")))
    side = lambda c: f.filter(c).groupBy("k").agg(F.floor(F.max("score") * 5).alias("v"))
    return side("ts < timestamp '2024-01-15 00:00:00'"), side("ts >= timestamp '2024-01-15 00:00:00'")


@query("j21_snapshot_diff", f"WITH {FINDINGS}, {_HALVES} SELECT CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'resolved' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM b FULL JOIN a ON a.k = b.k GROUP BY 1")
def j21(t: Tables) -> DataFrame:
    b, a = _halves(t)
    return J.snapshot_diff(b, a, "k", "v").groupBy("state").agg(F.count("*").alias("n"))


@query("j23_changed_files", "WITH a AS (SELECT user_id, count(*) AS h FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1), b AS (SELECT user_id, count(*) AS h FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (user_id) WHERE a.h IS DISTINCT FROM b.h")
def j23(t: Tables) -> DataFrame:
    n = lambda c, name: t.events.filter(c).groupBy("user_id").agg(F.count("*").alias(name))
    j = n("ts < timestamp '2024-01-03 00:00:00'", "a").join(n("ts >= timestamp '2024-01-28 00:00:00'", "b"), "user_id", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("user_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


@query("j24_primary_author", "WITH n AS (SELECT l_suppkey AS file, o_custkey AS author, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, author) AS rn FROM n) SELECT file, author, c AS n_lines FROM r WHERE rn = 1")
def j24(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("file")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("author")), "l_orderkey").groupBy("file", "author").agg(F.count("*").alias("c"))
    best = n.groupBy("file").agg(F.max_by(F.struct("author", "c"), F.struct(F.col("c"), -F.col("author"))).alias("b"))
    return best.select("file", "b.author", F.col("b.c").alias("n_lines"))


@query("j25_longest_prefix_module", f"WITH {FINDINGS}, paths AS (SELECT DISTINCT file_path FROM findings), mods AS (SELECT DISTINCT module FROM findings WHERE module <> 'src/m1' UNION SELECT 'src' UNION SELECT 'src/m3/f3.py') SELECT file_path, max_by(m.module, length(m.module)) AS module FROM paths p LEFT JOIN mods m ON p.file_path = m.module OR starts_with(p.file_path, m.module || '/') GROUP BY file_path")
def j25(t: Tables) -> DataFrame:
    f = t.findings()
    mods = f.select("module").filter("module <> 'src/m1'").distinct().unionByName(t.spark.createDataFrame([("src",), ("src/m3/f3.py",)], "module string"))
    return J.longest_prefix(f.select("file_path").distinct(), "file_path", mods, "module")


@query("j26_requirements", f"WITH {FINDINGS}, c(requirement, needs) AS (VALUES ('r1', 'click'), ('r2', 'nothing'), ('r3', NULL)), n AS (SELECT signal, count(*) AS n FROM findings WHERE score >= 0.95 GROUP BY signal) SELECT requirement, coalesce(n, 0) AS violators, coalesce(n, 0) = 0 AS satisfied FROM c LEFT JOIN n ON c.needs = n.signal")
def j26(t: Tables) -> DataFrame:
    c = t.spark.createDataFrame([("r1", "click"), ("r2", "nothing"), ("r3", None)], "requirement string, needs string")
    n = t.findings().filter("score >= 0.95").groupBy(F.col("signal").alias("needs")).agg(F.count("*").alias("n"))
    return c.join(n, "needs", "left").select("requirement", F.coalesce("n", F.lit(0)).alias("violators"), (F.coalesce("n", F.lit(0)) == 0).alias("satisfied"))


@query("j28_cross_package_edges", "WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT a, b, n FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey <> y.n_regionkey AND NOT (x.n_regionkey = 0 AND y.n_regionkey IN (1, 2))")
def j28(t: Tables) -> DataFrame:
    from .graph_queries import nation_edges

    region = t.nation.select("n_nationkey", "n_regionkey")
    e = nation_edges(t).join(region.toDF("a", "ra"), "a").join(region.toDF("b", "rb"), "b").filter("ra <> rb")
    allowed = t.spark.createDataFrame([(0, 1), (0, 2)], "ra int, rb int")
    return e.join(allowed, ["ra", "rb"], "left_anti").select("a", "b", "n")


@query("j29_layer_leaks", "WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT x.n_regionkey AS ra, y.n_regionkey AS rb, CAST(sum(n) AS BIGINT) AS n FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey > y.n_regionkey GROUP BY 1, 2")
def j29(t: Tables) -> DataFrame:
    from .graph_queries import nation_edges

    region = t.nation.select("n_nationkey", "n_regionkey")
    e = nation_edges(t).join(region.toDF("a", "ra"), "a").join(region.toDF("b", "rb"), "b").filter("ra > rb")
    return e.groupBy("ra", "rb").agg(F.sum("n").alias("n"))


@query("j31_regressions", "WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'error') SELECT user_id, count(*) FILTER (WHERE again IS NOT NULL AND again > ts AND again <= ts + INTERVAL 1 DAY) AS n_again, count(*) AS n FROM e GROUP BY user_id")
def j31(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = t.events.filter("event_type = 'error'").withColumn("again", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    hit = F.col("again").isNotNull() & (F.col("again") > F.col("ts")) & (micros("again") - micros("ts") <= 86_400_000_000)
    return e.groupBy("user_id").agg(F.sum(hit.cast("long")).alias("n_again"), F.count("*").alias("n"))


@query("j33_expected_findings", "WITH x AS (SELECT quality AS expected, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS found FROM labels JOIN documents USING (doc_id)) SELECT CASE WHEN expected = 1 AND found = 1 THEN 'TP' WHEN expected = 1 THEN 'FN' WHEN found = 1 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n FROM x GROUP BY 1")
def j33(t: Tables) -> DataFrame:
    x = t.labels.join(t.documents.select("doc_id", (F.col("n_chars") > 1000).alias("found")), "doc_id")
    out = F.when((F.col("quality") == 1) & F.col("found"), "TP").when(F.col("quality") == 1, "FN").when(F.col("found"), "FP").otherwise("TN")
    return x.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("u01_carry_forward", f"WITH {FINDINGS}, fresh AS (SELECT finding_id, file_path, 'fresh' AS origin FROM findings WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'), carried AS (SELECT finding_id, file_path, 'carried' AS origin FROM findings WHERE ts < TIMESTAMP '2024-01-29 00:00:00' AND file_path NOT IN (SELECT file_path FROM fresh)) SELECT origin, count(*) AS n FROM (SELECT * FROM fresh UNION ALL SELECT * FROM carried) GROUP BY origin")
def u01(t: Tables) -> DataFrame:
    f = t.findings().select("finding_id", "file_path", "ts")
    fresh = f.filter("ts >= timestamp '2024-01-29 00:00:00'")
    carried = f.filter("ts < timestamp '2024-01-29 00:00:00'").join(fresh.select("file_path").distinct(), "file_path", "left_anti")
    u = fresh.withColumn("origin", F.lit("fresh")).unionByName(carried.withColumn("origin", F.lit("carried")))
    return u.groupBy("origin").agg(F.count("*").alias("n"))


@query("u02_new_and_resolved", f"WITH {FINDINGS}, {_HALVES} SELECT 'new' AS side, count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'resolved', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def u02(t: Tables) -> DataFrame:
    b, a = _halves(t)
    n = lambda x, y, s: x.join(y, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a, b, "new").unionByName(n(b, a, "resolved"))


@query("u04_distinct_commits", "SELECT o_custkey AS author, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def u04(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey").distinct().join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("author")), "l_orderkey")
    return d.groupBy("author").agg(F.count("*").alias("n"))


@query("u07_consolidation", f"WITH {FINDINGS}, g AS (SELECT signal, module, count(*) AS n FROM findings WHERE score >= 0.9 GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT signal, module, file_path, row_number() OVER (PARTITION BY signal, module ORDER BY count(*) DESC, file_path) AS rn FROM findings WHERE score >= 0.9 GROUP BY 1, 2, 3) SELECT signal, module, n - 1 AS reduction, file_path AS canonical FROM g JOIN f USING (signal, module) WHERE rn = 1")
def u07(t: Tables) -> DataFrame:
    f = t.findings().filter("score >= 0.9").groupBy("signal", "module", "file_path").agg(F.count("*").alias("c"))
    g = f.groupBy("signal", "module").agg(F.sum("c").alias("n"), F.min_by("file_path", F.struct(-F.col("c"), F.col("file_path"))).alias("canonical")).filter("n >= 2")
    return g.select("signal", "module", (F.col("n") - 1).alias("reduction"), "canonical")
