"""The signals over a source tree that the queries write themselves: ten functions a file, one a part, whose features follow from the part's key and size.

The files are real Python texts that the parser reads; the SQL predicts the findings from ``part`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signals
from .catalog import Tables, query

_LAYERS, _NAMES = ("api", "services", "db", "utils"), ("validate", "ensure", "is", "try", "load", "get_or_create")
SOURCE_SQL = f"""k AS (SELECT p_partkey AS key, p_size AS s, p_partkey // 10 AS fid FROM part),
fn AS (SELECT key, s, fid, s % 20 AS b, {list(_LAYERS)}[fid % 4 + 1] AS layer, 'src/' || {list(_LAYERS)}[fid % 4 + 1] || '/p' || fid % 50 AS module,
  'src/' || {list(_LAYERS)}[fid % 4 + 1] || '/p' || fid % 50 || '/f' || fid || '.py' AS path, {list(_NAMES)}[key % 6 + 1] || '_' || key AS name,
  CASE WHEN key % 4 = 0 OR (key % 4 = 1 AND fid % 5 = 0) THEN 0 WHEN key % 4 = 1 THEN 1 ELSE 2 END AS h FROM k)"""


def _path(fid: Column) -> Column:
    return F.concat(F.lit("src/"), F.element_at(F.array(*map(F.lit, _LAYERS)), (fid % 4 + 1).cast("int")), F.lit("/p"), fid % 50, F.lit("/f"), fid, F.lit(".py"))


def tree(t: Tables) -> DataFrame:
    """path, language, size_bytes, line_count, content. A file imports the file of half its number; every tenth has a test file beside it."""
    key, size = F.col("p_partkey"), F.col("p_size")
    b = size % 20
    text = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(""))
    head = F.concat(
        F.when((F.col("fid") % 4 == 0) & (key % 2 == 0), F.concat(F.lit('@app.get("/r'), key, F.lit('")\n'))).otherwise(""), F.lit("def "), F.element_at(F.array(*map(F.lit, _NAMES)), (key % 6 + 1).cast("int")), F.lit("_"), key,
        text(key % 10 == 0, "(a, current_user)"), text(key % 10 != 0, "(a, b)"), text(key % 7 == 0, " -> bool"), F.lit(":\n"), text(key % 3 == 0, '    """Does it."""\n'), text(key % 5 == 0, "    if not a:\n        return b\n"),
    )
    body = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.when(i <= b, F.concat(F.lit("    if a > "), i, F.lit(":\n        b += "), i, F.lit("\n"))).otherwise("")), ""),
        text((key % 4 == 0) | ((key % 4 == 1) & (F.col("fid") % 5 == 0)), "    try:\n        a()\n    except Exception:\n        pass\n"), text((key % 4 == 1) & (F.col("fid") % 5 != 0), "    try:\n        a()\n    except ValueError:\n        raise\n"),
        F.when(key % 11 == 0, F.concat(F.lit("    missing_"), key, F.lit("(a)\n"))).otherwise(""), text(size % 3 == 0, "    raise KeyError(a)\n"), text(size % 3 == 1, "    return False\n"), text(size % 3 == 2, "    return b\n"),
    )
    fid = F.floor(key / 10)
    # Ten functions a file, so a group is small whatever the table holds.
    f = t.part.withColumn("fid", fid).groupBy("fid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.concat(head, body).alias("text")))), lambda x: x["text"]), "\n").alias("body"))
    n = F.col("fid")
    half = F.floor(n / 2)
    settings = F.when(n % 9 == 0, "DEBUG = True\n").when(n % 9 == 1, 'ALLOWED_HOSTS = ["*"]\n').when(n % 9 == 2, "SESSION_COOKIE_SECURE = False\n").otherwise("")
    imports = F.when(n > 0, F.concat(F.lit("from "), F.replace(F.regexp_extract(_path(half), "^(.*)/", 1), F.lit("/"), F.lit(".")), F.lit(" import f"), half, F.lit("\n"))).otherwise("")
    code = f.select(_path(n).alias("path"), F.concat(F.lit("import fastapi\nfrom fastapi import app\n"), imports, settings, F.lit("\n"), "body").alias("content"))
    test = lambda i: F.concat(F.lit("def test_"), i, F.lit("():\n    assert 1 == 1\n    assert 2 == 2\n"), F.when(n % 100 == 0, "    with pytest.raises(ValueError):\n        int('x')\n").otherwise(""), F.lit("\n"))
    tests = f.filter(n % 10 == 0).select(F.concat(F.lit("tests/p"), n % 50, F.lit("/test_f"), n, F.lit(".py")).alias("path"), F.concat(F.lit("import pytest\n\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), test), "")).alias("content"))
    every = code.unionByName(tests)
    return every.select("path", F.lit("python").alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), F.size(F.split("content", "\n")).alias("line_count"), "content")


#: What signals read of a file and of a function; of others all is worked out.
_READ = {
    "pattern_fragmentation": (("handlers",), ()), "cognitive_complexity": (("functions",), ("cognitive",)), "cohesion_deficit": (("functions",), ()), "architecture_violation": (("imports", "classes", "functions"), ()),
    "explainability_deficit": (("functions",), ("complexity", "has_docstring", "returns", "decorators")),
}


def _signal(t: Tables, name: str, *columns: str) -> DataFrame:
    parts, fields = _READ.get(name, (None, None))
    return signals.run(signals.tables(tree(t), parts, fields), {name}).select(*columns)


def _signal_query(query_name: str, name: str, columns: tuple[str, ...], sql: str) -> None:
    query(query_name, f"WITH {SOURCE_SQL} {sql}")(lambda t: _signal(t, name, *columns))


_signal_query("nbv_naming_contracts", "naming_contract_violation", ("file_path", "symbol", "score"), """SELECT path AS file_path, name AS symbol, CAST(0.6 AS DOUBLE) AS score FROM fn WHERE CASE key % 6
WHEN 0 THEN s % 3 = 2 AND h <> 1 WHEN 1 THEN s % 3 <> 0 AND h <> 1
WHEN 2 THEN key % 7 <> 0 AND NOT (s % 3 = 1 AND key % 5 <> 0) WHEN 3 THEN key % 4 > 1
WHEN 5 THEN NOT (s % 3 <> 0 AND (b > 0 OR key % 4 < 2 OR key % 5 = 0)) ELSE false END""")
_signal_query("tpd_test_polarity", "test_polarity_deficit", ("file_path", "score"), """SELECT 'tests/p' || fid % 50 AS file_path, round(CAST(least(1.0, (1 - q / CAST(p + q AS DOUBLE)) * least(1.0, n / 10.0)) AS DOUBLE), 3) AS score
FROM (SELECT any_value(fid) % 50 AS fid, count(*) * 3 AS n, count(*) * 6 AS p, sum(CASE WHEN fid % 100 = 0 THEN 3 ELSE 0 END) AS q FROM (SELECT DISTINCT fid FROM fn WHERE fid % 10 = 0) GROUP BY fid % 50) WHERE n >= 5 AND p + q >= 10 AND q / CAST(p + q AS DOUBLE) < 0.1""")
_signal_query("isd_insecure_defaults", "insecure_default", ("file_path", "symbol", "score", "detail"), """SELECT DISTINCT path AS file_path, ['DEBUG', 'ALLOWED_HOSTS', 'SESSION_COOKIE_SECURE'][fid % 9 + 1] AS symbol, CAST([0.8, 0.7, 0.6][fid % 9 + 1] AS DOUBLE) AS score,
['insecure_debug_mode', 'insecure_allowed_hosts', 'insecure_cookie'][fid % 9 + 1] AS detail FROM fn WHERE fid % 9 < 3""")
_signal_query("maz_missing_authorization", "missing_authorization", ("file_path", "symbol", "score", "detail"), "SELECT path AS file_path, name AS symbol, CAST(0.85 AS DOUBLE) AS score, 'fastapi /r' || key AS detail FROM fn WHERE fid % 4 = 0 AND key % 2 = 0 AND key % 10 <> 0")
_signal_query("phr_phantom_references", "phantom_reference", ("file_path", "score", "detail"), "SELECT path AS file_path, round(CAST(least(1.0, 0.3 + 0.15 * count(*)) AS DOUBLE), 3) AS score, string_agg('missing_' || key, ',' ORDER BY 'missing_' || key) AS detail FROM fn WHERE key % 11 = 0 GROUP BY path")
_signal_query("pfs_pattern_fragmentation", "pattern_fragmentation", ("file_path", "score"), """SELECT module AS file_path, round(CAST(least(1.0, (1 - 1.0 / v) * least(1.5, 1 + 0.04 * greatest(n - 2, 0))) AS DOUBLE), 6) AS score
FROM (SELECT module, count(DISTINCT h) AS v, count(*) AS n FROM fn WHERE h < 2 GROUP BY module) WHERE v >= 2""")
_signal_query("bem_broad_handlers_of_files", "broad_exception_monoculture", ("file_path", "score"), """SELECT module AS file_path, round(r * r, 6) AS score FROM (SELECT module, count(*) AS n, avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END) AS r FROM fn WHERE h < 2 GROUP BY module) WHERE n >= 3 AND r >= 0.8""")
_signal_query("gcd_guard_clauses", "guard_clause_deficit", ("file_path", "score"), """SELECT module AS file_path, round(CAST(least(1.0, (1 - r) * cx / 20) AS DOUBLE), 6) AS score FROM (SELECT module, count(*) AS n, avg(g) AS r, avg(cx) AS cx
FROM (SELECT module, CASE WHEN key % 5 = 0 THEN 1.0 ELSE 0.0 END AS g, 1 + b + CASE WHEN key % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS cx FROM fn) WHERE cx >= 5 GROUP BY module) WHERE n >= 3 AND r < 0.15""")
_signal_query("cxs_cognitive_complexity", "cognitive_complexity", ("file_path", "symbol", "score"), """SELECT path AS file_path, name AS symbol, round(CAST(least(1.0, 0.3 + 0.04 * (cc - 15)) AS DOUBLE), 6) AS score
FROM (SELECT *, b + CASE WHEN key % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS cc FROM fn) WHERE cc > 15""")
_signal_query("eds_unexplained_functions", "explainability_deficit", ("file_path", "symbol", "score"), """, x AS (SELECT *, 1 + b + CASE WHEN key % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS cx,
  1 + CASE WHEN key % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 2 ELSE 0 END + 2 * b + CASE WHEN key % 4 < 2 THEN 4 ELSE 0 END + CASE WHEN key % 11 = 0 THEN 1 ELSE 0 END + 1 AS loc,
  CASE WHEN key % 3 = 0 THEN 1.0 ELSE 0 END + CASE WHEN key % 7 = 0 THEN 1.0 ELSE 0 END + CASE WHEN fid % 4 = 0 AND key % 2 = 0 THEN 0.5 ELSE 0 END AS given FROM fn),
y AS (SELECT *, (1 - given / 2.5) * least(1.0, cx / 20.0) * (0.7 + 0.3 * least(1.0, loc / 30.0)) AS sc FROM x)
SELECT path AS file_path, name AS symbol, round(CAST(sc AS DOUBLE), 6) AS score FROM y WHERE sc >= 0.3""")
_signal_query("cod_cohesion_deficit", "cohesion_deficit", ("file_path", "score"), """, w AS (SELECT path, key, CASE WHEN key % 6 = 5 THEN ['get', 'or', 'create', CAST(key AS VARCHAR)] ELSE [split_part(name, '_', 1), CAST(key AS VARCHAR)] END AS w FROM fn),
l AS (SELECT a.path, a.key, max(CASE WHEN b.key IS NULL THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE) END) AS best FROM w a LEFT JOIN w b ON a.path = b.path AND a.key <> b.key GROUP BY 1, 2),
h AS (SELECT path, max(m) AS m FROM (SELECT path, w[1] AS h, count(*) AS m FROM w GROUP BY 1, 2) GROUP BY path),
g AS (SELECT path, count(*) AS n, avg(CASE WHEN best < 0.15 THEN 1.0 ELSE 0.0 END) AS alone, avg(best) AS mean FROM l GROUP BY path HAVING count(*) >= 4),
r AS (SELECT 0.7 + 0.3 * least(1.0, (count(DISTINCT fid) + count(DISTINCT CASE WHEN fid % 10 = 0 THEN fid END)) / 20.0) AS repo FROM fn),
o AS (SELECT g.path, round(CAST(least(0.79, (0.65 * alone + 0.35 * (1 - mean)) * least(1.0, (n - 2) / 4.0) * repo * CASE WHEN m >= 0.6 * n THEN 0.55 ELSE 1.0 END) AS DOUBLE), 3) AS score FROM g JOIN h USING (path), r)
SELECT path AS file_path, score FROM o WHERE score >= 0.35""")


@query("avs_upward_imports", f"""WITH {SOURCE_SQL}, x AS (SELECT DISTINCT fid, path FROM fn), e AS (SELECT a.fid AS src, b.fid AS dst, a.path AS p, b.path AS q FROM x a JOIN x b ON b.fid = a.fid // 2 AND a.fid > 0 AND a.fid <> b.fid),
n AS (SELECT fid, count(e.src) AS ca FROM (SELECT src AS fid FROM e UNION SELECT dst FROM e) LEFT JOIN e ON e.dst = fid GROUP BY fid), o AS (SELECT ca, row_number() OVER (ORDER BY ca) - 1 AS i, count(*) OVER () AS m FROM n),
c AS (SELECT ca FROM o WHERE i = CAST(floor(0.9 * m) AS BIGINT)), u AS (SELECT *, CASE src % 4 WHEN 3 THEN -1 ELSE src % 4 END AS a, CASE dst % 4 WHEN 3 THEN -1 ELSE dst % 4 END AS b FROM e)
SELECT p AS file_path, 'imports upward ' || q AS detail, CASE WHEN ca >= (SELECT ca FROM c) AND ca > 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS score FROM u JOIN n ON n.fid = dst WHERE a > b AND b >= 0""")
def avs(t: Tables) -> DataFrame:
    return _signal(t, "architecture_violation", "file_path", "detail", "score").filter(F.col("detail").startswith("imports upward"))


@query("j03_layer_edges", f"""WITH {SOURCE_SQL}, x AS (SELECT DISTINCT fid, path FROM fn) SELECT CAST(a.fid % 4 AS INT) AS src_layer, CAST(b.fid % 4 AS INT) AS dst_layer, count(*) AS n FROM x a JOIN x b ON b.fid = a.fid // 2 AND a.fid > 0 AND a.fid <> b.fid WHERE a.fid % 4 <> 3 AND b.fid % 4 <> 3 AND a.fid % 4 > b.fid % 4 GROUP BY 1, 2""")
def j03(t: Tables) -> DataFrame:
    """Edges of the import graph joined with both layers; upward ones, without the layers that all may import."""
    e = signals.file_edges(signals.tables(tree(t), ("imports",)))
    return e.select(signals.layer("src").alias("src_layer"), signals.layer("dst").alias("dst_layer")).filter("src_layer > dst_layer and dst_layer >= 0").groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n"))


@query("s06_files_by_language", f"WITH {SOURCE_SQL} SELECT 'python' AS language, count(DISTINCT fid) + count(DISTINCT CASE WHEN fid % 10 = 0 THEN fid END) AS n_files, count(*) + 3 * count(DISTINCT CASE WHEN fid % 10 = 0 THEN fid END) AS n_functions FROM fn")
def s06(t: Tables) -> DataFrame:
    x = signals.tables(tree(t))
    n = x["functions"].groupBy("path").agg(F.count("*").alias("k"))
    return x["files"].join(n, "path", "left").groupBy("language").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("k", F.lit(0))).alias("n_functions"))


@query("s22_module_map", f"""WITH {SOURCE_SQL}, x AS (SELECT DISTINCT fid, module FROM fn) SELECT module, count(*) AS n_files, count(DISTINCT CASE WHEN fid > 0 AND fid // 2 <> fid THEN m2 END) AS n_modules_used
FROM (SELECT x.fid, x.module, y.module AS m2 FROM x LEFT JOIN x y ON y.fid = x.fid // 2 AND x.fid > 0 AND y.module <> x.module) GROUP BY module""")
def s22(t: Tables) -> DataFrame:
    """Files and used modules of each folder of sources."""
    x = signals.tables(tree(t))
    folder = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    used = signals.file_edges(x).select(folder("src").alias("module"), folder("dst").alias("m2")).filter("module <> m2").groupBy("module").agg(F.countDistinct("m2").alias("k"))
    return x["files"].filter("path like 'src/%'").groupBy(folder("path").alias("module")).agg(F.count("*").alias("n_files")).join(used, "module", "left").select("module", "n_files", F.coalesce("k", F.lit(0)).alias("n_modules_used"))


@query("f23_frameworks", f"WITH {SOURCE_SQL} SELECT 'fastapi' AS framework, count(DISTINCT fid) AS n FROM fn UNION ALL SELECT 'unknown', count(DISTINCT fid) FROM fn WHERE fid % 10 = 0")
def f23(t: Tables) -> DataFrame:
    return signals.frameworks(signals.tables(tree(t), ("imports",))["imports"]).groupBy("framework").agg(F.count("*").alias("n"))


@query("f18_handler_fingerprints", f"""WITH {SOURCE_SQL} SELECT '{{"exceptions":["Exception"],"swallows":true}}' AS variant, count(*) AS n FROM fn WHERE h = 0 UNION ALL SELECT '{{"exceptions":["ValueError"],"swallows":false}}', count(*) FROM fn WHERE h = 1""")
def f18(t: Tables) -> DataFrame:
    h = signals.tables(tree(t), ("handlers",))["handlers"]
    return h.groupBy(F.to_json(F.struct(F.array_sort("exceptions").alias("exceptions"), "swallows")).alias("variant")).agg(F.count("*").alias("n"))


@query("p16_duplicate_candidates", f"""WITH {SOURCE_SQL}, x AS (SELECT *, 1 + b + CASE WHEN key % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS cx,
  1 + CASE WHEN key % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 2 ELSE 0 END + 2 * b + CASE WHEN key % 4 < 2 THEN 4 ELSE 0 END + CASE WHEN key % 11 = 0 THEN 1 ELSE 0 END + 1 AS loc FROM fn)
SELECT module, count(*) AS n FROM x WHERE loc >= 5 AND cx >= 2 GROUP BY module""")
def p16(t: Tables) -> DataFrame:
    """Functions long and complex enough to be compared, without dunder, test, tutorial and lazily forwarding ones."""
    return signals.duplicate_candidates(signals.tables(tree(t), ("functions",), ("complexity",))["functions"]).groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("module")).agg(F.count("*").alias("n"))


_CX = "1 + b + CASE WHEN key % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END"


@query("f16_complexities", f"WITH {SOURCE_SQL} SELECT module, CAST(sum({_CX}) AS BIGINT) AS cyclomatic, CAST(sum({_CX} - 1) AS BIGINT) AS cognitive, CAST(max(CASE WHEN b > 0 OR key % 4 < 2 OR key % 5 = 0 THEN 1 ELSE 0 END) AS INT) AS nesting FROM fn GROUP BY module")
def f16(t: Tables) -> DataFrame:
    """Both complexities and the deepest nesting of each folder's functions."""
    f = signals.tables(tree(t))["functions"].filter("path like 'src/%'")
    return f.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("module")).agg(F.sum("complexity").alias("cyclomatic"), F.sum("cognitive").alias("cognitive"), F.max("nesting").alias("nesting"))


@query("s03_parsed_files", f"""WITH {SOURCE_SQL} SELECT path, count(*) AS n_functions, CAST(any_value(CASE WHEN fid > 0 THEN 3 ELSE 2 END) AS BIGINT) AS n_imports, count(CASE WHEN h < 2 THEN 1 END) AS n_handlers FROM fn GROUP BY path
UNION ALL SELECT 'tests/p' || any_value(fid) % 50 || '/test_f' || fid || '.py', 3, 1, 0 FROM fn WHERE fid % 10 = 0 GROUP BY fid""")
def s03(t: Tables) -> DataFrame:
    p = signals.tables(tree(t))["parsed"]
    return p.filter("error is null").select("path", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("functions", "imports", "handlers")))


@query("p05_contexts_of_files", f"WITH {SOURCE_SQL} SELECT 'py' AS ending, 'source' AS context, count(DISTINCT fid) AS n FROM fn UNION ALL SELECT 'py', 'test', count(DISTINCT fid) FROM fn WHERE fid % 10 = 0")
def p05(t: Tables) -> DataFrame:
    """Files by ending (which tells the language) and by whether their path is a test's."""
    from ..functions.exprs import is_test_path

    ending = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    return tree(t).groupBy(ending.alias("ending"), F.when(is_test_path(F.col("path")), "test").otherwise("source").alias("context")).agg(F.count("*").alias("n"))
