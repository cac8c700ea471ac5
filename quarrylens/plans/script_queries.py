"""TypeScript declarations and the signals on them, over scripts written from ``part`` (ten functions a file); cycles of rings of suppliers.

The scripts are real texts that the lexer reads; the SQL predicts what they declare from the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import typescript as TS
from ..sources.records import flat
from . import signals
from .catalog import Tables, query

_PART = "k AS (SELECT p_partkey AS k, p_size % 6 AS b, p_partkey // 10 AS fid, 'web/f' || p_partkey // 10 || '.ts' AS path FROM part)"


def scripts(t: Tables) -> DataFrame:
    """path, language, size_bytes, line_count, content. Arrows, functions, methods, templates in templates, patterns, comments and strings with brackets, ways around types."""
    k, b = F.col("p_partkey"), F.col("p_size") % 6
    when = lambda c, text: F.when(c, F.lit(text)).otherwise("")
    body = F.concat(
        F.lit('  // if (a) { comment\n  const s = `if ${a ? `}` : "{"} {`;\n'), F.repeat(F.lit('  if (a && b) { go("{"); }\n'), b.cast("int")), when(k % 5 == 0, "  const v = a as any;\n"), when(k % 5 == 1, "  const w = a as unknown as Z;\n"),
        when(k % 5 == 2, "  q!.z();\n"), when(k % 7 == 0, "  // @ts-ignore\n"), F.lit("  return /[}/]{2}/.test(s) ? 1 : 0;\n"),
    )
    name = k.cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("export const fn"), name, F.lit(" = async (a: number, b?: string): Promise<any> => {\n"), body, F.lit("};\n")))
    text = text.when(k % 4 == 1, F.concat(F.lit("/** Does it. */\nexport function fn"), name, F.lit("<T>(a: T, [b, c]: string[] = []): string {\n"), body, F.lit("}\n")))
    text = text.when(k % 4 == 2, F.concat(F.lit("class C"), name, F.lit(" extends Base implements I, J {\n  run(x: any) {\n"), body, F.lit("  }\n}\n"))).otherwise(F.concat(F.lit("const g"), name, F.lit(" = x => x ? 1 : 2\n")))
    # Ten functions a file.
    f = t.part.groupBy(F.floor(k / 10).alias("fid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), text.alias("text")))), lambda x: x["text"]), "").alias("content"))
    return f.select(F.concat(F.lit("web/f"), "fid", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), F.size(F.split("content", "\n")).alias("line_count"), "content")


@query("s04_script_functions", f"""WITH {_PART} SELECT path, ['fn' || k, 'fn' || k, 'C' || k || '.run', 'g' || k][k % 4 + 1] AS name, CAST(CASE WHEN k % 4 = 3 THEN 2 ELSE 3 + 2 * b END AS INT) AS complexity, CAST(CASE WHEN k % 4 < 3 AND b > 0 THEN 1 ELSE 0 END AS INT) AS nesting,
['a,b', 'a,[ b , c ]', 'x', 'x'][k % 4 + 1] AS parameters, k % 4 < 2 AS exported, k % 4 = 0 AS is_async, k % 4 = 1 AS has_docstring, CASE k % 4 WHEN 0 THEN 'Promise < any >' WHEN 1 THEN 'string' END AS returns FROM k""")
def s04(t: Tables) -> DataFrame:
    f = flat(TS.declarations(scripts(t)), "functions")
    return f.select("path", "name", "complexity", "nesting", F.array_join("parameters", ",").alias("parameters"), "exported", "is_async", "has_docstring", "returns")


@query("s04_script_types", f"WITH {_PART} SELECT path, 'C' || k AS name, 'class' AS kind, 'Base,I,J' AS bases, 'run' AS members, CAST(7 + b + CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS lines FROM k WHERE k % 4 = 2")
def s04_types(t: Tables) -> DataFrame:
    c = flat(TS.declarations(scripts(t)), "types")
    return c.select("path", "name", "kind", F.array_join("bases", ",").alias("bases"), F.array_join("members", ",").alias("members"), (F.col("end_line") - F.col("line") + 1).alias("lines"))


_WAYS = f"""{_PART}, m AS (SELECT path, unnest([CASE WHEN k % 5 = 0 THEN 'as_any' END, CASE WHEN k % 5 = 1 THEN 'double_cast' END, CASE WHEN k % 5 = 2 THEN 'non_null_assertion' END, CASE WHEN k % 7 = 0 THEN 'ts_ignore' END]) AS kind FROM k WHERE k % 4 < 3)"""


@query("tsb_type_bypasses", f"WITH {_WAYS}, n AS (SELECT path, kind, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY 1, 2) SELECT path AS file_path, round(CAST(least(1.0, sum(n) / 5) AS DOUBLE), 3) AS score, string_agg(kind || ' ' || n, ', ' ORDER BY kind) AS detail FROM n GROUP BY path")
def tsb(t: Tables) -> DataFrame:
    return signals.run(signals.tables(scripts(t)), {"type_safety_bypass"}).select("file_path", "score", "detail")


@query("bat_marker_density", f"""WITH {_PART}, l AS (SELECT path, sum(CASE WHEN k % 4 = 3 THEN 1 ELSE 5 + b + CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END END) + 1 AS loc,
  sum(CASE WHEN k % 4 < 3 AND k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 < 3 AND k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS n FROM k GROUP BY path),
d AS (SELECT *, n / loc AS density FROM l WHERE loc >= 50 AND n > 0), m AS (SELECT round(median(density), 4) AS m FROM d)
SELECT path AS file_path, round(CAST(least(1.0, density / 0.05) AS DOUBLE), 6) AS score, CAST(n AS BIGINT) AS n, m AS median FROM d, m WHERE density >= 0.05""")
def bat(t: Tables) -> DataFrame:
    f = signals.run(signals.tables(scripts(t)), {"bypass_accumulation"})
    return f.select("file_path", "score", F.regexp_extract("detail", r"^(\d+) ", 1).cast("long").alias("n"), F.regexp_extract("detail", r"median ([0-9.eE-]+)$", 1).cast("double").alias("median"))


_RINGS = """s AS (SELECT s_suppkey AS i FROM supplier WHERE s_suppkey // 10 < (SELECT count(*) // 10 FROM supplier)),
e AS (SELECT i AS src, i // 10 * 10 + d AS dst FROM (SELECT i, unnest(CASE i % 10 WHEN 2 THEN [3, 4] WHEN 9 THEN [0, 4] ELSE [i % 10 + 1] END) AS d FROM s)),
p AS (SELECT src AS s, [src, dst] AS path FROM e WHERE dst > src UNION ALL SELECT s, list_append(path, e.dst) FROM p JOIN e ON e.src = p.path[-1] WHERE e.dst > s AND NOT list_contains(path, e.dst)),
c AS (SELECT path FROM p JOIN e ON e.src = p.path[-1] AND e.dst = s)"""


def rings(t: Tables) -> DataFrame:
    """src, dst: rings of ten suppliers with two chords."""
    n = t.supplier.agg(F.floor(F.count("*") / 10).alias("n"))
    s = t.supplier.select(F.col("s_suppkey").alias("src")).crossJoin(F.broadcast(n)).filter(F.floor(F.col("src") / 10) < F.col("n"))  # one number
    d = F.col("src") % 10
    to = F.when(d == 2, F.array(F.lit(3), F.lit(4))).when(d == 9, F.array(F.lit(0), F.lit(4))).otherwise(F.array((d + 1).cast("int")))
    return s.select("src", F.explode(to).alias("to")).select("src", (F.col("src") - F.col("src") % 10 + F.col("to")).alias("dst"))


@query("r04_cycles_of_any_length", f"WITH RECURSIVE {_RINGS} SELECT array_to_string(path, ',') AS cycle FROM c")
def r04_any(t: Tables) -> DataFrame:
    """All simple cycles (of six, nine and ten nodes here)."""
    return G.cycles(rings(t)).select(F.array_join("path", ",").alias("cycle"))


@query("cir_import_cycles", f"""WITH RECURSIVE {_RINGS}, u AS (SELECT path, len(path) AS n, unnest(range(1, len(path) + 1)) AS j FROM c), w AS (SELECT path, n, path[j] AS a, path[j % n + 1] AS b FROM u),
b AS (SELECT DISTINCT path FROM w QUALIFY rank() OVER (PARTITION BY a, b ORDER BY n) = 1), f AS (SELECT list_transform(path, lambda x: 'src/f' || lpad(CAST(x AS VARCHAR), 9, '0') || '.py') AS path FROM b)
SELECT path[1] AS file_path, round(CAST(least(1.0, 0.3 + 0.1 * len(path)) AS DOUBLE), 3) AS score, array_to_string(list_append(path, path[1]), ' -> ') AS detail FROM f""")
def cir(t: Tables) -> DataFrame:
    """The signal over files that import each other in rings."""
    file = lambda c: F.concat(F.lit("src/f"), F.lpad(F.col(c).cast("string"), 9, "0"), F.lit(".py"))
    e = rings(t)
    module = F.concat(F.lit("src.f"), F.lpad(F.col("dst").cast("string"), 9, "0"))
    imports = e.select(file("src").alias("path"), module.alias("module"), F.lit(True).alias("top"))
    files = e.select(file("src").alias("path"), F.lit("python").alias("language")).distinct()
    return signals.run({"imports": imports, "files": files}, {"circular_import"}).select("file_path", "score", "detail")


@query("dia_stale_docs", """WITH n AS (SELECT n_nationkey AS k FROM nation), s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'README.md' AS file_path, 'gone' || k AS detail, CAST(0.3 AS DOUBLE) AS score FROM n WHERE k % 4 = 0 UNION ALL SELECT 'part' || k, 'not in the README', 0.15 FROM n WHERE k % 3 = 0
UNION ALL SELECT 'docs/adr/' || k || '.md', 'lost' || k, 0.4 FROM s WHERE k % 5 <> 0""")
def dia(t: Tables) -> DataFrame:
    """A README that names two in three folders and some that are gone, and a decision a supplier, of which every fifth is superseded."""
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.when(n % 3 != 0, F.concat(F.lit("See `part"), n, F.lit("/`."))).otherwise(""), F.when(n % 4 == 0, F.concat(F.lit(" [x](./gone"), n, F.lit("/) https://a.b/c/"))).otherwise("")))), "\n")  # 25 nations
    readme = t.nation.agg(lines.alias("content")).select(F.lit("README.md").alias("path"), F.lit("markdown").alias("language"), "content")
    code = t.nation.select(F.concat(F.lit("part"), n, F.lit("/x.py")).alias("path"), F.lit("python").alias("language"), F.lit("").alias("content")).filter(n % 3 != 0).unionByName(t.nation.filter(n % 3 == 0).select(F.concat(F.lit("part"), n, F.lit("/y.py")).alias("path"), F.lit("python").alias("language"), F.lit("").alias("content")))
    told = F.concat(F.lit("# Decision\n\n## Status\n\n"), F.when(k % 5 == 0, "Superseded").otherwise("Accepted"), F.lit("\n\n`part1/` and `lost"), k, F.lit("/`\n"))
    decisions = t.supplier.select(F.concat(F.lit("docs/adr/"), k, F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), told.alias("content"))
    return signals.run({"files": readme.unionByName(code).unionByName(decisions)}, {"stale_docs"}).select("file_path", "detail", "score")
