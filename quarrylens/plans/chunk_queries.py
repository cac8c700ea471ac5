"""Chunks of documents that the queries write from the tables: Markdown of suppliers, twenty a file, and a JSON file a customer; and functions near in meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import semantic as S
from ..sources import chunks as C
from . import signals
from .catalog import Tables, query
from .code_queries import tree
from .index_queries import shared

_MD = "s AS (SELECT s_suppkey AS k, s_suppkey // 20 AS g, s_nationkey AS v, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1 AS i FROM supplier)"


def markdown(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    part = F.concat(F.lit("\n## S "), k, F.lit("\nnation "), F.col("s_nationkey"), F.lit("\n### Notes\n| ID | Value |\n|---|---|\n| A-"), k, F.lit(" | "), F.col("s_nationkey"), F.lit(" |"))
    f = t.supplier.groupBy(F.floor(k / 20).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), part.alias("x")))), lambda r: r["x"]), "").alias("body"))  # twenty a group
    return f.select(F.concat(F.lit("doc/"), "g", F.lit(".md")).alias("path"), F.concat(F.lit("# File "), "g", "body").alias("content"))


@query("s17_sections", f"""WITH {_MD} SELECT 'doc/' || g || '.md' AS path, 'File ' || g AS place, 1 AS first, CAST(1 + 6 * count(*) AS INT) AS last FROM s GROUP BY g
UNION ALL SELECT 'doc/' || g || '.md', 'File ' || g || ' > S ' || k, CAST(2 + 6 * i AS INT), CAST(7 + 6 * i AS INT) FROM s UNION ALL SELECT 'doc/' || g || '.md', 'File ' || g || ' > S ' || k || ' > Notes', CAST(4 + 6 * i AS INT), CAST(7 + 6 * i AS INT) FROM s""")
def s17_sections(t: Tables) -> DataFrame:
    return C.sections(markdown(t)).select("path", F.array_join("headings", " > ").alias("place"), "first", "last")


@query("s17_table_rows", f"WITH {_MD} SELECT 'doc/' || g || '.md' AS path, 'A-' || k AS key, CAST(7 + 6 * i AS INT) AS line, CAST(v AS VARCHAR) AS value FROM s")
def s17_rows(t: Tables) -> DataFrame:
    return C.table_rows(markdown(t)).select("path", "key", "line", F.element_at("cells", "Value").alias("value"))


@query("s17_json_keys", """WITH c AS (SELECT 'c/' || c_custkey || '.json' AS path, c_custkey AS k, c_mktsegment AS m FROM customer)
SELECT path, unnest(['$.key', '$.info.segment', '$.info.flags[0]', '$.info.flags[1].even', '$.info.none']) AS key, unnest([CAST(k AS VARCHAR), m, CAST(k % 3 AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '[]']) AS value FROM c""")
def s17_json(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"key": '), k, F.lit(', "info": {"segment": "'), F.col("c_mktsegment"), F.lit('", "flags": ['), k % 3, F.lit(', {"even": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit('}], "none": []}}'))
    return C.json_keys(t.customer.select(F.concat(F.lit("c/"), k, F.lit(".json")).alias("path"), text.alias("content"))).select("path", "key", "value")


@query("j18_semantic_functions")
def j18_functions(t: Tables) -> DataFrame:
    """The fifty most similar pairs of functions of the generated tree that aren't near duplicates in structure."""
    f = signals.duplicate_candidates(signals.tables(tree(t), ("functions",), ("complexity", "ngrams"))["functions"]).withColumn("key", F.concat_ws(":", "path", "name", "line"))
    out = S.semantic_duplicates(f, "key", shared(t.spark, "functions"))
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("structure", 6).alias("structure"))
