"""Documents cut into chunks for retrieval: sections of Markdown with their headings, rows of its tables, numbered paragraphs, and the keys of JSON at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def _lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text, and of headings level and title. A line inside a fence is no heading."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n?", "\n")
    rows = files.select("path", F.posexplode(F.split(text, "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    fences = F.sum(F.col("text").rlike(r"^\s{0,3}(```|~~~)").cast("int")).over(Window.partitionBy("path").orderBy("line"))
    head = F.regexp_extract("text", r"^(#{1,6})\s+.+?\s*$", 1)
    level = F.when((head != "") & (fences % 2 == 0), F.length(head))
    return rows.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_extract("text", r"^#{1,6}\s+(.+?)\s*$", 1)))


def sections(files: DataFrame) -> DataFrame:
    """path, headings (from the outermost to the section's own), level, first and last line, text: a row a heading of a Markdown file. A section ends before the next heading of its
    level or a higher one, so it holds its subsections. Files are windows of their own; one file's headings are ordered in one task."""
    every = _lines(files)
    h = every.filter("level is not null").select("path", "line", "level", "title")
    w = Window.partitionBy("path").orderBy("line")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    # Where the next heading of each level or a higher one stands, and the last heading of each level so far.
    ends = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, LEVELS + 1)]
    held = [F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(before) for k in range(1, LEVELS + 1)]
    h = h.withColumns({f"end{k}": e for k, e in enumerate(ends, 1)} | {f"h{k}": x for k, x in enumerate(held, 1)})
    end = F.coalesce(*(F.when(F.col("level") == k, F.col(f"end{k}")) for k in range(1, LEVELS + 1)))
    # A heading of a level stands above this one only if none of a higher level came in between.
    newest = lambda k: F.greatest(F.lit(0), *(F.coalesce(F.col(f"h{j}.line"), F.lit(0)) for j in range(1, k))) if k > 1 else F.lit(0)
    chain = F.array_compact(F.array(*(F.when((F.col("level") >= k) & (F.col(f"h{k}.line") > newest(k)), F.col(f"h{k}.title")) for k in range(1, LEVELS + 1))))
    h = h.select("path", chain.alias("headings"), "level", F.col("line").alias("first"), end.alias("next"))
    sized = h.join(every.groupBy("path").agg(F.max("line").alias("n_lines")), "path").withColumn("last", F.coalesce(F.col("next") - 1, F.col("n_lines"))).drop("next", "n_lines")
    text = F.array_join(F.slice(F.split(F.regexp_replace(F.col("content"), r"\r\n?", "\n"), "\n"), F.col("first") + 1, F.col("last") - F.col("first")), "\n")
    return sized.join(files.select("path", "content"), "path").select("path", "headings", "level", "first", "last", F.trim(text, F.lit("\n ")).alias("text"))


def _placed(files: DataFrame) -> DataFrame:
    """The lines, each with its nearest heading before it."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return _lines(files).withColumn("heading", F.last("title", ignorenulls=True).over(w))


def table_rows(files: DataFrame) -> DataFrame:
    """path, heading, line, key (the first cell), cells (a map from the table's header): a row a row of a Markdown table. The header is the line above the line of dashes."""
    d = _placed(files).filter(F.col("text").rlike(r"^\s*\|.*\|\s*$")).drop("level", "title")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    rule = F.col("text").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")
    w = Window.partitionBy("path").orderBy("line")
    d = d.withColumns({"cells": cells, "rule": rule}).withColumn("island", F.col("line") - F.row_number().over(w))
    t = Window.partitionBy("path", "island").orderBy("line")
    d = d.withColumn("names", F.when(F.lead("rule").over(t), F.col("cells"))).withColumn("is_head", F.col("names").isNotNull())
    d = d.withColumn("names", F.last("names", ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.filter("not rule and not is_head and names is not null")
    n = F.least(F.size("names"), F.size("cells"))
    named = F.map_from_entries(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.element_at("names", i), F.when(F.array_position(F.slice("names", F.lit(1), i - 1), F.element_at("names", i)) > 0, F.concat(F.lit("#"), i)).otherwise("")).alias("k"), F.element_at("cells", i).alias("v"))))
    return d.select("path", "heading", "line", F.element_at("cells", 1).alias("key"), named.alias("cells"))


def paragraphs(files: DataFrame) -> DataFrame:
    """path, heading, number, line, text: lines that begin with a number of two parts, such as 3.2, below a heading that has the first part's number."""
    d = _placed(files)
    number = F.regexp_extract("text", r"^\s*(\d+\.\d+)\s+.+$", 1)
    d = d.filter("level is null").withColumn("number", number).filter("number <> ''").withColumn("section", F.regexp_extract("heading", r"^(\d+)\.\s", 1))
    return d.filter(F.col("section") == F.substring_index("number", ".", 1)).select("path", "heading", "number", "line", F.regexp_extract("text", r"^\s*\d+\.\d+\s+(.+)$", 1).alias("text"))


def json_keys(files: DataFrame) -> DataFrame:
    """path, key (such as ``$.a.b[0]``), kind, value: a row a value that is neither an object nor an array with elements, of each file that is JSON. Every round opens one level of all files, so depth is what bounds the
    rounds; a value is carried as it is, no schema is asked for."""
    from ..operators.graph import cut

    spark = files.sparkSession
    at = files.select("path", F.lit("$").alias("key"), F.try_parse_json("content").alias("v")).filter("v is not null")
    out = None
    while True:
        kind = F.schema_of_variant("v")
        at = cut(at.withColumn("kind", F.when(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), "object").when(kind.startswith("ARRAY<") & (F.to_json("v") != "[]"), "array").otherwise("value")))
        done = at.filter("kind = 'value'").select("path", "key", F.schema_of_variant("v").alias("kind"), F.when(F.schema_of_variant("v") == "STRING", F.expr("variant_get(v, '$', 'string')")).otherwise(F.to_json("v")).alias("value"))
        out = done if out is None else out.unionByName(done)
        deeper = at.filter("kind <> 'value'")
        if deeper.isEmpty():
            return out
        at = spark.sql("SELECT d.path, CASE WHEN d.kind = 'object' THEN concat(d.key, '.', e.key) ELSE concat(d.key, '[', e.pos, ']') END AS key, e.value AS v FROM {d} d, LATERAL variant_explode(d.v) e", d=deeper)


def chunks(files: DataFrame) -> DataFrame:
    """id, path, kind (section, row, paragraph, key), place, text, hash: all chunks of Markdown and JSON files, each by its path and place."""
    md = files.filter("lower(path) like '%.md'")
    parts = [
        sections(md).select("path", F.lit("section").alias("kind"), F.array_join("headings", " > ").alias("place"), F.col("first").alias("line"), "text"),
        table_rows(md).select("path", F.lit("row").alias("kind"), F.concat_ws(" > ", "heading", "key").alias("place"), "line", F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ").alias("text")),
        paragraphs(md).select("path", F.lit("paragraph").alias("kind"), F.concat_ws(" > ", "heading", "number").alias("place"), "line", "text"),
        json_keys(files.filter("lower(path) like '%.json'")).select("path", F.lit("key").alias("kind"), F.col("key").alias("place"), F.lit(None).cast("int").alias("line"), F.col("value").alias("text")),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.select(F.substring(F.sha2(F.concat_ws("\0", "path", "kind", "place", F.coalesce(F.col("line").cast("string"), F.lit(""))), 256), 1, 16).alias("id"), "path", "kind", "place", "line", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
