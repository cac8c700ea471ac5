"""Sinks for findings: one row a finding in, files out. Rows stay distributed; only reports with a stated bound reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import severity


def _level() -> Column:
    return F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """``value``: one SARIF 2.1.0 result object a row."""
    f = findings.withColumn("severity", severity(F.col("score")))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return f.select(F.to_json(F.struct(F.col("signal").alias("ruleId"), _level().alias("level"), F.struct(F.coalesce("detail", "signal").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif(findings: DataFrame, path: str, tool: str = "quarrylens", version: str = "1") -> None:
    """A whole SARIF 2.1.0 file. Results are gathered by one task, as the format is one object; use ``sarif_results`` where they are many."""
    rules = F.array_sort(F.collect_set(F.struct(F.get_json_object("value", "$.ruleId").alias("id"))))
    runs = F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), rules.alias("rules")).alias("driver")).alias("tool")))
    head = sarif_results(findings).agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), runs.alias("runs"))).alias("head"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("results"))
    # The results go in as they are, before the run's closing brackets.
    head.select(F.concat(F.expr("substring(head, 1, length(head) - 3)"), F.lit(',"results":['), "results", F.lit("]}]}")).alias("value")).write.mode("overwrite").text(path)


def write_csv(findings: DataFrame, path: str) -> None:
    """signal, severity, score, title, file, start_line, end_line, impact: by impact, signal, file and lines."""
    f = findings.withColumn("severity", severity(F.col("score")))
    given = lambda c, kind: (F.col(c) if c in f.columns else F.lit(None)).cast(kind)
    start, impact = F.coalesce(given("start_line", "int"), given("line", "int")), F.coalesce(given("impact", "double"), F.col("score"))
    out = f.select("signal", "severity", "score", F.coalesce(given("title", "string"), given("detail", "string")).alias("title"), F.col("file_path").alias("file"), start.alias("start_line"), F.coalesce(given("end_line", "int"), start).alias("end_line"), impact.alias("impact"))
    out.orderBy(F.col("impact").desc(), "signal", "file", "start_line", "end_line").write.mode("overwrite").csv(path, header=True)


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def envelope(findings: DataFrame, most: int | None = None) -> DataFrame:
    """``value``: one JSON object with the schema's version, the severities' counts, the severity of all and the findings by impact. Gathered by one
    task, as it is one object: give ``most`` where findings are many (the counts are of all)."""
    f = findings.withColumn("severity", severity(F.col("score")))
    counts = f.groupBy("severity").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    top = f.orderBy(F.desc("score"), "signal", "file_path", "line")
    top = (top if most is None else top.limit(most)).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "signal", "file_path", "line", "severity", "score", "symbol", "detail"))).alias("findings"))
    clean = F.transform("findings", lambda x: F.struct(*(x[c].alias(c) for c in ("signal", "severity", "score", "file_path", "line", "symbol", "detail"))))
    return top.crossJoin(counts).select(F.to_json(F.struct(F.lit("2.2").alias("schema_version"), "total", F.col("counts").alias("severity_counts"), clean.alias("findings"))).alias("value"))  # a row on each side


def junit(findings: DataFrame) -> DataFrame:
    """``value``: one JUnit test suite a signal, a failing case a finding; a signal's cases are one row, as the format nests them."""
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    f = findings.withColumn("severity", severity(F.col("score")))
    place = F.concat_ws(":", xml(F.col("file_path")), F.col("line").cast("string"))
    case = F.concat(F.lit('<testcase classname="'), xml(F.col("signal")), F.lit('" name="'), place, F.lit('"><failure type="'), "severity", F.lit('" message="'), xml(F.coalesce("detail", "signal")), F.lit('"/></testcase>'))
    g = f.groupBy("signal").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("file_path").alias("p"), "line", case.alias("x")))), lambda y: y["x"]), "").alias("cases"))
    return g.select(F.concat(F.lit('<testsuite name="'), xml(F.col("signal")), F.lit('" tests="'), "n", F.lit('" failures="'), "n", F.lit('">'), "cases", F.lit("</testsuite>")).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """``value``: one CI annotation line a row."""
    f = findings.withColumn("severity", severity(F.col("score")))
    return f.select(F.format_string("::%s file=%s,line=%d::%s", _level(), "file_path", F.coalesce("line", F.lit(1)), F.coalesce("detail", "signal")).alias("value"))


def markdown(findings: DataFrame, most: int = 30) -> str:
    """A table of the ``most`` highest findings."""
    rows = findings.orderBy(F.col("score").desc(), "signal", "file_path", "line").limit(most).collect()
    return "\n".join(["| Signal | Score | File | Line |", "|---|---|---|---|", *(f"| {r.signal} | {r.score} | {r.file_path} | {r.line or ''} |" for r in rows)])


def save_baseline(fingerprints: DataFrame, path: str) -> None:
    fingerprints.select("fingerprint").distinct().write.mode("overwrite").parquet(path)


def retained(snapshots: DataFrame, scope: list[str], order: str, most: int) -> DataFrame:
    """The last ``most`` snapshots of each scope."""
    return snapshots.withColumn("__rn", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col(order).desc()))).filter(F.col("__rn") <= most).drop("__rn")


def archived(outcomes: DataFrame, as_of, days: int = 180) -> tuple[DataFrame, DataFrame]:
    """Outcomes to keep and to archive."""
    old = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.to_date("resolved_at")) > days, F.lit(False))
    return outcomes.filter(~old), outcomes.filter(old)
