"""The list of queries and of the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(tables) under a name. ``tables`` reads a table of the given folder by attribute."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return wrap


class Tables:
    """The tables of a folder, and views that give them the roles of a repository's records."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def findings(self) -> DataFrame:
        """Events as findings: type = signal, scaled value = score, user = file."""
        e, line = self.events, F.col("event_id") % 400 + 1
        return e.select(
            F.col("event_id").alias("finding_id"), F.col("event_type").alias("signal"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"),
            F.format_string("src/m%d/f%d.py", F.col("user_id") % 12, "user_id").alias("file_path"), F.format_string("src/m%d", F.col("user_id") % 12).alias("module"),
            line.alias("start_line"), (line + F.col("event_id") % 9).alias("end_line"), (F.col("event_id") % 5).alias("n_related"),
            F.format_string("%s in f%d at line %d", "event_type", "user_id", line).alias("title"), "ts", "user_id", "value",
        )

    def weights(self) -> DataFrame:
        return self.spark.createDataFrame(list(WEIGHTS.items()), "signal string, weight double")

    def commits(self) -> DataFrame:
        """Orders as commits: customer = author, urgent = a fix, status P = by a tool; suppliers of the lines = files."""
        return self.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"), (F.col("o_orderstatus") == "P").alias("is_tool"))

    def changes(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file")).distinct()


#: Weights of the five signals in ``findings``.
WEIGHTS = {"click": 0.16, "error": 0.13, "view": 0.09, "purchase": 0.08, "signup": 0.05}
FINDINGS = """findings AS (SELECT event_id AS finding_id, event_type AS signal, least(1.0, value / 100.0) AS score,
  'src/m' || CAST(user_id % 12 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) || '.py' AS file_path, 'src/m' || CAST(user_id % 12 AS VARCHAR) AS module,
  event_id % 400 + 1 AS start_line, event_id % 400 + 1 + event_id % 9 AS end_line, event_id % 5 AS n_related,
  event_type || ' in f' || CAST(user_id AS VARCHAR) || ' at line ' || CAST(event_id % 400 + 1 AS VARCHAR) AS title, ts, user_id, value FROM events)"""
WEIGHTS_SQL = "weights(signal, weight) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in WEIGHTS.items()) + ")"
COMMITS = """commits AS (SELECT o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS is_fix, o_orderstatus = 'P' AS is_tool FROM orders),
changes AS (SELECT DISTINCT l_orderkey AS commit, l_suppkey AS file FROM lineitem)"""
SEVERITY_SQL = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.4 THEN 'medium' WHEN {0} >= 0.2 THEN 'low' ELSE 'info' END"


def r6(c) -> object:
    """Rounded to six digits: sums of doubles differ in their last bits with the order of addition."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
