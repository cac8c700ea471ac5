"""Findings of two versions of the generated source tree. In the second, every seventh file begins with three more lines, every fourteenth has another function, and in every
twenty-first the functions that validate are renamed by a digit; every fiftieth file is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions as V
from ..operators.graph import cut
from . import signals
from .catalog import Tables, query
from .code_queries import SOURCE_SQL, tree


def second(first: DataFrame) -> DataFrame:
    n = F.regexp_extract("path", r"/f([0-9]+)\.py$", 1).cast("long")
    code = F.col("path").startswith("src/")
    content = F.when(n % 21 == 0, F.regexp_replace("content", r"(def validate_[0-9]+)\(", "$19(")).otherwise(F.col("content"))
    content = F.concat(F.lit("# moved\n# moved\n# moved\n"), content, F.when(n % 14 == 0, F.concat(F.lit("\ndef is_extra_"), n, F.lit("(a):\n    return a + 7\n"))).otherwise(""))
    return first.filter(~(code & (n % 50 == 0))).withColumn("content", F.when(code & (n % 7 == 0), content).otherwise(F.col("content")))


def _analyse(files: DataFrame) -> DataFrame:
    return signals.run(signals.tables(files, ("functions",), tuple(sorted({c for _, c in signals.CONTRACTS}))), {"naming_contract_violation"}).withColumn("title", F.concat_ws(" ", "signal", "symbol"))


def _versions(t: Tables) -> V.Versions:
    first = cut(tree(t))  # both versions and their states read it
    return V.analyse_versions(first, second(first), _analyse)


_BAD = """n AS (SELECT fid, path, name, key FROM fn WHERE CASE key % 6
WHEN 0 THEN s % 3 = 2 AND h <> 1 WHEN 1 THEN s % 3 <> 0 AND h <> 1
WHEN 2 THEN key % 7 <> 0 AND NOT (s % 3 = 1 AND key % 5 <> 0) WHEN 3 THEN key % 4 > 1
WHEN 5 THEN NOT (s % 3 <> 0 AND (b > 0 OR key % 4 < 2 OR key % 5 = 0)) ELSE false END),
l AS (SELECT path, CASE WHEN fid % 21 = 0 AND key % 6 = 0 THEN name || '9' ELSE name END AS symbol, CASE WHEN fid % 21 = 0 AND key % 6 = 0 THEN 'title' ELSE 'exact' END AS known_by FROM n WHERE fid % 50 <> 0
  UNION ALL SELECT DISTINCT path, 'is_extra_' || fid, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.path = fn.path AND regexp_replace(name, '[0-9]+', 'N', 'g') = 'is_extra_N') THEN 'title' END FROM fn WHERE fid % 14 = 0 AND fid % 50 <> 0)"""


@query("j22_two_versions", f"WITH {SOURCE_SQL}, {_BAD} SELECT path AS file_path, symbol, known_by FROM l")
def j22_two(t: Tables) -> DataFrame:
    """All findings of the second version, with the stage that knows them from the first."""
    v = _versions(t)
    return V.told_apart(v.after, v.before).select("file_path", "symbol", "known_by")


@query("a03_two_trees", f"""WITH {SOURCE_SQL}, {_BAD} SELECT (SELECT count(*) FROM n) AS n_before, CAST(0.6 AS DOUBLE) AS score_before, (SELECT count(*) FROM l) AS n_after, CAST(0.6 AS DOUBLE) AS score_after,
(SELECT count(*) FROM l WHERE known_by IS NULL) AS n_new, (SELECT count(*) FROM n WHERE fid % 50 = 0) AS n_resolved""")
def a03_two(t: Tables) -> DataFrame:
    return V.before_and_after(_versions(t))


@query("a06_parsed_files", f"""WITH {SOURCE_SQL}, f AS (SELECT DISTINCT fid FROM fn) SELECT 'before' AS version, count(*) + count(*) FILTER (WHERE fid % 10 = 0) AS files FROM f UNION ALL SELECT 'after', count(*) FROM f WHERE fid % 7 = 0 AND fid % 50 <> 0""")
def a06_parsed(t: Tables) -> DataFrame:
    """How many files of each version were analysed: all of the first, of the second those that changed."""
    return _versions(t).parsed
