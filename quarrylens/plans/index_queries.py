"""Queries of the vector index and of kept findings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import retrieval as R
from ..operators import vector_index as V
from .catalog import Tables, query, r6


def shared(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one in local mode and an error elsewhere."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


COPIES = 8
_CLOSE = f"""n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT a.vec_id * {COPIES} + c AS vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + 0.25 * CAST(z[2] AS DOUBLE)) AS x
  FROM embeddings a, n, range({COPIES}) r(c) JOIN embeddings b ON b.vec_id = (a.vec_id + 7 * c + 1) % n),
u AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM v)"""


def close_vectors(t: Tables) -> DataFrame:
    """Eight vectors near each embedding: itself and a quarter of another."""
    e = t.embeddings
    n = e.agg(F.count("*").alias("n"))
    a = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("c")).crossJoin(F.broadcast(n))  # one number
    a = a.withColumn("other", (F.col("vec_id") + 7 * F.col("c") + 1) % F.col("n"))
    b = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    return a.join(b, "other").select((F.col("vec_id") * COPIES + F.col("c")).alias("vec_id"), F.zip_with("embedding", "y", lambda p, q: p.cast("double") + 0.25 * q.cast("double")).alias("x"))


_NEAREST = """p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS s FROM u a, u b WHERE a.vec_id % 160 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS k FROM p)"""


@query("v04_inverted_lists", f"WITH {_CLOSE}, {_NEAREST} SELECT query, id, round(s, 6) AS similarity FROM r WHERE k <= 7")
def v04_lists(t: Tables) -> DataFrame:
    """The seven nearest of each query vector, of all close vectors, through their index."""
    v = close_vectors(t)
    index = V.build_index(v, "vec_id", "x", shared(t.spark, "vectors"))
    out = V.search_index(index, v.filter(f"vec_id % {20 * COPIES} = 0"), "vec_id", "x", 7, exact=True)
    return out.select("query", "id", r6("similarity").alias("similarity"))


@query("v04_recall")
def v04_recall(t: Tables) -> DataFrame:
    """Recall of the index at ten against a scan of all vectors, and the lists that the queries read."""
    v = close_vectors(t)
    index = V.build_index(v, "vec_id", "x", shared(t.spark, "vectors"))
    asked = v.filter(f"vec_id % {20 * COPIES} = 0")
    read = V.probes(index, asked, "vec_id", "x").groupBy("query").agg(F.count("*").alias("lists")).agg(F.avg("lists").alias("lists_a_query"))
    found = V.recall(V.search_index(index, asked, "vec_id", "x", 10), R.nearest(v, asked, "vec_id", "x", 10))
    return found.crossJoin(F.broadcast(read)).withColumn("lists", F.lit(len(index.centroids)))  # one row each


_KEPT = """WITH RECURSIVE f AS (SELECT event_id AS id, event_type AS signal, user_id AS file, event_id % 40 AS line, event_id % 40 + event_id % 2 AS stop, event_type || ' in f' || CAST(user_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN ' again' ELSE '' END AS title,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS k FROM events),
w AS (SELECT DISTINCT title, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS word, len(regexp_extract_all(lower(title), '[a-z0-9]+')) AS n FROM f),
m AS (SELECT title, word, CAST('0x' || substr(sha256(word), 1, 16) AS UBIGINT) AS h FROM w),
h AS (SELECT title, CAST(sum(CASE WHEN votes >= 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END) AS UBIGINT) AS h FROM (SELECT title, CAST(i AS INTEGER) AS i, sum(CASE WHEN (h >> CAST(i AS UBIGINT)) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM m, range(64) r(i) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT f.*, h.h FROM f JOIN h USING (title)),
s AS (SELECT signal, file, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(k BIGINT, id BIGINT, line BIGINT, stop BIGINT, title VARCHAR, h UBIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS canonical FROM g GROUP BY 1, 2
  UNION ALL SELECT signal, file, k, CASE WHEN near IS NULL THEN list_append(kept, {'k': k, 'id': id, 'line': line, 'stop': stop, 'title': title, 'h': h}) ELSE kept END, id, coalesce(near.id, id)
  FROM (SELECT s.signal, s.file, g.k, s.kept, g.id, g.line, g.stop, g.title, g.h,
    list_sort(list_transform(list_filter(s.kept, lambda x: abs(x.line - g.line) <= 3 AND bit_count(CAST(xor(x.h, g.h) AS BIT)) <= 3), lambda x: {'band': CASE WHEN x.line = g.line AND x.stop = g.stop AND lower(trim(x.title)) = lower(trim(g.title)) THEN -1
      WHEN x.h & 65535 = g.h & 65535 THEN 0 WHEN (x.h >> 16) & 65535 = (g.h >> 16) & 65535 THEN 1 WHEN (x.h >> 32) & 65535 = (g.h >> 32) & 65535 THEN 2 ELSE 3 END, 'k': x.k, 'id': x.id}))[1] AS near
    FROM s JOIN g ON g.signal = s.signal AND g.file = s.file AND g.k = s.k + 1))
SELECT canonical AS finding_id, count(*) AS duplicates FROM s WHERE id IS NOT NULL GROUP BY 1"""


@query("w12_kept_findings", _KEPT)
def w12_kept(t: Tables) -> DataFrame:
    """Findings that stay of near duplicates, in order of score, and how many each stands for."""
    line = F.col("event_id") % 40
    title = F.concat(F.col("event_type"), F.lit(" in f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " again").otherwise(""))
    f = t.events.select(F.col("event_id").alias("finding_id"), F.col("event_type").alias("signal"), F.format_string("src/f%d.py", "user_id").alias("file_path"), line.alias("start_line"), (line + F.col("event_id") % 2).alias("end_line"), title.alias("title"), "value")
    return D.duplicate_counts(D.keep_first(f, F.struct(-F.col("value"), F.col("finding_id"))))
