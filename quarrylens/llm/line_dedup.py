"""Line deduplication by overlapping three-line windows.

Lines are trimmed; only lines with a word count. Every three consecutive ones are hashed, Spark groups equal
hashes and keeps the place of the first (least id, then text, then line), and all later occurrences
return to their documents, where the lines they cover are merged and removed. Counting has map-side
combining and the way back is a join that Spark can split, so a window that stands in a third of all
documents is no task's burden.

With ``whole``, a line also ends after each sentence (``.``, ``!`` or ``?`` before spaces), and a text of fewer than three
such lines has one window of all of them, so copies of short texts and passages within long lines go too.

Defined cases: null and empty texts and, without ``whole``, texts of fewer than three lines have no window. Of rows with equal
id and text one is the first and the others are later occurrences. A null id comes first. Empty
lines are never removed. Further columns are ignored unless listed in ``keep``; a kept column that has the name of one of the result gets an
underscore before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, PLAIN, apart, hash_spans, kept, mix, shared_folder, slices, table, tokenise, tuned, windows

LINES = 3
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
#: What ends a line, and with ``whole`` also a sentence.
_ENDS = {False: re.compile(rb"(\n)"), True: re.compile(rb"(\n|(?<=[.!?])[ \t]+)")}


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each trimmed line with a word, and its text's place."""
    words = tokenise(texts, PLAIN, lower=False)
    lines = tokenise(texts, _LINE, lower=False)
    first = np.searchsorted(words.start, lines.start)
    past = np.searchsorted(words.start, lines.end)
    full = first < past
    a, b = words.start[first[full]], words.end[past[full] - 1]
    return hash_spans(words.data, a, b, False), lines.row[full]


def short_windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of the lines of each text that has fewer than ``size``."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(at, append=len(row))
    at, n = at[n < size], n[n < size]
    acc = n.astype(np.uint64)  # texts of other lengths have other hashes
    for k in range(size - 1):
        acc = np.where(k < n, mix(acc * np.uint64(_BASE) + h[np.minimum(at + k, len(h) - 1)]), acc)
    return acc, at


def _numbered(d: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Adds ``again``: false for the first of rows with equal id and text, true for the others. Where none repeat, as is usual, only ids and hashes are
    counted; else repeated rows are counted with combining before the shuffle, so equal rows in any number are one row a task."""
    same = d.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"))
    same = kept(same, folder, "repeated")
    if same.isEmpty():
        return d.withColumn("again", F.lit(False))
    match = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
    some = d.join(same, match, "left_semi").withColumn("other", F.xxhash64(F.lit(0), *columns)).groupBy(*d.columns, "other").agg(F.count("*").alias("rows"))
    least = some.groupBy(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")).agg(F.min("other").alias("least"))
    some = some.join(least, match).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    some = some.withColumn("again", (F.col("copy") > 1) | (F.col("other") > F.col("least"))).select(*d.columns, "again")
    return d.join(same, match, "left_anti").withColumn("again", F.lit(False)).unionByName(some)


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), size: int = LINES, whole: bool = False) -> DataFrame:
    """``key``, ``keep`` columns, n_lines, n_removed, spans (first and past-the-end line of each removal) and clean_text."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "lines")
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).withColumn("text_hash", F.xxhash64("text"))
    d = _numbered(d, folder, [f"c{i}" for i in range(len(keep))])
    kind = dict(d.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                h, row = line_hashes(pc.replace_substring_regex(texts, r"([.!?])[ \t]+", "\\1\n") if whole else texts)
                w, at = windows(h, row, size)
                if whole and len(h):
                    w, at = (np.concatenate(x) for x in zip((w, at), short_windows(h, row, size), strict=True))
                base = np.searchsorted(row, row[at])
                own = pa.array(row[at])
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").take(own), "text_hash": piece.column("text_hash").take(own), "again": piece.column("again").take(own), "line": pa.array(at - base, pa.int32()), "h": pa.array(w.view(np.int64))})

    w = kept(d.select("doc_id", "text_hash", "again", "text").mapInArrow(cut, f"doc_id {kind}, text_hash long, again boolean, line int, h long"), folder, "windows")
    place = F.struct("doc_id", "text_hash", "again", "line")
    repeated = w.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = w.join(repeated, "h").filter(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), F.col("again").alias("g_again")).agg(F.collect_set("line").alias("lines"))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")) & (F.col("again") == F.col("g_again")), "left").drop("g_id", "g_hash", "g_again", "text_hash", "again")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, removed, spans = [], [], [], []
            for raw, lines in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lines").to_pylist(), strict=True):
                pieces = _ENDS[whole].split(raw)
                parts, ends = pieces[::2], [b"", *pieces[1::2]]
                full = [i for i, p in enumerate(parts) if p.split()]
                out = np.zeros(len(full), bool)
                for a in lines or ():
                    out[a : a + size] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                spans.append([{"first": int(a), "past": int(b)} for a, b in edge.reshape(-1, 2)])
                drop = {full[k] for k in np.flatnonzero(out)}
                left = [i for i in range(len(parts)) if i not in drop]
                texts.append(b"".join((ends[i] if k else b"") + parts[i] for k, i in enumerate(left)) if drop else raw)
                n_lines.append(len(full))
                removed.append(len(drop))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "lines")}
            columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), "clean_text": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = dict(d.dtypes)
    out = d.mapInArrow(strip, ", ".join(f"{c} {kinds[c]}" for c in d.columns if c not in ("text", "lines")) + ", n_lines long, n_removed long, spans array<struct<first:int,past:int>>, clean_text string")
    own = (key, "n_lines", "n_removed", "spans", "clean_text")
    return out.select(F.col("doc_id").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(apart(keep, own))), "n_lines", "n_removed", "spans", "clean_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(dedup_lines(table(spark, sf_dir, "documents")))


def op4_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With sentences as lines and a window for short texts, which the SQL below doesn't have."""
    return _summary(dedup_lines(table(spark, sf_dir, "documents"), whole=True))


def _summary(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("clean_text", 256).alias("clean_sha256"))


SQL = r"""
WITH parts AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, text, i, p[i] AS raw, regexp_replace(p[i], '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS line
      FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
f AS (SELECT doc_id, text, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE line <> ''),
w AS (SELECT a.doc_id, a.k, a.line || chr(10) || b.line || chr(10) || c.line AS win FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN f c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, k + o AS k FROM r, (SELECT unnest(range(0, 3)) AS o) WHERE nth > 1),
g AS (SELECT f.doc_id, f.i, f.k FROM f JOIN gone USING (doc_id, k)),
s AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN prev IS NULL OR prev <> k - 1 THEN 1 ELSE 0 END) AS n_spans
      FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM g) GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS clean, count(CASE WHEN line <> '' THEN 1 END) AS n_lines
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(clean, '')) AS clean_sha256
FROM t LEFT JOIN s USING (doc_id)
"""
