"""Audit of how sources diverge in their terms: each pair of a language's sources, and each source's most over-used terms.

Terms are counted in tasks and summed by Spark. A term's share p in a source, or in a language, is smoothed, so every source has a share of every kept
term; the share of a term that a source lacks is the same for all such terms, its baseline.

Pairs are sparse and corrected by baselines. With f0 = f(baseline a, baseline b), the sum of f over all V kept terms is V f0, plus f(p, baseline) - f0
for each term of either source (terms of equal share count as one row), plus what the terms of both add to that. So only terms
that both sources have meet in a join; nothing is spread out over terms times sources.

The k greatest of each source come from a radix selection: histograms of sixteen bits of the value at a time, from the top, find each group's kth value;
histograms of two bytes of the UTF-8 form at a time settle who of the ties goes in. No group is sorted, whatever its size: a window sees at most 65,537
counts, or ``FEW`` tied rows.

Arithmetic is on whole numbers: products beyond 64 bits are decimals.

Defined cases: null text, language and source are empty strings (so null and '' are one). Repeated rows are documents of their own. A source without
terms has pairs and no term rows; a language without kept terms has pairs of value 0. A language of one source has no pairs. Empty tables give none.
Further columns are ignored. Equal values rank by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Tokens, kept, shared_folder, slices, table, tokenise, tuned

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 10
#: Ranks of the part ``term``.
TOP = 10
SCALE = 1_000_000_000
#: Added to each count.
PRIOR = 2
#: Bits of a value, and bytes of an item, that a round of the selection looks at.
BITS, BYTES = 16, 2
#: Tied rows of a group that a window may rank.
FEW = 1024
COUNT_BYTES = 4 << 20
#: Terms are runs of ASCII letters and of code points above ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def words_at(t: Tokens, places: np.ndarray) -> pa.Array:
    """The words at some places of a slice, in lower case."""
    size = t.end[places] - t.start[places]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = LOWER[t.data[np.repeat(t.start[places] - ends[:-1], size) + np.arange(ends[-1])]]
    return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    first = np.ones(len(sorted_keys[0]), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and docs of each slice."""
    for batch in batches:
        for piece in slices(batch, limit=COUNT_BYTES):
            t = tokenise(piece.column("text"), LETTERS)
            if not len(t.hash):
                continue
            lang, source = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
            site = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices, np.int64)
            by_doc = np.lexsort((t.hash, t.row))
            at = _runs(t.hash[by_doc], t.row[by_doc])
            place, n = by_doc[at], np.diff(at, append=len(by_doc))
            h, own = t.hash[place], site[t.row[place]]
            by_site = np.lexsort((h, own))
            at = _runs(h[by_site], own[by_site])
            place = place[by_site[at]]
            row = pa.array(t.row[place])
            yield pa.RecordBatch.from_pydict({
                "lang": piece.column("lang").take(row), "source": piece.column("source").take(row), "term": words_at(t, place),
                "n": pa.array(np.add.reduceat(n[by_site], at), pa.int64()), "docs": pa.array(np.diff(at, append=len(by_site)), pa.int64()),
            })


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR terms)), exactly; null where there are no terms."""
    number = "CAST({} AS DECIMAL(20, 0))".format
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({number(n)} + {PRIOR}) * {SCALE} div ({number(total)} + {PRIOR} * {number(terms)}) END")


def apartness(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)): shares are at most SCALE + 1, so the square is a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, folder: str) -> DataFrame:
    """The k rows of each group with the greatest values (longs, none negative), of equal values those of least item (by UTF-8 bytes); adds ``rank``."""
    greatest = rows.agg(F.max(value)).first()[0]
    if greatest is None:
        return rows.withColumn("rank", F.lit(1))
    at = None  # of each group with k rows or more: the leading bits of its kth value, how many rows with those go in, and how many there are
    by = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    mine = [f"k{i}" for i in range(len(keys))]
    for r in range(-(-max(1, greatest.bit_length()) // BITS) - 1, -1, -1):
        digits = rows.select(*by, F.shiftright(F.col(value), r * BITS).alias("lead"))
        if at is None:
            digits = digits.withColumn("need", F.lit(k).cast("long"))
        else:
            up = at.select(*mine, F.col("lead").alias("up"), "need")
            digits = digits.join(up, mine).filter(F.shiftright("lead", BITS) == F.col("up"))
        at = kept(_boundary(digits, mine, F.col("lead").desc()), folder, f"value-{r}")
    bound = at.select(*(F.col(m).alias(c) for m, c in zip(mine, keys, strict=True)), F.col("lead").alias("kth"), "need", "there")
    held = rows.join(bound, keys, "left")
    sure = held.filter("kth IS NULL").unionByName(held.filter(F.col(value) > F.col("kth"))).drop("kth", "need", "there")
    ties = kept(held.filter((F.col(value) == F.col("kth")) & (F.col("need") < F.col("there"))).withColumn("bytes", F.encode(item, "utf-8")), folder, "ties")
    every = held.filter((F.col(value) == F.col("kth")) & (F.col("need") >= F.col("there"))).drop("kth", "need", "there")

    # Of each group with more ties than it needs: the bytes that the last to go in begins with.
    at, known = ties.select(*by, "need", "there", F.lit("").cast("binary").alias("lead")).distinct(), 0
    ahead: list[DataFrame] = []  # ties that begin with less
    while not at.filter(f"need < there AND there > {FEW}").isEmpty():
        digits = ties.select(*by, "bytes").join(at.filter("need < there").select(*mine, F.col("lead").alias("up"), "need"), mine)
        digits = digits.filter(F.substring("bytes", 1, known) == F.col("up")).withColumn("lead", F.substring("bytes", 1, known + BYTES))
        known += BYTES
        done = at.filter("need >= there")
        at = kept(_boundary(digits, mine, F.col("lead").asc()).unionByName(done), folder, f"bytes-{known}")
    # A group that was settled early has a shorter beginning; all of its rows with that go in, and all with less.
    ends = at.select(*(F.col(m).alias(c) for m, c in zip(mine, keys, strict=True)), F.col("lead").alias("edge"), F.col("need").alias("left"))
    ties = ties.drop("kth", "need", "there").join(ends, keys).withColumn("begins", F.substring("bytes", 1, F.octet_length("edge")))
    ahead = ties.filter(F.col("begins") < F.col("edge"))
    last = ties.filter(F.col("begins") == F.col("edge")).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(item))).filter("nth <= left").drop("nth")
    both = ahead.unionByName(last).drop("bytes", "edge", "left", "begins")
    # At most k rows a group.
    return sure.unionByName(every).unionByName(both).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), item)))


def _boundary(digits: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """keys, lead, need, there: of each group the digit in which its last row to go in falls, how many rows of that digit go in, how many it has."""
    counts = digits.groupBy(*keys, "need", "lead").agg(F.count("*").alias("there"))
    upto = F.sum("there").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("before", upto - F.col("there")).filter("before < need AND before + there >= need")
    return at.select(*keys, "lead", (F.col("need") - F.col("before")).alias("need"), "there")


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "divergence")
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    counts = d.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = kept(counts, folder, "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    terms = kept(terms, folder, "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = kept(counts.drop("docs").join(terms, ["lang", "term"]), folder, "own")
    # One row a source and language; no hint, so Spark broadcasts them only if their size allows.
    sites = d.select("lang", "source").distinct().join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    sites = sites.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    sites = kept(sites.withColumn("none", F.lit(0)).withColumn("base", share("none", "total", "terms")).drop("none"), folder, "sites")
    cells = own.join(sites, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "base")
    cells = kept(cells, folder, "cells")

    over = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), apartness("p", "q").alias("value"))
    best = radix_top(over, ["lang", "source"], "value", "item", top, folder).withColumn("part", F.lit("term"))

    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = _pairs(sites, cells).withColumn("part", F.lit("pair"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return pairs.select(*columns).unionByName(best.select(*columns))


def _pairs(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (another source), value. The rows asked for are one a pair of sources; terms add only where they differ from the baselines."""
    a = sites.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "terms")
    b = sites.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    # Every kept term at its baseline.
    flat = a.join(b, "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * apartness("base_a", "base_b"), F.lit(0)).alias("value"))
    # Terms of one source against the other's baseline, once for all that have the same share.
    alike = cells.groupBy("lang", F.col("source").alias("x"), "p", F.col("base").alias("base_x")).agg(F.count("*").alias("times"))
    one = alike.join(b.toDF("lang", "y", "base_y"), "lang").filter("x <> y")
    one = one.select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("times") * (apartness("p", "base_y") - apartness("base_x", "base_y"))).alias("value"))
    # Terms of both, beyond what each has added.
    mine = cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("base").alias("base_a"))
    other = cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("base").alias("base_b"))
    both = mine.join(other, ["lang", "term"]).filter("a < b")
    both = both.select("lang", "a", "b", (apartness("p_a", "p_b") - apartness("p_a", "base_b") - apartness("base_a", "p_b") + apartness("base_a", "base_b")).alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (one, both)]
    total = flat.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // CAST(s.total + 2 * l.v AS HUGEINT) AS BIGINT) AS p,
        CAST(1 + (1000000000 * CAST(k.n + 2 AS HUGEINT)) // CAST(l.total + 2 * l.v AS HUGEINT) AS BIGINT) AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
