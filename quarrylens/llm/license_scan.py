"""License scan by diagonal voting, in DataFrame functions alone.

Every run of three words of a text is hashed and joined with the places of that run in the templates; the words are compared, so a hash decides nothing. A hit at
word i of the text and word j of a template votes for the diagonal i - j. Diagonals of a template that lie near each other are one span, since a word too many or too few
moves what follows to the next diagonal. A span is verified by the share of the template's runs that it holds, in as many words as the
template has.

The base phrases are templates too: a place of a phrase is a diagonal on which all of its runs vote.

The texts are read in two passes (their words counted; their runs joined), without a shuffle of either; what is shuffled are hits. The
templates are broadcast only while they have at most ``BROADCAST_WORDS`` words; beyond that Spark joins them as it sees fit.

Defined cases: null and empty texts have no words, no places, no labels and score 0. A phrase or template of fewer than three words is an error. Repeated rows each get
a row, with equal results. A null id is an id. Texts without a hit have null first and last words and empty labels. Ties don't matter: all places count. Further
columns are ignored, whatever their names. A text stays one row, however long; its words are an array inside that row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, shared_folder, table

#: Words of a hashed run.
RUN = 3
#: Diagonals at most so far from the next one are one span.
NEAR = 4
#: Share of the template that a span must hold.
LEAST = 0.8
BROADCAST_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    name: str
    label: str
    text: str
    base: bool = False


# The phrases asked for, then words of public license notices.
TEMPLATES = (
    Template("base-mit", "mit", "under the mit license", True),
    Template("base-apache-2", "apache-2", "apache license version 2", True),
    Template("base-cc-by-nc", "cc-by-nc", "cc by nc", True),
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit-spdx", "mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2-notice", "apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2-terms", "apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2-spdx", "apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("gpl-3-notice", "gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2-notice", "gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("gpl-terms", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl-notice", "lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("agpl-notice", "agpl", "under the terms of the GNU Affero General Public License"),
    Template("bsd-redistribution", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2-notice", "mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc-name", "cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa-name", "cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-name", "cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa-short", "cc-by-sa", "licensed under CC BY-SA"),
    Template("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    Template("reserved", "all-rights-reserved", "All rights reserved"),
)


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(df: DataFrame, at: str) -> DataFrame:
    """The runs of ``words``: ``at`` (first word, from 0), w0, w1, w2 and their hash."""
    own = [c for c in df.columns if c != "words"]
    n = F.size("words")
    shifted = [F.col("words").alias("w0"), *(F.slice("words", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(1, RUN))]
    run = df.select(*own, F.posexplode(F.arrays_zip(*shifted)).alias(at, "run")).select(*own, at, *(F.col(f"run.w{k}").alias(f"w{k}") for k in range(RUN)))
    return run.filter(F.col(f"w{RUN - 1}").isNotNull()).withColumn("run_hash", F.xxhash64(*(f"w{k}" for k in range(RUN))))


def template_runs(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, label, base, runs (how many the template has), template_at and the run's words and hash."""
    rows = F.array(*(F.struct(F.lit(t.name).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.text).alias("text")) for t in templates))
    t = spark.range(1).select(F.inline(rows)).withColumn("words", words("text"))
    size = F.size("words")
    t = t.withColumn("runs", F.when(size >= RUN, size - RUN + 1).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {RUN} words: "), F.col("template")))))
    return _runs(t.drop("text"), "template_at").withColumnsRenamed({f"w{k}": f"t{k}" for k in range(RUN)} | {"run_hash": "template_hash"})


def license_hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, template, label, base, runs, diagonal, template_at: each run that a text and a template share, once."""
    known = template_runs(docs.sparkSession, templates)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_WORDS:
        known = F.broadcast(known)
    run = _runs(docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(text).alias("words")), "word_at")
    same = F.col("run_hash") == F.col("template_hash")
    for k in range(RUN):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    hits = run.join(known, same).withColumn("diagonal", (F.col("word_at") - F.col("template_at")).cast("long"))
    return hits.select("doc_id", "text_hash", "template", "label", "base", "runs", "diagonal", "template_at").distinct()  # rows that repeat vote once


def license_spans(hits: DataFrame) -> DataFrame:
    """doc_id, text_hash, template, label, base, first and past-the-end word, places (diagonals with all runs, with their least and greatest start), score (0 to 1).

    A span's score is the greater of the best diagonal's share of the template's runs, and the share that all of its diagonals
    hold, times the template's words to the span's where the span has more.
    """
    own = ["doc_id", "text_hash", "template", "label", "base", "runs"]
    line = hits.groupBy(*own, "diagonal").agg(F.count("*").alias("votes"))
    # Of one text and template: as many rows as the text has diagonals with a hit.
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    line = line.withColumn("opens", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR, 0).otherwise(1))
    line = line.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.col("votes") == F.col("runs")
    best = line.groupBy(*own, "span").agg(
        F.max("votes").alias("votes"), F.count(F.when(full, 1)).alias("places"),
        F.min(F.when(full, F.col("diagonal"))).alias("first_place"), F.max(F.when(full, F.col("diagonal"))).alias("last_place"),
    )
    # A hit's span is that of its diagonal.
    seat = line.select(F.col("doc_id").alias("s_doc_id"), F.col("text_hash").alias("s_text_hash"), F.col("template").alias("s_template"), F.col("diagonal").alias("s_diagonal"), "span")
    inside = F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_hash") == F.col("s_text_hash")) & (F.col("template") == F.col("s_template")) & (F.col("diagonal") == F.col("s_diagonal"))
    word_at = F.col("diagonal") + F.col("template_at")
    held = hits.join(seat, inside).groupBy(*own, "span").agg(F.count_distinct("template_at").alias("held"), F.min(word_at).alias("first"), (F.max(word_at) + RUN).alias("past"))
    spans = best.join(held.select(F.col("doc_id").alias("h_doc_id"), F.col("text_hash").alias("h_text_hash"), F.col("template").alias("h_template"), F.col("span").alias("h_span"), "held", "first", "past"),
                      F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("text_hash") == F.col("h_text_hash")) & (F.col("template") == F.col("h_template")) & (F.col("span") == F.col("h_span")))
    merged = F.col("held") / F.col("runs") * F.least(F.lit(1.0), (F.col("runs") + RUN - 1) / (F.col("past") - F.col("first")))
    return spans.select("doc_id", "text_hash", "template", "label", "base", "first", "past", "places", "first_place", "last_place", F.greatest(F.col("votes") / F.col("runs"), merged).alias("score"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``key``, n_words, n_base (places of base phrases), first_word and last_word (their least and greatest start), base_labels, labels (of base places
    and verified spans), score (the best span's)."""
    # Hits are read twice; written, they cost one pass over the texts.
    hits = kept(license_hits(docs, templates, key=key, text=text), shared_folder(docs.sparkSession, "licenses"), "hits")
    spans = license_spans(hits)
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    base = F.col("base") & (F.col("places") > 0)
    found = spans.groupBy(F.col("doc_id").alias("f_doc_id"), F.col("text_hash").alias("f_text_hash")).agg(
        F.sum(F.when(base, F.col("places")).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("first_place"))).alias("first_word"), F.max(F.when(base, F.col("last_place"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base | (F.col("score") >= least)).alias("labels"), F.max("score").alias("score"),
    )
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.size(words(text)).cast("long").alias("n_words"))
    d = d.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("text_hash") == F.col("f_text_hash")), "left")
    return d.select(
        F.col("doc_id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(t.name)}, {quoted(t.label)}, {quoted(t.text)}, {t.base})" for t in TEMPLATES)
    cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH t AS (SELECT template, label, base, {cut} AS w FROM (VALUES {rows}) v(template, label, text, base)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM documents),
tr AS (SELECT template, label, base, len(w) - 2 AS runs, unnest(range(1, len(w) - 1)) AS j, w FROM t),
dr AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT rid, template, label, base, runs, i - j AS diagonal, j FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM dr)
      JOIN (SELECT template, label, base, runs, j, w[j] AS a, w[j + 1] AS b, w[j + 2] AS c FROM tr) USING (a, b, c)),
v AS (SELECT rid, template, diagonal, any_value(runs) AS runs, any_value(label) AS label, any_value(base) AS base, count(*) AS votes FROM h GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS opens FROM v),
s AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM o),
best AS (SELECT rid, template, span, any_value(runs) AS runs, any_value(label) AS label, any_value(base) AS base, max(votes) AS votes, count(CASE WHEN votes = runs THEN 1 END) AS places,
         min(CASE WHEN votes = runs THEN diagonal END) AS low, max(CASE WHEN votes = runs THEN diagonal END) AS high FROM s GROUP BY 1, 2, 3),
held AS (SELECT rid, template, span, count(DISTINCT j) AS held, max(h.diagonal + j) + 3 - min(h.diagonal + j) AS size FROM h JOIN s USING (rid, template, diagonal) GROUP BY 1, 2, 3),
x AS (SELECT *, greatest(votes / runs, held / runs * least(1.0::DOUBLE, (runs + 2) / size)) AS score FROM best JOIN held USING (rid, template, span)),
f AS (SELECT rid, sum(CASE WHEN base THEN places ELSE 0 END) AS n_base, min(CASE WHEN base THEN low END) AS first_word, max(CASE WHEN base THEN high END) AS last_word,
      string_agg(DISTINCT CASE WHEN base AND places > 0 THEN label END, ',' ORDER BY CASE WHEN base AND places > 0 THEN label END) AS base_labels,
      string_agg(DISTINCT CASE WHEN base AND places > 0 OR score >= {LEAST} THEN label END, ',' ORDER BY CASE WHEN base AND places > 0 OR score >= {LEAST} THEN label END) AS labels, max(score) AS score FROM x GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (rid)
"""


SQL = _sql()
