"""Text, retrieval, vector and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import joins as J
from ..operators import retrieval as R
from .catalog import FINDINGS, Tables, query, r6

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


@query("v01_bm25", f"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), p AS (SELECT doc_id, term, len AS length, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / av))) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM s) SELECT item_id AS query, doc_id AS doc, round(score, 6) AS score FROM r WHERE k <= 5""")
def v01(t: Tables) -> DataFrame:
    out = R.bm25(t.documents, t.benchmark, "doc_id", X.words(F.col("text")), "item_id", X.words(F.col("text")), 5)
    return out.select("query", "doc", r6("score").alias("score"))


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (a.nv * b.nv)"
_VEC = "v AS (SELECT vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nv FROM embeddings)"


@query("t04_vector_top_k", f"WITH {_VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS s FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS k FROM p) SELECT query, id, round(s, 6) AS similarity FROM r WHERE k <= 10")
def t04(t: Tables) -> DataFrame:
    out = R.nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return out.select("query", "id", r6("similarity").alias("similarity"))


@query("j18_semantic_duplicates", f"WITH {_VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS s FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS k FROM p WHERE s >= 0.35) SELECT query, id, round(s, 6) AS similarity FROM r WHERE k <= 5")
def j18(t: Tables) -> DataFrame:
    out = R.nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, least=0.35)
    return out.select("query", "id", r6("similarity").alias("similarity"))


@query("f14_cosine", f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def f14(t: Tables) -> DataFrame:
    e = t.embeddings
    j = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return j.select("a", "b", r6(X.cosine(F.col("x"), F.col("y"))).alias("similarity"))


@query("f01_name_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(replace(p_name || ' ' || p_type, '  ', ' ')), ' '))), ' ') AS tokens FROM part")
def f01(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.name_tokens(F.concat_ws("_", F.col("p_name"), F.lower("p_type"))), " ").alias("tokens"))


@query("f01_name_similarity", "WITH n AS (SELECT p_brand, p_size, list_distinct(flatten(list(string_split(lower(p_name), ' ')))) AS w FROM part GROUP BY p_brand, p_size) SELECT a.p_brand, a.p_size AS a, b.p_size AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_size < b.p_size")
def f01b(t: Tables) -> DataFrame:
    n = t.part.select("p_brand", "p_size", F.explode(X.name_tokens(F.col("p_name"))).alias("w")).groupBy("p_brand", "p_size").agg(F.collect_set("w").alias("w"))
    j = n.toDF("p_brand", "a", "x").join(n.toDF("p_brand", "b", "y"), "p_brand").filter("a < b")
    return j.select("p_brand", "a", "b", r6(X.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


@query("f02_multiset_jaccard", f"WITH w AS (SELECT doc_id, source, unnest({_TOK}) AS t FROM documents), a AS (SELECT source, t, count(*) AS n FROM w WHERE doc_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT source, t, count(*) AS n FROM w WHERE doc_id % 2 = 1 GROUP BY 1, 2) SELECT source, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 6) AS jaccard FROM a FULL JOIN b USING (source, t) GROUP BY source")
def f02(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", "source", F.explode(X.words(F.col("text"))).alias("t"))
    return J.multiset_jaccard(w.filter("doc_id % 2 = 0"), w.filter("doc_id % 2 = 1"), ["source"], "t").select("source", r6("jaccard").alias("jaccard"))


@query("f03_token_ngrams", f"WITH d AS (SELECT item_id, {_TOK} AS w FROM benchmark), g AS (SELECT item_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)) SELECT g AS ngram, count(*) AS n FROM g GROUP BY g")
def f03(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(X.token_ngrams(X.words(F.col("text")))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


@query("f06_stable_titles", f"WITH {FINDINGS} SELECT trim(regexp_replace(title, '[0-9]+', 'N', 'g')) AS title, count(*) AS n FROM findings GROUP BY 1")
def f06(t: Tables) -> DataFrame:
    return t.findings().groupBy(X.stable_title(F.col("title")).alias("title")).agg(F.count("*").alias("n"))


@query("f08_corpus_hash", """WITH h AS (SELECT source, sha256(text) AS h FROM documents), a AS (SELECT source, left(h, 6) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1, 2),
b AS (SELECT source, left(p, 3) AS p, sha256(string_agg(h, '' ORDER BY a.p)) AS h FROM a GROUP BY 1, 2) SELECT source, sha256(string_agg(h, '' ORDER BY p)) AS corpus_hash FROM b GROUP BY source""")
def f08(t: Tables) -> DataFrame:
    """A tree of hashes: texts by the first six digits of theirs, these by the first three, these by source. No list is longer than 4,096, but for texts
    that share six digits."""
    h = t.documents.select("source", F.sha2("text", 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    a = h.groupBy("source", F.substring("h", 1, 6).alias("p")).agg(joined(F.struct("h")).alias("h"))
    b = a.groupBy("source", F.substring("p", 1, 3).alias("q")).agg(joined(F.struct("p", "h")).alias("h"))
    return b.groupBy("source").agg(joined(F.struct("q", "h")).alias("corpus_hash"))


@query("f10_levenshtein", "SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE a.p_size = b.p_size AND levenshtein(a.p_name, b.p_name) <= 3")
def f10(t: Tables) -> DataFrame:
    # Distances of a group's different names, then their parts: equal names are compared once.
    group = ["p_brand", "p_size"]
    names = t.part.filter("p_name is not null").select(*group, F.col("p_name").alias("x")).distinct()
    two = names.join(names.withColumnRenamed("x", "y"), group).filter((F.col("x") <= F.col("y")) & (F.abs(F.length("x") - F.length("y")) <= 3))
    near = two.withColumn("distance", F.levenshtein("x", "y", 3)).filter("distance >= 0")
    near = near.repartition(*group, "x")  # else a distance is worked out again for each pair of parts, inside the joins
    a = t.part.select(*group, F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    b = t.part.select(*group, F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    pairs = near.join(a, [*group, "x"]).join(b, [*group, "y"]).filter("x <> y and a <> b or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


@query("f11_token_counts", f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_TOK})) AS INTEGER) AS n_distinct FROM documents")
def f11(t: Tables) -> DataFrame:
    w = X.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("f12_truncated", "SELECT item_id, CASE WHEN length(text) <= 80 THEN text ELSE (CASE WHEN position(' ' IN substr(text, 1, 80)) > 0 THEN regexp_replace(substr(text, 1, 80), ' [^ ]*$', '') ELSE substr(text, 1, 80) END) || '...' END AS short FROM benchmark")
def f12(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.truncate_words(F.col("text"), 80).alias("short"))


@query("f15_entropy", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY user_id")
def f15(t: Tables) -> DataFrame:
    return R.entropy(t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "n").select("user_id", r6("entropy").alias("entropy"))


@query("f24_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def f24(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("f25_links", "SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY page_id")
def f25(t: Tables) -> DataFrame:
    h = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return h.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


_MARK = r"len(regexp_extract_all(text, '[!]{2}|[#]{3}|[%]{3}|[$]{3}'))"


@query("g08_marker_density", f"WITH m AS (SELECT doc_id, {_MARK} AS n, n_chars, {_MARK} / CAST(greatest(n_chars, 1) AS DOUBLE) AS density FROM documents), med AS (SELECT median(density) AS md FROM m) SELECT doc_id, CAST(n AS INTEGER) AS n, round(density, 6) AS density, round(density - md, 6) AS over_median FROM m, med WHERE density >= 0.01 AND n_chars >= 50")
def g08(t: Tables) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit("([!]{2}|[#]{3}|[%]{3}|[$]{3})"), F.lit(1)))
    m = t.documents.select("doc_id", n.alias("n"), "n_chars").withColumn("density", F.col("n") / F.greatest("n_chars", F.lit(1)))
    med = m.agg(F.median("density").alias("md"))
    return m.crossJoin(F.broadcast(med)).filter("density >= 0.01 and n_chars >= 50").select("doc_id", "n", r6("density").alias("density"), r6(F.col("density") - F.col("md")).alias("over_median"))


@query("g29_marker_kinds", "SELECT kind, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[!]{2}|[#]{3}|[%]{3}|[$]{3}')) AS kind FROM documents) GROUP BY kind")
def g29(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([!]{2}|[#]{3}|[%]{3}|[$]{3})"), F.lit(1))).alias("kind"))
    return k.groupBy("kind").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query("s10_nested_properties", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def s10(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("s17_chunks", "WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk FROM documents) SELECT doc_id, count(*) AS n_chunks, min(sha256(chunk)) AS first_hash FROM c WHERE trim(chunk) <> '' GROUP BY doc_id")
def s17(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("chunk")).filter(F.trim("chunk") != "")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min(F.sha2("chunk", 256)).alias("first_hash"))


@query("w12_near_duplicate_titles", f"""WITH {FINDINGS}, w AS (SELECT finding_id, signal, file_path, start_line, regexp_extract_all(lower(title), '[a-z0-9_]+') AS w FROM findings),
k AS (SELECT finding_id, md5(unnest(w)) AS m FROM w), b AS (SELECT finding_id, i, sum(CASE WHEN (CAST('0x' || substr(m, CAST(i // 4 + 1 AS INT), 1) AS INT) >> CAST(3 - i % 4 AS INT)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit FROM k, range(64) r(i) GROUP BY 1, 2),
p AS (SELECT x.signal, x.file_path, x.finding_id AS a, y.finding_id AS b FROM w x JOIN w y ON x.signal = y.signal AND x.file_path = y.file_path AND x.finding_id < y.finding_id AND abs(x.start_line - y.start_line) <= 3)
SELECT signal, file_path, a, b, CAST(count(*) FILTER (WHERE x.bit <> y.bit) AS INT) AS distance FROM p JOIN b x ON x.finding_id = a JOIN b y ON y.finding_id = b AND x.i = y.i GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE x.bit <> y.bit) <= 3""")
def w12(t: Tables) -> DataFrame:
    """Findings of one signal and file whose titles' hashes differ in at most 3 bits and whose lines are within 3."""
    f = t.findings().select("finding_id", "signal", "file_path", "title", "start_line")
    h = R.simhash(f, "finding_id", X.words(F.col("title"))).join(f.select(F.col("finding_id").alias("id"), "signal", "file_path"), "id")
    line = f.select("finding_id", "start_line")
    p = R.close_simhashes(h, ["signal", "file_path"]).join(line.toDF("a", "la"), "a").join(line.toDF("b", "lb"), "b").filter("abs(la - lb) <= 3")
    return p.select("signal", "file_path", "a", "b", "distance")


@query("v04_vector_index", f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s) SELECT query, id, similarity, place FROM r WHERE place <= 10""")
def v04(t: Tables) -> DataFrame:
    """The ten nearest of each query vector. The table's vectors have no near neighbours (the best cosine is about 0.4), where buckets of random
    hyperplanes must propose nearly all pairs for a recall of 0.9, so blocks of them are scanned exactly; the buckets are tested on close vectors."""
    out = R.nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 12)
    s = out.select("query", "id", r6("similarity").alias("similarity"))
    return R.ranked(s, ["query"], [F.col("similarity").desc(), "id"]).filter("place <= 10").withColumn("place", F.col("place").cast("long"))
