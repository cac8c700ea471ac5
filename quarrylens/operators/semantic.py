"""Functions that do the same in other words: near in a hashed, weighted space of what they are made of, though not near in structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .topk import top_k_per_group
from .vector_index import build_index, search_index

DIMENSIONS = 256
#: Neighbours of a function, least cosine, structural similarity from which a pair is a near duplicate already, and pairs that are reported.
NEIGHBOURS, LEAST, STRUCTURAL, CAP = 5, 0.85, 0.8, 50


def function_features(functions: DataFrame) -> Column:
    """The kinds of syntax that a body is made of, one by one and in pairs, and the words of the name."""
    kinds = F.flatten(F.transform("ngrams", lambda g: F.slice(F.split(g, " "), 1, 1)))
    pairs = F.transform("ngrams", lambda g: F.array_join(F.slice(F.split(g, " "), 1, 2), " "))
    words = F.transform(X.name_tokens(F.substring_index("name", ".", -1)), lambda w: F.concat(F.lit("name:"), w))
    return F.concat(kinds, pairs, words)


def hashed_vectors(rows: DataFrame, key: str, features: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, vector: term frequency times inverse document frequency, each feature at a hashed place with a hashed sign. Features are told apart by 64-bit hashes."""
    f = rows.select(key, F.explode(F.transform(features, lambda x: F.xxhash64(x))).alias("h")).groupBy(key, "h").agg(F.count("*").alias("tf"))
    df = f.groupBy("h").agg(F.count("*").alias("df"))
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one number
    h = F.col("h")
    weight = (1 + F.log("tf")) * F.log1p(F.col("n") / F.col("df")) * F.when(F.shiftrightunsigned(h, 40).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    placed = f.join(df, "h").crossJoin(n).select(key, F.pmod(h, F.lit(dimensions)).cast("int").alias("at"), weight.alias("w")).groupBy(key, "at").agg(F.sum("w").alias("w"))
    held = placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))  # at most ``dimensions`` entries
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def semantic_duplicates(functions: DataFrame, key: str, folder: str, *, least: float = LEAST, structural: float = STRUCTURAL, cap: int = CAP) -> DataFrame:
    """a, b, similarity, structure: of each function the ``NEIGHBOURS`` nearest with a cosine of ``least``, whose multisets of 3-grams overlap by less than ``structural``. The ``cap`` most similar pairs, ties by a, b.

    Functions are numbered in the order of their keys, so vectors and pairs carry numbers. Structures are compared once for each two multisets that some pair has: functions of one
    multiset are one structure, told by a SHA-256 hash.
    """
    from .graph import cut

    f = cut(functions.filter(F.size("ngrams") > 0).select(key, "name", F.array_sort("ngrams").alias("ngrams")).orderBy(key).withColumn("__id", F.monotonically_increasing_id()).withColumn("__m", F.sha2(F.array_join("ngrams", "\x1f"), 256)))
    v = cut(hashed_vectors(f, "__id", function_features(f)))
    near = search_index(build_index(v, "__id", "vector", folder), v, "__id", "vector", NEIGHBOURS, least=least)
    pairs = cut(near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    own = f.select("__id", F.col(key).alias("__key"), F.col("__m"))
    for x in ("a", "b"):
        pairs = pairs.join(own.select(F.col("__id").alias(x), F.col("__key").alias(f"__{x}"), F.col("__m").alias(f"__m{x}")), x)
    pairs = cut(pairs.select(F.col("__a").alias("a"), F.col("__b").alias("b"), "similarity", F.least("__ma", "__mb").alias("__m0"), F.greatest("__ma", "__mb").alias("__m1")))
    grams = f.groupBy("__m").agg(F.first("ngrams").alias("ngrams")).select("__m", F.explode("ngrams").alias("g")).groupBy("__m", "g").agg(F.count("*").alias("n"))
    kinds = pairs.filter("__m0 <> __m1").select("__m0", "__m1").distinct()
    sides = [kinds.select("__m0", "__m1", F.col(f"__m{x}").alias("__m")).join(grams, "__m").select("__m0", "__m1", "g", *(F.col("n").alias(f"n{y}") if x == y else F.lit(0).cast("long").alias(f"n{y}") for y in (0, 1))) for x in (0, 1)]
    both = sides[0].unionByName(sides[1]).groupBy("__m0", "__m1", "g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    overlap = both.groupBy("__m0", "__m1").agg((F.sum(F.least("n0", "n1")) / F.sum(F.greatest("n0", "n1"))).alias("structure"))
    found = pairs.join(overlap, ["__m0", "__m1"], "left").withColumn("structure", F.coalesce("structure", F.lit(1.0))).filter(F.col("structure") < structural).withColumn("__s", F.round("similarity", 6))
    return top_k_per_group(found.withColumn("__g", F.lit(0)), ["__g"], [F.col("__s").desc(), F.col("a"), F.col("b")], cap, salts=64, salt_by="a").drop("__g", "__s", "__m0", "__m1").select("a", "b", "similarity", "structure")
