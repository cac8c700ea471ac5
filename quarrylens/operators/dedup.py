"""Near-duplicate findings: the first in rank stays, as parallel rounds instead of a walk over the ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Lines that near findings are apart at most, bits that their titles' hashes differ in at most, bands that a hash is cut into.
LINES, BITS, BANDS = 3, 3, 4
GROUP = ("signal", "file_path")
#: Of joins whose both sides grow with the findings. Spark's estimate knows neither the rows that ``_spread`` adds nor what a compressed file takes in memory, so it would broadcast
#: millions of rows through the driver.
BOTH_GROW = "shuffle_merge"


def title_hash(title: Column) -> Column:
    """64 bits: each the majority over the SHA-256 of the title's words (ties count as 1); 0 for a title without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 16), 16, -10).cast("long"))
    zero = F.array_repeat(F.lit(0), 64)
    votes = F.aggregate(hashes, zero, lambda acc, h: F.transform(acc, lambda v, i: v + F.shiftrightunsigned(h, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)).cast("boolean").cast("int") * 2 - 1))
    bits = F.aggregate(votes, F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("i")), lambda acc, v: F.struct(acc["v"].bitwiseOR(F.when(v >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), acc["i"])).otherwise(F.lit(0).cast("long"))).alias("v"), (acc["i"] + 1).alias("i")))
    return F.when(F.size(words) == 0, F.lit(0).cast("long")).otherwise(bits["v"])


def _spread(df: DataFrame, around: bool) -> DataFrame:
    """A row for each band of the hash, and with ``around`` for each bin of lines that near findings may lie in."""
    size = LINES + 1
    bin_ = F.floor(F.col("line") / size)
    df = df.withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)) if around else bin_)
    width = 64 // BANDS
    return df.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("hash", width * i).bitwiseAND((1 << width) - 1).alias("bits")) for i in range(BANDS)))).alias("x")).select(*df.columns, "x.band", "x.bits")


def _near(a: str, b: str) -> Column:
    return (F.abs(F.col(f"line_{a}") - F.col(f"line_{b}")) <= LINES) & (F.bit_count(F.col(f"hash_{a}").bitwiseXOR(F.col(f"hash_{b}"))) <= BITS)


def keep_first(findings: DataFrame, rank: Column, key: str = "finding_id") -> DataFrame:
    """``key``, canonical (the kept finding that stands for it: itself, if it is kept).

    In order of ``rank`` (distinct values that order totally, as a number or a struct), a finding goes if an equal one (signal, file, lines, title but for case and outer spaces) or a near one is
    kept: same signal and file, lines within 3, title hashes within 3 bits. It counts for the equal one, else for the first in rank of the lowest band that a kept one shares.

    Near-ness depends on signal, file, line and hash alone, so findings equal in those are one node, of which only the first can be kept. A node is kept once no better-ranked
    near node is undecided or kept; rounds go on until all are decided. A finding without a file is near none.
    """
    text = F.lower(F.trim(F.coalesce(F.col("title"), F.lit(""))))
    f = findings.select(
        F.col(key).alias("id"), rank.alias("rank"), *GROUP, F.coalesce(F.col("start_line"), F.lit(0)).alias("line"), F.coalesce(F.col("end_line"), F.lit(0)).alias("end"), text.alias("text"), title_hash(F.col("title")).alias("hash"),
    )
    f = cut(f.withColumn("apart", F.when(F.col("file_path").isNull(), F.xxhash64("end", "text")).otherwise(0)))
    node = [*GROUP, "line", "hash", "apart"]
    nodes = f.groupBy(*node).agg(F.min("rank").alias("rank"))
    named = nodes.filter("file_path IS NOT NULL")
    a = _spread(named.select(*GROUP, F.col("line").alias("line"), "hash", F.col("rank")), True).withColumnsRenamed({"line": "line_a", "hash": "hash_a", "rank": "better"})
    b = _spread(named.select(*GROUP, "line", "hash", "rank"), False).withColumnsRenamed({"line": "line_b", "hash": "hash_b", "rank": "worse"})
    edges = cut(a.hint(BOTH_GROW).join(b, [*GROUP, "bin", "band", "bits"]).filter(F.col("better") < F.col("worse")).filter(_near("a", "b")).select("better", "worse").distinct())
    open_ = cut(nodes.select("rank"))
    kept: list[DataFrame] = []
    while not open_.isEmpty():
        # Nodes that no open better node is near are kept; what is near them goes.
        won = cut(open_.hint(BOTH_GROW).join(edges.select(F.col("worse").alias("rank")), "rank", "left_anti"))
        kept.append(won)
        out = edges.hint(BOTH_GROW).join(won.select(F.col("rank").alias("better")), "better").select(F.col("worse").alias("rank")).distinct()
        open_ = cut(open_.hint(BOTH_GROW).join(won, "rank", "left_anti").hint(BOTH_GROW).join(out, "rank", "left_anti"))
        live = open_.select(F.col("rank").alias("r"))
        edges = cut(edges.hint(BOTH_GROW).join(live.withColumnRenamed("r", "better"), "better", "left_semi").hint(BOTH_GROW).join(live.withColumnRenamed("r", "worse"), "worse", "left_semi"))
    if not kept:
        return f.select(F.col("id").alias(key), F.col("id").alias("canonical"))
    stays = kept[0]
    for more in kept[1:]:
        stays = stays.unionByName(more)
    best = cut(f.hint(BOTH_GROW).join(stays, "rank"))
    # A finding's canonical one: itself, an equal one, or the first of the lowest band among the near ones that rank before it. Few kept ones are near each other's neighbours.
    equal = best.select(*(F.col(c).alias(f"e_{c}") for c in (*GROUP, "line", "end", "text")), F.col("id").alias("equal"))
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in (*GROUP, "line", "end", "text")]
    every = same[0]
    for s in same[1:]:
        every = every & s
    f = f.hint(BOTH_GROW).join(equal, every, "left").select(*f.columns, "equal")
    far = f.filter("equal IS NULL")
    a = _spread(best.filter("file_path IS NOT NULL").select(*GROUP, F.col("line"), "hash", F.col("rank"), F.col("id").alias("canonical")), True).withColumnsRenamed({"line": "line_a", "hash": "hash_a", "rank": "better"})
    b = _spread(far.select(*GROUP, "line", "hash", "rank", "id"), False).withColumnsRenamed({"line": "line_b", "hash": "hash_b"})
    near = a.hint(BOTH_GROW).join(b, [*GROUP, "bin", "band", "bits"]).filter(F.col("better") < F.col("rank")).filter(_near("a", "b")).groupBy("id").agg(F.min(F.struct("band", "better", "canonical"))["canonical"].alias("canonical"))
    return f.filter("equal IS NOT NULL").select(F.col("id").alias(key), F.col("equal").alias("canonical")).unionByName(near.select(F.col("id").alias(key), "canonical"))


def duplicate_counts(canonical: DataFrame, key: str = "finding_id") -> DataFrame:
    """``key`` of each kept finding and ``duplicates``, itself included."""
    return canonical.groupBy(F.col("canonical").alias(key)).agg(F.count("*").alias("duplicates"))
