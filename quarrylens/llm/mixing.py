"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. Its documents are shuffled by a seeded hash, repeated up to ``max_epochs``
times, and each copy gets a virtual finish time: the source's words up to and with it, divided by the
source's target. All copies are then range-sorted by that time and the sorted sequence is cut at the
total budget. Since a source's target is its share of the budget, all queues run dry of their share
at time 1, and the cut falls there.

Targets: the budget is shared by weight; a source whose share exceeds ``max_epochs`` times its size is
held there and the excess is shared again among the others, until none is above (water filling). With
sources ordered by how soon they fill, that is one running sum over sources, not a loop.

Nothing is grouped by source alone: a source is cut into hash ranges of about ``ROWS_PER_RANGE`` rows,
sums of ranges, taken in two levels, give each range its offset, and only a range is sorted in one task. The global cut works
alike, over ranges of the virtual time.

The copy that crosses the cut in its source is taken in part (``split=True``: the words up to the cut,
so that the taken words meet the target to the word) or, whole, if its middle lies before it.

Defined cases: null text has size 0 and is never taken, null source is a source of its own (last in
order), rows with equal ids and texts are separate documents with ties in the shuffle broken by size
(equal rows are interchangeable), empty tables give empty results, further columns are ignored but for those in ``carry``; one of them that has the
name of a column of the result gets an underscore before it. ``mixed`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept as written
from .common import apart, fresh, row_hash, running_before, shared_folder, table

SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 1_000
TIME_RANGES = 512
SEED = 17
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)


def words(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space (null: 0)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: DataFrame, budget_share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: source, source_size, n_docs; ``weights``: source, weight. Adds target, a double.

    A source fills at level cap/weight. In order of that level, the sources before a place are full; the
    rest share what is left. The first place whose level isn't reached by that share fixes the level of all after it.
    """
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = sizes.join(weights.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    t = t.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.least(F.sum("source_size").over(every) * float(budget_share), F.sum("cap").over(every)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"])
    return t.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce("level", "fills_at") * F.col("weight")).alias("target"))


def cycling_weights(sizes: DataFrame, cycle: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights by place in code-point order of the names, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", size: Column | None = None, key: str = "doc_id", budget_share: float = SHARE, max_epochs: int = MAX_EPOCHS, split: bool = True, sequence: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, ``carry`` columns, source, size, source_size, target, taken (words, repeats counted), copies.

    With ``sequence``, one row a copy that is taken instead, with its epoch, words, virtual finish time and end position in the mix.
    """
    # Where the range a row falls in must not depend on the run, the shuffle is a hash of the row's own values.
    d = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), (words("text") if size is None else size).alias("size"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
        (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("long") / float(1 << 52)).alias("draw"),
    )
    # Texts are read and measured once; from here on rows are a few numbers.
    folder = shared_folder(docs.sparkSession, "mix")
    d = written(d, folder, "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row a source; no hint, so Spark broadcasts it only if its size allows.
    plan = targets(sizes, cycling_weights(sizes) if weights is None else weights, budget_share, max_epochs)
    # The small tables are written too, so that no plan holds all that came before it several times.
    plan = written(plan.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_RANGE))), folder, "plan")
    plan = plan.withColumnRenamed("source", "p_source")
    d = d.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source", "n_docs").withColumn("part", F.floor(F.col("draw") * F.col("ranges")))
    totals = written(d.groupBy("source", "part").agg(F.sum("size").alias("part_size")), folder, "totals")
    totals = running_before(totals, ("source",), "part", "part_size", "offset").select(F.col("source").alias("t_source"), F.col("part").alias("t_part"), "offset")
    totals = written(totals, folder, "offsets")
    within = Window.partitionBy("source", "part").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(within)).join(totals, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("part") == F.col("t_part"))).withColumn("upto", F.col("upto") + F.col("offset"))

    # Copies, with the words that lie before the source's line (time 1) and the virtual finish time.
    copy = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("ends", F.col("upto") + F.col("epoch") * F.col("source_size"))
    if split:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("ends") + F.col("size")))
    else:
        part = F.when(F.col("ends") - F.col("size") / 2 <= F.col("target"), F.col("size")).otherwise(0)
    copy = copy.withColumn("words", part.cast("long")).withColumn("finish", F.when(F.col("target") > 0, (F.col("ends") - F.col("size") + F.col("words")) / F.col("target")).otherwise(0.0))

    # The global range sort: ranges of virtual time, their running sums, a sort within each range.
    total = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("rows"))
    time_ranges = total.select(F.greatest(F.lit(float(TIME_RANGES)), F.ceil(F.col("rows") / ROWS_PER_RANGE)).alias("time_ranges"))
    # One row, so this is a lookup of a number.
    copy = copy.crossJoin(F.broadcast(time_ranges)).withColumn("slot", F.floor(F.col("finish") * F.col("time_ranges")))
    copy = written(copy, folder, "queue")
    used = copy.filter("words > 0")
    slots = written(used.groupBy("slot").agg(F.sum("words").alias("slot_words")), folder, "slots")
    slots = running_before(slots, (), "slot", "slot_words", "slot_offset").select(F.col("slot").alias("s_slot"), "slot_offset")
    slots = written(slots, folder, "slot-offsets")
    budget = plan.agg(F.round(F.sum("target")).cast("long").alias("budget"))
    by_time = Window.partitionBy("slot").orderBy("finish", "draw", F.col("doc_id").asc_nulls_last(), "epoch", "source").rowsBetween(Window.unboundedPreceding, 0)
    used = used.withColumn("position", F.sum("words").over(by_time)).join(slots, F.col("slot") == F.col("s_slot")).crossJoin(F.broadcast(budget))
    used = used.withColumn("position", F.col("position") + F.col("slot_offset"))
    if split:
        kept = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("position") + F.col("words")))
    else:
        kept = F.when(F.col("position") - F.col("words") / 2 <= F.col("budget"), F.col("words")).otherwise(0)
    used = used.withColumn("words", kept.cast("long"))
    out = [F.col(c) for c in ("doc_id", *(f"c{i}" for i in range(len(carry))), "source", "size", "source_size", "target")]
    if sequence:
        got = used.filter("words > 0").select(*out, "epoch", "words", "finish", "position")
    else:
        # A document's copies meet again by its place in its source, which no other document with words has.
        none = copy.filter("words = 0").withColumn("position", F.lit(None).cast("long"))
        both = used.select(*none.columns).unionByName(none)
        same = [c for c in ("doc_id", "upto", *(f"c{i}" for i in range(len(carry))), "source", "size", "source_size", "target")]
        got = both.filter("size > 0").groupBy(*same).agg(F.sum("words").alias("taken"), F.sum((F.col("words") > 0).cast("int")).cast("int").alias("copies")).drop("upto")
        empty = d.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"))
        got = got.unionByName(empty)
    own = tuple(c for c in got.columns if c not in {f"c{i}" for i in range(len(carry))})
    return got.withColumnsRenamed(dict(zip((f"c{i}" for i in range(len(carry))), apart(carry, own), strict=True)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole and as often as it takes them. Every row has copies of its own; only rows equal in all columns, which can't be told apart, share theirs."""
    h, w_id, w_hash, copies, copy = fresh(docs, "row_hash", "mix_id", "mix_hash", "mix_copies", "mix_copy")
    hashed = docs.withColumn(h, row_hash(docs))
    mine = hashed.select("doc_id", "text", "source", F.col(h).alias("row_hash"))
    took = mix(mine, split=False, carry=("row_hash",), **options).filter("copies > 0").groupBy(F.col("doc_id").alias(w_id), F.col("row_hash").alias(w_hash)).agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias("rows"))
    took = written(took, shared_folder(docs.sparkSession, "mix"), "copies")
    if not took.filter("rows > 1").isEmpty():
        hashed = hashed.dropDuplicates(["doc_id", h])
    out = hashed.join(took.drop("rows"), F.col("doc_id").eqNullSafe(F.col(w_id)) & (F.col(h) == F.col(w_hash)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2.0 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / weight AS fills, least(CAST(sum(source_size) OVER () AS DOUBLE) * 1.5, sum(cap) OVER ()) AS budget FROM w),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM f WINDOW o AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT level FROM v WHERE level <= fills ORDER BY fills, level LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM z), fills) * weight) AS target FROM v),
u AS (SELECT doc_id, d.source, size, draw, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - (upto + e * source_size) + size)) AS words FROM u, (VALUES (0), (1)) x(e)),
k AS (SELECT *, (upto + e * source_size - size + words) / target AS finish FROM c WHERE words > 0),
p AS (SELECT *, CAST(sum(words) OVER (ORDER BY finish, draw, doc_id, e, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position FROM k),
g AS (SELECT doc_id, source, upto, sum(greatest(0, least(words, (SELECT CAST(round(sum(target)) AS BIGINT) FROM t) - position + words))) AS taken FROM p GROUP BY 1, 2, 3)
SELECT u.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.source IS NOT DISTINCT FROM u.source AND g.upto = u.upto AND u.size > 0
"""
