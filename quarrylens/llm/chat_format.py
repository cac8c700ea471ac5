"""Chat formatting of reply trees, in DataFrame functions only.

Every message knows its parent. Iterative self-joins double the distance that jumps span (parent,
grandparent, four up, ...) and sum the scores on the way, so a tree of depth d takes log2(d) joins, and rows
stay one a message. Leaves are the ends of root-to-leaf paths; in each tree the ``top_k`` best paths by
mean score are kept (ties: the longer, then the smaller leaf). The same jumps, from far to near, list
the messages of each chosen path. A path becomes one conversation: turns in marks, control strings
within texts escaped by one more backslash (reversibly), and the spans of assistant text, which is what
the loss covers.

Defined cases: null texts and roles are empty; a null tree id is a tree of its own; a message whose parent
is missing is a root; messages on a cycle have no root and are left out; equal rows are turns of their own.
Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, shared_folder, table

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that a template may act on: any <|...|> mark, <s>, </s>, [INST] and [/INST].
_CONTROL = r"(\||/?s>|/?INST\])"
_SALTS = 16


def escape(text: Column) -> Column:
    """Put one more backslash after the first sign of every control string, escaped ones included."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", r"$1$2$3")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def best_paths(messages: DataFrame, folder: str, top_k: int = 1) -> DataFrame:
    """``messages``: tree, node, parent (null: root), score. Rows: tree, leaf, node, depth (root: 1), in chosen paths only."""
    nodes = kept(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), folder, "nodes")
    there = nodes.select("tree", F.col("node").alias("parent")).distinct()
    linked = nodes.join(there.withColumn("known", F.lit(True)), ["tree", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    # far: the message 2**k up (null once past the root); depth and sum: of the stretch below it.
    state = kept(linked.select("tree", "node", F.col("parent").alias("far"), F.lit(1).alias("depth"), F.col("score").alias("sum")), folder, "hop-0")
    first, hops = state, []
    most = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << len(hops) <= 2 * most and not state.filter("far is not null").isEmpty():
        hops.append(state.filter("far is not null").select("tree", "node", "far"))
        up = state.select("tree", F.col("node").alias("far"), F.col("far").alias("next"), F.col("depth").alias("d"), F.col("sum").alias("s"))
        # Only messages that haven't reached their root are joined again; the others are carried over.
        joined = state.filter("far is not null").join(up, ["tree", "far"]).select("tree", "node", F.col("next").alias("far"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("sum") + F.col("s")).alias("sum"))
        state = kept(joined.unionByName(state.filter("far is null")), folder, f"hop-{len(hops)}")
    rooted = state.filter("far is null")
    leaves = rooted.join(first.select("tree", F.col("far").alias("node")).filter("node is not null").distinct(), ["tree", "node"], "left_anti")

    # The best of each tree: first within salted shares of its leaves, then among those.
    order = [(F.col("sum") / F.col("depth")).desc(), F.col("depth").desc(), F.col("node")]
    for keys in (["tree", F.pmod(F.xxhash64("node"), F.lit(_SALTS))], ["tree"]):
        leaves = leaves.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= top_k)
    # Each round adds the messages one hop above those so far; hops halve from round to round.
    on = kept(leaves.select("tree", F.col("node").alias("leaf"), "node"), folder, "paths-0")
    for k, hop in enumerate(reversed(hops), 1):
        up = on.join(hop, ["tree", "node"]).select("tree", "leaf", F.col("far").alias("node"))
        on = kept(on.unionByName(up).distinct(), folder, f"paths-{k}")
    return on.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def format_trees(messages: DataFrame, *, top_k: int = 1) -> DataFrame:
    """``messages``: tree (not null), node (long), parent, role, text, score. Rows: tree, leaf, formatted, loss (array of start and
    length, in code points of ``formatted``)."""
    folder = shared_folder(messages.sparkSession, "chat")
    paths = best_paths(messages.select("tree", "node", "parent", "score"), folder, top_k)
    turns = paths.join(messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    head, body = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("tree", "leaf", "depth", F.col("role") == "assistant", head.alias("head"), body.alias("body"))
    turns = turns.toDF("tree", "leaf", "depth", "spoken", "head", "body").withColumn("piece", F.concat("head", "body", F.lit(END)))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumn("start", upto - F.length("piece") + F.length("head"))
    span = F.when(F.col("spoken"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return whole.select("tree", "leaf", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, from ``formatted`` and ``loss`` alone."""
    raw = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    turn = lambda x: F.struct(_unrole(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(END))).alias("text"))
    spoken = lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    return formatted.withColumn("turns", F.transform(raw, turn)).withColumn("loss_text", F.array_join(F.transform("loss", spoken), ""))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null id is a conversation of its own, so trees are named by texts.
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(tree.alias("tree"), "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit("c-1").alias("tree"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = rows.unionByName(more)
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.select("tree", place.cast("long").alias("node"), "role", "text")
    messages = rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
    back = read_back(format_trees(messages))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "", F.substring("tree", 2, 20).cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS own,
      length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS named FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(8 + named + 1 + own + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
