"""Graph operators over edge tables (src, dst). Loops are driver loops over DataFrames, cut by files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. Where spark.checkpoint.dir is unset a local one serves in local mode; elsewhere that is an error.

    Not ``checkpoint``: that keeps the plan's estimated size, which joins multiply. In a loop that joins what it kept with itself the estimate has twice as many digits each
    round, until the driver's memory is full of them. Files have their own size.
    """
    spark = df.sparkSession
    top = spark.sparkContext.getCheckpointDir()
    if not top:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = top or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    folder = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Edges a node, at least, among which components are searched first.
FIRST = 8


def degrees(edges: DataFrame) -> DataFrame:
    """node, ce (distinct out), ca (distinct in)."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"))


def hubs(edges: DataFrame, percentile: float = 0.9) -> DataFrame:
    """Nodes whose in-degree reaches the value at index int(percentile x n) of all in-degrees, sorted. From counts of degrees, not a sort of nodes."""
    from pyspark.sql import Window

    d = degrees(edges)
    c = d.groupBy("ca").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("ca").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    at = c.withColumn("upto", upto).withColumn("at", F.floor(percentile * total)).filter("upto > at").agg(F.min("ca").alias("cutoff"))
    return d.crossJoin(F.broadcast(at)).filter("ca >= cutoff and ca > 0").drop("cutoff")  # one number


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path. Semi-naive: each round extends only the pairs that the last one found."""
    e = cut(edges.select("src", "dst").distinct())
    total, new = e, e
    while True:
        step = new.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
        new = cut(step.join(total, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return total
        total = cut(total.unionByName(new))


def spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least label among a node's own and those of all nodes with a path to it."""
    now = cut(labels)
    front = now
    while True:
        come = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        moved = cut(now.join(come, "node").filter("new < label").select("node", F.col("new").alias("label")))
        if moved.isEmpty():
            return now
        now = cut(now.join(moved.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        front = moved


def contract(edges: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Of distinct edges without loops (src, dst, length) the runs of nodes with one edge in and one out, by doubling, so in rounds as the logarithm of a run's length. ``stops``: nodes that
    are never inside a run. None, if no node is.

    short: src, dst, length; the edges between other nodes, a run between two as one edge of its length. inner: node, last; the nodes inside runs, by the run's last one. runs: last, src, dst;
    what a run joins. rings: node, component (the least node); cycles of nothing but such nodes.
    """
    one = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"), F.min("length").alias("length")).filter("n = 1")
    one = one.join(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("m")).filter("m = 1"), "node").select("node", "to", "length")
    if stops is not None:
        one = one.join(stops, "node", "left_anti")
    one = cut(one)
    if one.isEmpty():
        return None
    inside = one.select("node")
    goes_on = inside.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    p = cut(one.join(goes_on, "to", "left").select("node", "to", F.col("node").alias("last"), F.least("node", F.when(F.col("open"), F.col("to")).otherwise(F.col("node"))).alias("least"), "length", F.coalesce("open", F.lit(False)).alias("open"), F.lit(True).alias("moved")))
    moved = not p.filter("open").isEmpty()
    while moved:
        then = p.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("last").alias("l"), F.col("least").alias("m"), F.col("length").alias("k"), F.col("open").alias("o"))
        # On a ring nothing closes; it is known once no least node gets less, as then the windows that were met have gone all around.
        ahead = p.filter("open").join(then, "to").select("node", F.col("then").alias("to"), F.col("l").alias("last"), F.least("least", "m").alias("least"), (F.col("length") + F.col("k")).alias("length"), F.col("o").alias("open"), (~F.col("o") | (F.col("m") < F.col("least"))).alias("moved"))
        new = cut(ahead)
        moved = not new.filter("moved").isEmpty()
        p = cut(p.filter("not open").unionByName(new))
    closed = p.filter("not open")
    rest = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_anti")
    into = rest.join(closed.select(F.col("node").alias("dst"), "last", "to", F.col("length").alias("more")), "dst", "left")
    into = cut(into.select("src", F.coalesce("to", "dst").alias("dst"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), "last"))
    short = into.filter("src <> dst").groupBy("src", "dst").agg(F.min("length").alias("length"))
    return cut(short), closed.select("node", "last"), into.filter("last is not null").select("last", "src", "dst", "length"), p.filter("open").select("node", F.col("least").alias("component"))


def _coloured(e: DataFrame) -> DataFrame:
    """node, component (any of its nodes) for a graph each of whose nodes has edges in and out. Coloured by the least ancestor; the components are the nodes that reach it within its colour."""
    colour = spread(e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("label")).select("node", F.least("node", "label").alias("label")), e)
    same = e.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").filter("c = d")
    back = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c").repartition("src"))
    left = cut(colour.filter("node <> label"))
    done = [cut(colour.filter("node = label").toDF("node", "component"))]
    while True:
        # A node is reached within its own colour alone, so those that are left are a set of nodes.
        met = back.join(done[-1].toDF("src", "component"), "src").filter("c = component").select(F.col("dst").alias("node")).distinct()
        front = cut(left.join(met, "node").toDF("node", "component"))
        if front.isEmpty():
            break
        done.append(front)
        left = cut(left.join(front.select("node"), "node", "left_anti"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out)


def _components(e: DataFrame, once: bool = False) -> DataFrame:
    """node, component (any of its nodes) of distinct edges without loops, for nodes on a cycle with others and some that are alone.

    Coloured, not from the closure, which grows with the square of the nodes. Each round drops nodes without an edge in or out, makes one edge of each run of nodes with one
    edge in and out (so a long ring or path takes few rounds), and colours the rest. Runs get their components from their ends. With ``once`` it colours once, without runs: some components
    may be missing.
    """
    found, runs = e.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0), []
    while not e.isEmpty():
        both = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = cut(e.select(F.explode(both).alias("x")).select("x.*").groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
        ends, single = degree.agg(F.count_if(F.expr("o = 0 or i = 0")), F.count_if(F.expr("o = 1 and i = 1"))).first()  # one row
        if ends:
            kept = degree.filter("o > 0 and i > 0").select("node")
            e = cut(e.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        if single and not once and (short := contract(e.withColumn("length", F.lit(1)))) is not None:
            e = short[0].select("src", "dst")
            runs.append(short[1:3])
            found = cut(found.unionByName(short[3]))
            continue
        if ends:
            continue
        done = _coloured(e)
        found = cut(found.unionByName(done))
        gone = degree.select("node").join(done.select("node"), "node", "left_anti")
        if once or gone.isEmpty():
            break
        e = cut(e.join(gone.toDF("src"), "src", "left_semi").join(gone.toDF("dst"), "dst", "left_semi").select("src", "dst"))
    for inner, joins in reversed(runs):
        j = joins.join(found.toDF("src", "a"), "src", "left").join(found.toDF("dst", "b"), "dst", "left")
        # A run that comes back to its start closes a cycle, though its start may lie on no other.
        j = cut(j.filter("a = b or src = dst").select("last", "src", F.coalesce("a", "src").alias("component"), F.col("a").isNull().alias("first")))
        start = j.filter("first").select(F.col("src").alias("node"), "component").distinct()
        found = cut(found.unionByName(start).unionByName(inner.join(j.select("last", "component"), "last").select("node", "component")))
    return found


def _joined(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """src, dst: the distinct edges between ``parts`` (node, component); a node that has none is its own."""
    e = edges.join(parts.toDF("src", "a"), "src", "left").select(F.coalesce("a", "src").alias("src"), "dst")
    e = e.join(parts.toDF("dst", "b"), "dst", "left").select("src", F.coalesce("b", "dst").alias("dst"))
    return e.filter("src <> dst").distinct()


def condense(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, component (any of its nodes), for nodes on a cycle with others; and src, dst, the distinct edges between components and other nodes.

    Where edges are many times the nodes, the components of a share of them, about ``FIRST`` a node and picked by hash, come first. What is strongly connected by those is so by all, so it
    counts as one node, and all edges but those between such nodes go in one pass; the whole of the rest is then searched. Each edge is thus read a few times, not once for each round.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst"))
    rows, srcs, dsts = e.agg(F.count("*"), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()  # one row
    nth = rows // (FIRST * max(srcs, dsts, 1))
    first = None
    if nth > 1:
        first = _components(cut(e.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(nth)) == 0).distinct()), once=True)
        e = cut(_joined(e, first))
    else:
        e = cut(e.distinct())
    found = _components(e)
    between = _joined(e, found)
    if first is not None:
        # The later components are of the earlier ones.
        later = first.join(found.toDF("component", "c"), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
        found = later.unionByName(found.join(first.select(F.col("component").alias("node")), "node", "left_anti"))
    many = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return cut(found.join(many, "component").select("node", "component")), between


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), size, for nodes on a cycle with others."""
    found = condense(edges)[0]
    sizes = found.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    return found.join(sizes, "component").select("node", F.col("least").alias("component"), "size")


def dependents(edges: DataFrame) -> DataFrame:
    """node, n_dependents: how many other nodes have a path to it (none: no row). The closure is only of strong components."""
    inside, between = condense(edges)
    between = cut(between)
    sizes = inside.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("size"))
    ends = between.select(F.col("src").alias("part")).union(between.select("dst")).distinct()
    alone = ends.join(sizes, "part", "left_anti").select(F.col("part").alias("node"), "part")
    above = closure(between).join(sizes.toDF("src", "n"), "src", "left").groupBy(F.col("dst").alias("part")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("above"))
    part = inside.select("node", F.col("component").alias("part")).unionByName(alone).join(sizes, "part", "left").join(above, "part", "left")
    return part.select("node", (F.coalesce("above", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_dependents")).filter("n_dependents > 0")


def simple_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """path, length: simple cycles of up to ``longest`` nodes, as arrays that begin with their least node.

    Nodes are columns of their own, so that what only counts cycles moves the first and last node of a path. A path is closed by a join on both of them, not by one on the last
    node, which would list every way on from it.

    The longest paths aren't listed before it is known that they may close. An edge goes on with the 16-bit hashes of the first nodes of the paths that it could end (65,536 at most), and
    meets the edges back to such nodes; what hashes let through is joined with the paths, so the result is exact.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    paths = e.filter("dst > src").select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    back = e.filter("dst < src")  # a cycle is closed at its least node
    found = None
    for n in range(2, max(2, longest - 1) + 1):
        last, nodes = f"n{n - 1}", [f"n{i}" for i in range(n)]
        ends = back.select(F.col("src").alias(last), F.col("dst").alias("n0"))
        # Edges are hashed where paths are many, so those aren't sorted; each edge is a key of its own, so partitions are alike.
        ends = ends.hint("shuffle_hash") if n > 2 else ends
        closed = paths.join(ends, ["n0", last], "left_semi").select(F.array(*nodes).alias("path"), F.lit(n).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest - 1:
            to = F.col(f"n{n}")
            grown = paths.join(e.select(F.col("src").alias(last), F.col("dst").alias(f"n{n}")), last)
            paths = grown.filter(to > F.col("n0")).filter(~F.array_contains(F.array(*nodes[1:]), to)).select(*nodes, to)
    if longest < 3:
        return found
    last, nodes, end = f"n{longest - 2}", [f"n{i}" for i in range(longest - 1)], f"n{longest - 1}"
    short = lambda c: (F.pmod(F.xxhash64(c), F.lit(1 << 16)) - (1 << 15)).cast("short")
    firsts = paths.groupBy(last).agg(F.collect_set(short("n0")).alias("__h"), F.min("n0").alias("__low"))
    on = e.select(F.col("src").alias(last), F.col("dst").alias(end)).join(firsts, last).filter(F.col(end) > F.col("__low")).drop("__low")
    ways = on.join(back.select(F.col("src").alias(end), F.col("dst").alias("n0")), end).filter((F.col("n0") < F.col(last)) & F.array_contains("__h", short("n0"))).select("n0", last, end)
    closed = ways.join(paths, ["n0", last])
    if longest > 3:
        closed = closed.filter(~F.array_contains(F.array(*nodes[1:-1]), F.col(end)))
    return found.unionByName(closed.select(F.array(*nodes, end).alias("path"), F.lit(longest).alias("length")))


def _inside_components(edges: DataFrame) -> DataFrame:
    """src, dst: the edges that lie on some cycle."""
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    c = cut(strong_components(e).select("node", "component"))
    return cut(e.join(c.toDF("src", "component"), "src").join(c.toDF("dst", "other"), "dst").filter("component = other").select("src", "dst"))


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """All simple cycles of two nodes or more, of any length (or up to ``longest``), as arrays that begin with their least node.

    Only edges inside strong components count. A path starts at the cycle's least node and goes on only to nodes above it from which the start can be reached through
    nodes above it, within what is left of ``longest``: distances back to each start are found first, breadth first. So no path wanders off into parts that never return.
    """
    e = _inside_components(edges)
    back = e.select(F.col("src").alias("node")).distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("d"))
    back = front = cut(back)
    d = 0
    while longest is None or d < longest - 1:
        d += 1
        step = front.select("start", F.col("node").alias("dst")).join(e, "dst").filter(F.col("src") > F.col("start")).select("start", F.col("src").alias("node"), F.lit(d).alias("d")).distinct()
        front = cut(step.join(back, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        back = cut(back.unionByName(front))
    home = back.withColumnsRenamed({"node": "dst", "d": "left"})
    paths = cut(e.filter("dst > src").select(F.col("src").alias("start"), "dst").join(home, ["start", "dst"]).select("start", F.array("start", "dst").alias("path")))
    found, length = None, 2
    while not paths.isEmpty():
        ends = paths.withColumn("src", F.element_at("path", -1))
        closed = cut(ends.join(e.withColumnRenamed("dst", "start"), ["src", "start"], "left_semi").select("path"))
        found = closed if found is None else found.unionByName(closed)
        ends = ends.join(e, "src")
        grown = ends.filter((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).join(home, ["start", "dst"])
        if longest is not None:
            grown = grown.filter(F.lit(length) + F.col("left") <= longest)
        length += 1
        paths = cut(grown.select("start", F.concat("path", F.array("dst")).alias("path")))
    return e.select(F.array("src").alias("path")).limit(0) if found is None else found


def edge_cycles(edges: DataFrame) -> DataFrame:
    """For each edge on a cycle a shortest cycle through it, each set of nodes once, as arrays that begin with their least node: at most as many as edges, while all simple cycles
    may be exponentially many. Of paths equally long the least counts."""
    e = _inside_components(edges)
    seen = front = cut(e.select(F.col("src").alias("start")).distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    while True:
        step = front.withColumnRenamed("node", "src").join(e, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    found = e.select(F.col("dst").alias("start"), F.col("src").alias("node")).join(seen, ["start", "node"]).select("path")
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path") - at + 1), F.slice("path", F.lit(1), at - 1))
    return found.select(turned.alias("path")).groupBy(F.array_sort("path").alias("nodes")).agg(F.min("path").alias("path")).select("path")


def component_cycles(edges: DataFrame) -> DataFrame:
    """component (its least node), length: of each strong component the shortest cycle through its least node. Runs of nodes with one edge in and one out are one edge of
    their length, so rounds are as many as such edges on a way; each takes all components one edge further."""
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    c = cut(strong_components(e).select("node", "component"))
    e = cut(e.join(c.toDF("src", "component"), "src").join(c.toDF("dst", "other"), "dst").filter("component = other").select("src", "dst", F.lit(1).alias("length")))
    roots = cut(c.filter("node = component").select("component", "node"))
    short = contract(e, roots.select("node"))
    ways = e
    if short is not None:
        # Runs from the least node to itself are no edges of ``short``.
        ways = cut(short[0].unionByName(short[2].filter("src = dst").select("src", "dst", "length")))
    best = front = cut(roots.withColumn("d", F.lit(0)))
    home = cut(roots.select("component", F.lit(None).cast("int").alias("length")).limit(0))
    while not front.isEmpty():
        step = cut(front.withColumnRenamed("node", "src").join(ways, "src").groupBy("component", F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("length")).alias("d")))
        home = cut(home.unionByName(step.filter("node = component").select("component", F.col("d").alias("length"))).groupBy("component").agg(F.min("length").alias("length")))
        go = step.filter("node <> component").join(best.withColumnRenamed("d", "known"), ["component", "node"], "left").join(home, "component", "left")
        front = cut(go.filter("(known is null or d < known) and (length is null or d < length)").select("component", "node", "d"))
        best = cut(best.unionByName(front).groupBy("component", "node").agg(F.min("d").alias("d")))
    return home


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, place (from 1): by level, ties by node. A node on or behind a cycle has no level; those come last, by node. Only within ranges of equal level is
    anything sorted: places are offset by counts of levels and of ranges of nodes."""
    from pyspark.sql import Window

    level = nodes.join(levels(edges), "node", "left").withColumn("level", F.coalesce("level", F.when(F.lit(True), F.lit(None).cast("int"))))
    known = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("linked", F.lit(True))
    d = level.join(known, "node", "left").withColumn("level", F.when(F.col("linked").isNull(), 0).otherwise(F.coalesce("level", F.lit(2_000_000_000))))
    d = d.withColumn("range", F.floor(F.col("node") / 10_000))
    sizes = d.groupBy("level", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("level", "range")) - F.col("n")).drop("n")  # a row for each 10,000 nodes of a level
    place = F.row_number().over(Window.partitionBy("level", "range").orderBy("node"))
    return d.withColumn("i", place).join(before, ["level", "range"]).select("node", (F.col("i") + F.col("before")).alias("place"))


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the length of the longest path that ends there. Rows on or behind a cycle get none (null).

    Each round settles the nodes all of whose sources are settled: the edges of the nodes that the last round settled are counted off, those of others stay unread but for the join.
    """
    e = cut(edges.select("src", "dst").distinct())
    both = F.array(F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).cast("long").alias("i")))
    nodes = cut(e.select(F.explode(both).alias("x")).select("x.*").groupBy("node").agg(F.sum("i").alias("open")))
    done = front = cut(nodes.filter("open = 0").select("node", F.lit(0).alias("level")))
    left = cut(nodes.filter("open > 0"))
    while not front.isEmpty():
        met = e.join(front.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"), F.max("level").alias("last"))
        left = cut(left.join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), "last"))
        front = cut(left.filter("open = 0").select("node", (F.col("last") + 1).alias("level")))
        left = left.filter("open > 0").select("node", "open")
        done = cut(done.unionByName(front))
    return nodes.select("node").join(done, "node", "left")


def chase(pointers: DataFrame) -> DataFrame:
    """old, new (the end of each chain of old -> new), by doubling; a cycle leads to null."""
    p = cut(pointers.toDF("old", "new"))
    for _ in range(64):
        nxt = p.select(F.col("old").alias("new"), F.col("new").alias("then"))
        moved = cut(p.join(nxt, "new", "left").select("old", F.coalesce("then", "new").alias("new"), F.col("then").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.select("old", "new")
        if moved.filter("moved and old <> new").isEmpty():
            break
        p = moved.select("old", "new")
    return p.join(p.select(F.col("old").alias("new"), F.lit(True).alias("loops")), "new", "left").select("old", F.when(F.col("loops").isNull(), F.col("new")).alias("new"))
