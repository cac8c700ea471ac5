"""Saved records: commit indexes, blame, snapshots, histories, baselines, decisions, analyses, event logs and graphs, written and read back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import parse_time

# --- commits -----------------------------------------------------------------------------------


def index_commits(spark: SparkSession, path: str, new: DataFrame, *, ancestor: bool, as_of, window_days: int = 90) -> DataFrame:
    """Append commits (hash, ts, ...) to the index at ``path`` and return it, within the window and each hash once. Without ``ancestor`` (the last
    commit of the index isn't one of the new head's) the index is written anew. Only new hashes are appended."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    recent = F.col("ts") >= F.timestamp_add("DAY", F.lit(-window_days), F.lit(as_of).cast("timestamp"))
    new = new.dropDuplicates(["hash"])
    try:
        old = spark.read.schema(new.schema).parquet(path) if ancestor else None
        there = old is not None and not old.isEmpty()
    except (AnalysisException, Py4JJavaError):
        there = False
    if there:
        new.join(old.select("hash"), "hash", "left_anti").select(*new.columns).write.mode("append").parquet(path)
    else:
        new.write.mode("overwrite").parquet(path)
    return spark.read.schema(new.schema).parquet(path).filter(recent).dropDuplicates(["hash"])


def blame(raw: DataFrame) -> DataFrame:
    """``raw``: path and ``value``, the porcelain text of a file. path, line, hash, author, email, ts, text: a row a line. A commit's header stands at
    its first line only, so it is joined to the others of the file."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)([0-9a-f]{40} [0-9]+ [0-9]+[^\n]*\n(?:[^\t].*?)?\t[^\n]*)"), F.lit(1)))
    e = raw.select("path", entry.alias("e"))
    field = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^{name} (.*)$", 1), F.lit(""))
    e = e.select("path", F.substring("e", 1, 40).alias("hash"), F.split(F.split("e", "\n")[0], " ")[2].cast("int").alias("line"), field("author").alias("author"), F.regexp_replace(field("author-mail"), "[<>]", "").alias("email"), F.timestamp_seconds(field("author-time").cast("long")).alias("ts"), F.regexp_extract("e", r"\t([^\n]*)$", 1).alias("text"))
    head = e.filter("author is not null").groupBy("path", "hash").agg(*(F.first(c).alias(c) for c in ("author", "email", "ts")))
    return e.select("path", "line", "hash", "text").join(head, ["path", "hash"], "left").select("path", "line", "hash", "author", "email", "ts", "text")


def blame_ranges(findings: DataFrame, margin: int = 0) -> DataFrame:
    """path, first, last: the one range of lines to read of each file."""
    return findings.groupBy(F.col("file_path").alias("path")).agg(F.greatest(F.lit(1), F.min("start_line") - margin).alias("first"), (F.max("end_line") + margin).alias("last"))


# Marks of automated authors, and of those that work with a tool.
_BOTS, _TOOLS = r"(?i)\[bot\]|dependabot|renovate|github-actions", r"(?i)copilot|claude|cursor|aider|gpt"


def author_class(author, message):
    """bot, assisted or human."""
    return F.when(author.rlike(_BOTS), "bot").when(author.rlike(_TOOLS) | F.coalesce(message, F.lit("")).rlike(r"(?im)^co-authored-by:.*(copilot|claude|cursor|aider|gpt)"), "assisted").otherwise("human")


def recent_merges(commits: DataFrame, as_of, *, limit: int = 50, since_days: int = 180) -> DataFrame:
    """The last merges (``n_parents`` above 1) of the first-parent line (``on_main``) with the class of their author."""
    recent = F.col("ts") >= F.timestamp_add("DAY", F.lit(-since_days), F.lit(as_of).cast("timestamp"))
    m = commits.filter(recent & (F.col("n_parents") > 1) & F.col("on_main")).orderBy(F.desc("ts"), "hash").limit(limit)
    return m.withColumn("author_class", author_class(F.col("author"), F.col("message")))


# --- snapshots, histories, baselines --------------------------------------------------------------


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One row a saved scan (a JSON file each), oldest first; files that don't parse are left out."""
    raw = spark.read.text(folder, wholetext=True)
    row = F.from_json("value", "ts string, commit string, score double, findings array<struct<signal:string,file_path:string,line:int,score:double,fingerprint:string>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    s = raw.select(row.alias("r")).select("r.*").filter("_bad is null and ts is not null").drop("_bad")
    return s.withColumn("ts", parse_time(F.col("ts"))).orderBy("ts", "commit")


def trend(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """ts, score, n_findings of each run, and whether some line doesn't parse."""
    row = F.from_json("value", "ts string, score double, n_findings long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    r = spark.read.text(path).filter(F.trim("value") != "").select(row.alias("r")).select("r.*")
    return r.filter("_bad is null").drop("_bad").withColumn("ts", parse_time(F.col("ts"))), not r.filter("_bad is not null").isEmpty()


def save_trend(runs: DataFrame, path: str, most: int = 100) -> None:
    """The last ``most`` runs, in a new file that takes the old one's place as Spark commits it."""
    last = runs.orderBy(F.desc("ts")).limit(most)
    last.coalesce(1).sortWithinPartitions("ts").select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "score", "n_findings")).alias("value")).write.mode("overwrite").text(path)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint: of a JSON baseline of either version (1: an array of strings ``fingerprints``; 2: objects in ``findings``)."""
    both = "version int, fingerprints array<string>, findings array<struct<fingerprint:string,fingerprint_v1:string>>"
    b = spark.read.text(path, wholetext=True).select(F.from_json("value", both).alias("b")).select("b.*")
    old, new = F.coalesce("fingerprints", F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform("findings", lambda x: F.array(x["fingerprint"], x["fingerprint_v1"]))), F.array().cast("array<string>"))
    return b.select(F.explode(F.concat(old, new)).alias("fingerprint")).filter("fingerprint is not null").distinct()


def analysis(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved analysis, one a fingerprint (the highest score of equal ones)."""
    a = spark.read.text(path, wholetext=True).select(F.from_json("value", "findings array<struct<fingerprint:string,signal:string,file_path:string,line:int,title:string,score:double>>").alias("a"))
    f = a.select(F.explode("a.findings").alias("f")).select("f.*")
    return f.groupBy("fingerprint").agg(F.max_by(F.struct("signal", "file_path", "line", "title", "score"), F.struct("score", "file_path")).alias("x")).select("fingerprint", "x.*")


# --- decisions ------------------------------------------------------------------------------------


def decisions(files: DataFrame) -> DataFrame:
    """path, id, status, title, scopes: of Markdown decisions with front matter between lines of three dashes; ``scope`` is one glob or a list."""
    head = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda name: F.regexp_replace(F.trim(F.regexp_extract("head", rf"(?m)^{name}:[ \t]*(.*)$", 1)), r"""^['"]|['"]$""", "")
    d = files.filter("language = 'markdown'").withColumn("head", head).filter("head <> ''")
    listed = F.regexp_extract_all("head", F.lit(r"(?m)^[ \t]+-[ \t]*['\"]?([^'\"\n]+)"), F.lit(1))
    one = F.filter(F.transform(F.split(F.regexp_replace(field("scope"), r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.nullif(field("title"), F.lit("")), F.nullif(F.regexp_extract("content", r"(?m)^# (.*)$", 1), F.lit("")))
    return d.select("path", F.coalesce(F.nullif(field("id"), F.lit("")), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("id"), F.lower(field("status")).alias("status"), title.alias("title"), F.concat(one, listed).alias("scopes"), "content")


def relevant_decisions(d: DataFrame, paths: list[str], task: str, most: int = 5) -> DataFrame:
    """Active decisions whose scope begins one of the paths, or the other way round, else those that name a word of the task (of four letters or more)."""
    base = F.transform("scopes", lambda s: F.regexp_replace(s, r"/?\*.*$", ""))
    one = lambda p: F.exists(base, lambda s: (s != "") & (F.lit(p).startswith(s) | s.startswith(p)))
    begins = functools.reduce(lambda x, p: x | one(p), paths, F.lit(False))
    words = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in task).split() if len(w) > 3})
    named = F.arrays_overlap(F.split(F.lower("content"), "[^a-z0-9]+"), F.array(*map(F.lit, words))) if words else F.lit(False)
    found = d.filter(F.col("status").isin("accepted", "active", "proposed")).withColumn("why", F.when(begins, "scope").when(named, "task")).filter("why is not null")
    return found.orderBy(F.when(F.col("why") == "scope", 0).otherwise(1), "id").limit(most).select("id", "title", "why")


# --- event log and graph -----------------------------------------------------------------------


def append_json(rows: DataFrame, path: str) -> None:
    """Add rows to an append-only log of JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """task, event, worker, ts, seq of a queue's log in order; lines that don't parse are left out."""
    row = F.from_json("value", "task string, event string, worker string, ts string, seq long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(row.alias("r")).select("r.*").filter("_bad is null and task is not null").drop("_bad").withColumn("ts", parse_time(F.col("ts"))).orderBy("seq")


def queue_state(events: DataFrame, now, lease_seconds: int = 900, most_reclaims: int = 3) -> DataFrame:
    """task, state, worker, claims: after the last event of each task. A claim whose lease ran out is open again, until it was claimed too often (failed)."""
    last = events.groupBy("task").agg(F.max_by(F.struct("event", "worker", "ts"), "seq").alias("x"), F.count_if(F.col("event") == "claim").alias("claims"))
    late = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("x.ts") > lease_seconds
    event = F.col("x.event")
    state = F.when(event == "done", "done").when(event == "fail", "failed").when((event == "claim") & ~late, "claimed").when((event == "claim") & (F.col("claims") > most_reclaims), "failed").otherwise("open")
    return last.select("task", state.alias("state"), F.when(state == "claimed", F.col("x.worker")).alias("worker"), "claims")


def save_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Vertices and edges as saved (null: never saved)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")
    except AnalysisException:
        return None


def baseline_is_fresh(created, head: str, stash: str, n_changed: int, *, now, saved_head: str, saved_stash: str, saved_changed: int, ttl_seconds: int = 900, many: int = 10) -> bool:
    """Whether a saved state still holds: younger than the time to live, same head and stash, and the number of changed files hasn't crossed ``many``."""
    age = (now - created).total_seconds()
    return age <= ttl_seconds and head == saved_head and stash == saved_stash and not (saved_changed <= many < n_changed)


def tool_indicators(files: DataFrame) -> DataFrame:
    """path, tool: files that configure an assistant."""
    # Names of such files.
    marks = {".cursorrules": "cursor", ".github/copilot-instructions.md": "copilot", "CLAUDE.md": "claude", "AGENTS.md": "agents", ".aider.conf.yml": "aider", ".windsurfrules": "windsurf"}
    table = files.sparkSession.createDataFrame(list(marks.items()), "path string, tool string")
    return files.select("path").join(F.broadcast(table), "path")  # a fixed list


def timeline(runs: DataFrame, path: str) -> None:
    """commit, ts, score, n_findings, delta to the run before, as CSV in order of time."""
    w = Window.partitionBy("repo").orderBy("ts", "commit")
    runs.withColumn("delta", F.round(F.col("score") - F.lag("score").over(w), 6)).orderBy("repo", "ts", "commit").select("repo", "commit", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "score", "n_findings", "delta").write.mode("overwrite").csv(path, header=True)
