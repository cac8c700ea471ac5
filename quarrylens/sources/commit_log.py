"""Commit logs as a batch or a stream of records, and the index that they are kept in.

A log is text in which each commit begins with 0x1E: ``git log --numstat --format=%x1e%H%x1f%P%x1f%aN%x1f%aE%x1f%aI%x1f%B%x1f``. Spark's text source cuts files there, so a large log is read by
many tasks, and a stream's offsets are Spark's.

The index is a folder of generations; one generation holds the commits by month. A manifest names the newest generation and the head it stands for. A log whose commits include that head
adds what is new; any other (a rebase, another branch) is written as a new generation, which counts only once its manifest is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import glob_regex

# Names of tools that a co-author line may hold.
COAUTHORS = ("copilot", "cursor", "codeium", "tabnine", "ghostwriter", "ai assistant", "github-actions", "anthropic", "openai", "windsurf", "devin", "aider", "cline", "sourcegraph", "amazon-q", "gemini", "claude", "copilot-workspace")
# And addresses.
COAUTHOR_EMAILS = ("copilot@users.noreply.github.com", "noreply@cursor.sh", "noreply@codeium.com")
# First lines that tools write, specific and generic; the conventional form; words of defects.
SPECIFIC = (
    r"(?i)^(Implement|Refactor|Create) \w+ \w+ \w+",
    r"(?i)^(Add|Implement|Create) \w+ \w+ (functionality|feature|support|handling|endpoint|module)\b",
    r"(?i)^aider: ",
)
GENERIC = r"(?i)^(Add|Update|Fix|Remove) \w+ \w+"
CONVENTIONAL = r"(?i)^(feat|fix|chore|refactor|test|docs|style|build|ci|perf|revert)(\(.+?\))?: .+"
DEFECTS = r"(?i)\b(fix|bug|hotfix|revert|patch|regression|broken|crash|error)\b"
# Files and folders (ending in a slash) that configure a tool.
TOOL_FILES = {
    ".claude/": "claude",
    "CLAUDE.md": "claude",
    "AGENTS.md": "agents",
    ".claudeignore": "claude",
    ".copilotignore": "copilot",
    ".github/copilot-instructions.md": "copilot",
    ".cursor/": "cursor",
    ".cursorignore": "cursor",
    ".cursorrules": "cursor",
    ".aider/": "aider",
    ".aider.conf.yml": "aider",
    ".cline/": "cline",
    "cline_docs/": "cline",
    ".windsurf/": "windsurf",
    ".codeium/": "codeium",
    ".amazon-q/": "amazon-q",
    ".continue/": "continue",
}
# What none, one, two and more of these tools add to the confidence.
BOOSTS = (0.0, 0.1, 0.15, 0.2)

SCHEMA = "hash string, parents array<string>, author string, email string, ts timestamp, message string, files array<struct<path:string,insertions:int,deletions:int>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\x1e")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path, lineSep="\x1e")


def parse_log(raw: DataFrame, *, since: Column | None = None, prefix: str = "", include: tuple[str, ...] = ()) -> DataFrame:
    """hash, parents, author, email, ts, message, files (path, insertions, deletions) of each record of ``value``; records without a hash of ten characters or a time are left out.

    ``since``: commits before it go. ``prefix``: a folder of the repository; paths lose it, files elsewhere go (the commit stays). ``include``: globs; a commit without such a file goes, and one that has one keeps
    all its files.
    """
    part = F.split("value", "\x1f")
    stat = F.transform(F.filter(F.split(F.get(part, F.lit(6)), "\n"), lambda x: x.rlike(r"^([0-9]+|-)\t([0-9]+|-)\t.")), lambda x: F.split(x, "\t", 3))
    files = F.transform(stat, lambda s: F.struct(F.trim(s[2]).alias("path"), F.coalesce(s[0].try_cast("int"), F.lit(0)).alias("insertions"), F.coalesce(s[1].try_cast("int"), F.lit(0)).alias("deletions")))
    if prefix:
        folder = prefix.rstrip("/") + "/"
        files = F.transform(F.filter(files, lambda f: f["path"].startswith(folder)), lambda f: f.withField("path", F.substr(f["path"], F.lit(len(folder) + 1))))
    parents = F.filter(F.split(F.trim(F.get(part, F.lit(1))), " "), lambda x: x != "")
    c = raw.filter(F.size(part) >= 7).select(F.trim(F.get(part, F.lit(0))).alias("hash"), parents.alias("parents"), F.coalesce(F.nullif(F.trim(F.get(part, F.lit(2))), F.lit("")), F.lit("unknown")).alias("author"), F.trim(F.get(part, F.lit(3))).alias("email"), F.try_to_timestamp(F.trim(F.get(part, F.lit(4)))).alias("ts"), F.trim(F.get(part, F.lit(5)), F.lit(" \n\t\r")).alias("message"), files.alias("files"))
    c = c.filter((F.length("hash") >= 10) & F.col("ts").isNotNull())
    if since is not None:
        c = c.filter(F.col("ts") >= since)
    if include:
        wanted = "|".join(map(glob_regex, include))
        c = c.filter(F.exists("files", lambda f: f["path"].rlike(wanted)))
    return c


def changed_files(commits: DataFrame) -> DataFrame:
    return commits.select("hash", "ts", F.explode("files").alias("f")).select("hash", "ts", "f.*")


def tool_boost(files: DataFrame) -> DataFrame:
    """One row: tools (sorted, those that a file of the tree configures) and boost."""
    hit = F.coalesce(*(F.when(F.col("path").startswith(k) if k.endswith("/") else F.col("path") == k, tool) for k, tool in TOOL_FILES.items()))
    t = files.select(hit.alias("tool")).agg(F.array_sort(F.collect_set("tool")).alias("tools"))  # as many as there are tools
    return t.select("tools", F.element_at(F.array(*map(F.lit, BOOSTS)), F.least(F.size("tools"), F.lit(len(BOOSTS) - 1)) + 1).alias("boost"))


def attribution(message: Column, boost: float | Column = 0.0) -> tuple[Column, Column]:
    """Whether a tool wrote a commit, and how sure that is: a co-author line 0.95, a specific or (where tools are configured) conventional first line 0.4, a generic one 0.15 (and no), plus the boost. Messages with a body
    count by their co-authors only."""
    boost = F.lit(boost) if isinstance(boost, float) else boost
    first = F.trim(F.substring_index(message, "\n", 1))
    short = lambda n: (F.length(first) < n) & ~message.contains("\n")
    co = F.transform(F.regexp_extract_all(message, F.lit(r"(?im)^(co-authored-by:.*)$"), F.lit(1)), F.lower)
    tool = F.lit(False)
    for mark in (*COAUTHORS, *COAUTHOR_EMAILS):
        tool = tool | F.exists(co, lambda x: x.contains(mark))  # noqa: B023
    sure = lambda base: F.round(F.least(F.lit(base) + boost, F.lit(0.95)), 2)
    specific = F.lit(False)
    for p in SPECIFIC:
        specific = specific | first.rlike(p)
    usual = (boost > 0) & first.rlike(CONVENTIONAL) & ~message.contains("\n")
    generic = first.rlike(GENERIC) & short(50)
    is_tool = F.coalesce(tool | (specific & short(72)) | usual, F.lit(False))
    return is_tool, F.when(tool, 0.95).when((specific & short(72)) | usual, sure(0.4)).when(generic, sure(0.15)).otherwise(0.0)


def classified(commits: DataFrame, boost: float | Column = 0.0, least: float = 0.5) -> DataFrame:
    """Adds is_merge (two parents), is_defect, by_tool (confidence of ``least`` or more) and confidence."""
    _, sure = attribution(F.col("message"), boost)
    return commits.withColumns({"is_merge": F.size("parents") > 1, "is_defect": F.col("message").rlike(DEFECTS), "confidence": sure}).withColumn("by_tool", F.col("confidence") >= least)


# --- the index ---------------------------------------------------------------------------------


def _manifest(spark: SparkSession, folder: str) -> tuple[int, int, str] | None:
    """Number of the newest manifest, its generation and head."""
    try:
        rows = spark.read.schema("number int, generation int, head string").json(f"{folder}/manifest").orderBy(F.desc("number")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tuple(rows[0]) if rows else None


def _stored(spark: SparkSession, folder: str, generation: int) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, month string").parquet(f"{folder}/generation={generation}")


def update_index(commits: DataFrame, head: str, folder: str) -> str:
    """Brings the index up to ``head``, whose log ``commits`` is; what was done: created, current, appended or rebuilt. Appended are hashes that their month doesn't hold yet, so a run that broke off and
    comes again adds nothing twice."""
    spark = commits.sparkSession
    known = _manifest(spark, folder)
    if known is not None and known[2] == head:
        return "current"
    c = commits.dropDuplicates(["hash"]).withColumn("month", F.date_format("ts", "yyyy-MM"))
    follows = known is not None and not commits.filter(F.col("hash") == known[2]).isEmpty()
    generation = 0 if known is None else known[1] if follows else known[1] + 1
    place = f"{folder}/generation={generation}"
    if follows:
        c.join(_stored(spark, folder, generation).select("month", "hash"), ["month", "hash"], "left_anti").write.mode("append").partitionBy("month").parquet(place)
    else:
        c.write.mode("overwrite").partitionBy("month").parquet(place)
    number = 0 if known is None else known[0] + 1
    spark.range(1).select(F.lit(number).alias("number"), F.lit(generation).alias("generation"), F.lit(head).alias("head")).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return "created" if known is None else "appended" if follows else "rebuilt"


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of new commits: the head becomes the batch's latest commit. A batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["hash"]).withColumn("month", F.date_format("ts", "yyyy-MM")).persist()
        try:
            last = batch.orderBy(F.desc("ts"), "hash").select("hash").first()
            if last is None:
                return
            known = _manifest(spark, folder)
            generation = 0 if known is None else known[1]
            fresh = batch if known is None else batch.join(_stored(spark, folder, generation).select("month", "hash"), ["month", "hash"], "left_anti")
            fresh.write.mode("append" if known else "overwrite").partitionBy("month").parquet(f"{folder}/generation={generation}")
            spark.range(1).select(F.lit(0 if known is None else known[0] + 1).alias("number"), F.lit(generation).alias("generation"), F.lit(last.hash).alias("head")).coalesce(1).write.mode("append").json(f"{folder}/manifest")
        finally:
            batch.unpersist()

    return write


def indexed(spark: SparkSession, folder: str, since: Column | None = None) -> DataFrame:
    """The commits of the newest generation. With ``since``, only the months that it touches are read."""
    known = _manifest(spark, folder)
    if known is None:
        return spark.createDataFrame([], SCHEMA)
    c = _stored(spark, folder, known[1])
    if since is not None:
        c = c.filter((F.col("month") >= F.date_format(since, "yyyy-MM")) & (F.col("ts") >= since))
    return c.drop("month")
