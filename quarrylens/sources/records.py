"""Sources of repository records: file trees, line directives, JSON logs, parsed Python, version-control logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import glob_regex, is_test_path, parse_time
from .batches import by_bytes

# Languages by file extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "md": "markdown"}


def files(spark: SparkSession, folder: str, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), language, size_bytes, line_count, content. The listing and the reads are Spark's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = re.escape(folder.split("://")[-1].rstrip("/"))
    f = raw.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^.*?{top}/", "").alias("path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))
    f = f.filter(F.col("path").rlike("|".join(map(glob_regex, include))))
    if exclude:
        f = f.filter(~F.col("path").rlike("|".join(map(glob_regex, exclude))))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))]
    return f.select("path", language.alias("language"), "size_bytes", F.size(F.split("content", "\n")).alias("line_count"), "content")


# Folders that hold nobody's own tests.
FOREIGN = (".git", "node_modules", "venv", ".venv", ".tox", ".nox", "dist", "build", "site-packages", ".pixi")


def left_out_tests(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The Python tests of a tree whose scan leaves tests out: a second scan, under the patterns that don't speak of tests. Same columns as ``files``."""
    kept = tuple(p for p in exclude if "tests" not in p.replace("\\", "/").lower())
    found = files(spark, folder, include=("**/*.py",), exclude=kept)
    return found.filter(is_test_path(F.col("path")) & ~F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, FOREIGN))))


def lines(source: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return source.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def suppressions(source: DataFrame, mark: str = "quarry:ignore") -> DataFrame:
    """Directives ``# <mark>[A,B] until:2024-01-31 reason:...``: path, line, signals (null: all), until, reason."""
    found = lines(source).filter(F.col("text").contains(mark))
    m = re.escape(mark)
    names = F.regexp_extract("text", m + r"\[([^\]]*)\]", 1)
    until = F.regexp_extract("text", r"until:([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    reason = F.regexp_extract("text", r"reason:(.*)$", 1)
    return found.select("path", "line", F.when(names != "", F.split(names, r"\s*,\s*")).alias("signals"), F.try_to_date(until, "yyyy-MM-dd").alias("until"), F.when(F.trim(reason) != "", F.trim(reason)).alias("reason"))


def context_tags(source: DataFrame, mark: str = "quarry:context") -> DataFrame:
    """Comments ``# <mark> a, b``: path, line, tags."""
    raw = F.regexp_extract("text", re.escape(mark) + r"\s+([A-Za-z0-9_, -]+)", 1)
    return lines(source).filter(F.col("text").contains(mark)).select("path", "line", F.array_sort(F.array_distinct(F.split(F.trim(raw), r"\s*,\s*"))).alias("tags"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log under a schema; lines that don't parse are left out."""
    row = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).filter(F.trim("value") != "").select(row.alias("r")).select("r.*").filter("_bad is null").drop("_bad")


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """signal, file_path, verdict, source, ts (null if malformed)."""
    return json_log(spark, path, "signal string, file_path string, verdict string, source string, ts string").withColumn("ts", parse_time(F.col("ts")))


_FUNCTION = "array<struct<name:string,line:int,end_line:int,complexity:int,parameters:array<string>,decorators:array<string>,has_docstring:boolean,returns:string,nesting:int,body_hash:string,ngrams:array<string>,cognitive:int,raises:boolean,rejects:boolean,creates:boolean,boolean:boolean,tries:boolean,guarded:boolean,exceptions:array<string>,positive:int,negative:int>>"
_PARSED = f"path string, functions {_FUNCTION}, classes array<struct<name:string,line:int,bases:array<string>>>, imports array<struct<module:string,names:array<string>,line:int,level:int,top:boolean>>, handlers array<struct<line:int,exceptions:array<string>,broad:boolean,swallows:boolean>>, settings array<struct<rule:string,name:string,score:double,line:int>>, names struct<called:array<string>,bound:array<string>,open:boolean>, error string"


def parse_python(source: DataFrame, parts: frozenset[str] | None = None, fields: frozenset[str] | None = None) -> DataFrame:
    """One row a file with its functions, classes, imports and handlers; a file that doesn't parse has ``error``. ``parts`` of a file and ``fields`` of functions: all, or those that are worked out."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_PARSED))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .python_ast import FIELDS, PARTS, describe

        asked = PARTS if parts is None else parts, FIELDS if fields is None else fields
        for batch in by_bytes(batches, "content"):
            rows = [{"path": p, **describe(c or "", *asked)} for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    # Parsing costs far more than a shuffle of the texts, so files are dealt out evenly; a number of partitions that is given isn't merged by AQE.
    dealt = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return source.select("path", "content").repartition(dealt, "path").mapInArrow(parse, _PARSED)


def flat(parsed: DataFrame, what: str) -> DataFrame:
    """The nested rows of one kind, with their file."""
    return parsed.select("path", F.explode(what).alias("x")).select("path", "x.*")


_COMMIT = "hash string, author string, email string, ts timestamp, message string"


def commits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``value`` rows of a log with records that begin with 0x1E and fields hash, author, email, ISO time, subject
    split by 0x1F, then lines of numstat: commits and their files (hash, path, insertions, deletions)."""
    r = raw.select(F.explode(F.split("value", "\x1e")).alias("r")).filter(F.length(F.trim("r")) > 0)
    head, body = F.split(F.split("r", "\n")[0], "\x1f"), F.slice(F.split("r", "\n"), 2, 1 << 30)
    c = r.select(head[0].alias("hash"), head[1].alias("author"), head[2].alias("email"), parse_time(head[3]).alias("ts"), head[4].alias("message"), body.alias("body")).dropDuplicates(["hash"])
    stat = c.select("hash", F.explode("body").alias("l")).filter(F.col("l").rlike(r"^[0-9-]+\t[0-9-]+\t"))
    part = F.split("l", "\t")
    return c.drop("body"), stat.select("hash", part[2].alias("path"), part[0].try_cast("int").alias("insertions"), part[1].try_cast("int").alias("deletions"))
