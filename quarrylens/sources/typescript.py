"""TypeScript and JavaScript: imports by patterns, declarations from tokens and brackets (no grammar is installed)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes

# What an import may leave out, in the order in which it is tried.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "")
_FROM = r"(?m)^[ \t]*((?:import|export)\b[^'\";]*?\bfrom\s*['\"][^'\"]+['\"]|import\s*['\"][^'\"]+['\"])"


def scripts(files: DataFrame) -> DataFrame:
    return files.filter("language in ('typescript', 'javascript')")


def imports(files: DataFrame) -> DataFrame:
    """path, module, names, level (0), line, top (true), reexport: one row an import or re-export."""
    found = scripts(files).select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(_FROM), F.lit(1))).alias("raw"))
    names = F.regexp_replace(F.regexp_extract("raw", r"^(?:import|export)\s+(?:type\s+)?(.*?)\s*\bfrom\b", 1), r"[{}\s]+", " ")
    line = F.size(F.split(F.expr("substring_index(content, raw, 1)"), "\n"))
    return found.select("path", F.regexp_extract("raw", r"['\"]([^'\"]+)['\"]$", 1).alias("module"), F.filter(F.transform(F.split(names, ","), lambda x: F.trim(F.substring_index(x, " as ", 1))), lambda x: x != "").alias("names"), F.lit(0).alias("level"), line.alias("line"), F.lit(True).alias("top"), F.col("raw").startswith("export").alias("reexport"))


def parsed_imports(files: DataFrame, python: DataFrame) -> DataFrame:
    """Imports of all languages: Python's from its parser, the others by patterns."""
    return python.select("path", "module", "names", "level", "line", "top").unionByName(imports(files).drop("reexport"))


def _normal(path):
    """A path without ``.`` and with each ``..`` taking a folder away."""
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, x: F.when((x == ".") | (x == ""), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(kept, "/")


def import_graph(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """src, dst: relative imports, then those by an alias (a prefix for a folder, from a configuration), each resolved to the first ending that is a
    file, and through one re-export of a name from an index file."""
    i = imports(files)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    place = F.when(F.col("module").startswith("."), F.concat_ws("/", folder, "module"))
    for prefix, to in sorted((aliases or {}).items(), key=lambda x: -len(x[0])):
        place = place.when(F.col("module").startswith(prefix), F.concat(F.lit(to), F.substring("module", len(prefix) + 1, 1 << 30)))
    asked = i.withColumn("place", _normal(place)).filter("place is not null")
    tried = asked.select("path", "names", "reexport", "place", F.posexplode(F.array(*(F.concat("place", F.lit(x)) for x in ENDINGS))).alias("k", "dst"))
    there = scripts(files).select(F.col("path").alias("dst"))
    first = tried.join(there, "dst").groupBy("path", "names", "reexport", "place").agg(F.min_by("dst", "k").alias("dst"))
    through = first.filter("reexport").select(F.col("path").alias("barrel"), F.explode("names").alias("name"), F.col("dst").alias("far"))
    wide = first.select(F.col("path").alias("src"), "dst", F.explode_outer("names").alias("asked")).join(through, F.expr("dst = barrel and asked = name"), "left")
    return wide.select("src", F.coalesce("far", "dst").alias("dst")).filter("src <> dst").distinct()


#: JSON with comments and trailing commas, as configurations are written.
_COMMENT, _TRAILING = r"""("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/""", r""",(\s*[}\]])"""


def _plain_json(content):
    return F.regexp_replace(F.regexp_replace(content, _COMMENT, "$1"), _TRAILING, "$1")


def aliases(files: DataFrame) -> dict[str, str]:
    """Prefixes that the root's tsconfig.json gives to folders (``paths`` under ``baseUrl``, the first target of each), for ``import_graph``. Without such a file there are none."""
    row = F.from_json(_plain_json("content"), "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    c = files.filter("path = 'tsconfig.json'").select(row.alias("r")).select("r.compilerOptions.*").first()  # one file
    if c is None or not c.paths:
        return {}
    base = (c.baseUrl or ".").strip("./")
    place = lambda to: "/".join(x for x in (base, to.removesuffix("*").removeprefix("./").strip("/")) if x) + ("/" if to.endswith("*") else "")
    return {k.removesuffix("*"): place(v[0]) for k, v in c.paths.items() if v}


def workspaces(files: DataFrame) -> DataFrame:
    """folder, package: the folders with a package.json that the globs of the root's ``workspaces`` (a list, or a list under ``packages``) name, by the name that it gives or else by the folder."""
    manifest = files.filter("path = 'package.json' or path like '%/package.json'").select(F.regexp_replace("path", "/?package\\.json$", "").alias("folder"), _plain_json("content").alias("json"))
    root = manifest.filter("folder = ''").select(F.coalesce(F.from_json(F.get_json_object("json", "$.workspaces.packages"), "array<string>"), F.from_json(F.get_json_object("json", "$.workspaces"), "array<string>")).alias("globs"))
    glob = F.regexp_replace(F.regexp_replace("g", r"^\./|/$", ""), r"([.+()\[\]{}^$])", r"\\$1")
    globs = root.select(F.explode("globs").alias("g")).select(glob.alias("g")).select(F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("g", r"\*\*/?", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*"), F.lit("$")).alias("g"))  # a configuration
    held = manifest.filter("folder <> ''").join(F.broadcast(globs), F.expr("folder rlike g"), "left_semi")
    return held.select("folder", F.coalesce(F.nullif(F.get_json_object("json", "$.name"), F.lit("")), F.element_at(F.split("folder", "/"), -1)).alias("package"))


def packages_of_files(files: DataFrame) -> DataFrame:
    """path, package: of each script the package of the nearest workspace folder above it (null: in none)."""
    s = scripts(files).select("path", F.split("path", "/").alias("p"))
    up = s.filter(F.size("p") > 1).select("path", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p").select("path", "n", F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("folder"))
    near = up.join(workspaces(files), "folder").groupBy("path").agg(F.max_by("package", "n").alias("package"))
    return s.select("path").join(near, "path", "left")


_FUNCTION = (
    "name string, line int, end_line int, complexity int, parameters array<string>, decorators array<string>, has_docstring boolean, returns string, nesting int, body_hash string, ngrams array<string>, cognitive int, raises boolean, rejects boolean, creates boolean, boolean boolean, "
    "tries boolean, guarded boolean, exceptions array<string>, positive int, negative int, exported boolean, is_async boolean, any_types int"
)
_TYPE = "name string, kind string, line int, end_line int, bases array<string>, members array<string>, exported boolean, has_docstring boolean, decorators array<string>"
DECLARED = f"path string, functions array<struct<{_FUNCTION.replace(' ', ':').replace(',:', ',')}>>, types array<struct<{_TYPE.replace(' ', ':').replace(',:', ',')}>>, bypasses array<struct<kind:string,line:int,before:string>>, error string"


def declarations(files: DataFrame) -> DataFrame:
    """One row a file: its functions (declarations, methods as ``Class.name``, arrows given to a name), types (classes, interfaces, aliases), ways around the type system, and
    ``error`` if its brackets don't match. A null content declares nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DECLARED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .typescript_tokens import describe

        for batch in by_bytes(batches, "content"):
            rows = [{"path": p, **describe(c or "", (p or "").endswith(("x", "js")))} for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scripts(files).select("path", "content").mapInArrow(read, DECLARED)
