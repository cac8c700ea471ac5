"""Signals over parsed source: each takes tables and returns findings of one schema.

signal, score, file_path, symbol, line, detail. ``run`` unions the signals whose tables are there, in the order of their names.
Numbers in the conditions and scores are the signals' contract: fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import joins as J

SIGNALS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}


def signal(name: str, *needs: str):
    def wrap(fn):
        SIGNALS[name] = (needs, fn)
        return fn

    return wrap


def _found(df: DataFrame, name: str, score, path="path", symbol=None, line=None, detail=None) -> DataFrame:
    c = lambda x, kind: F.lit(None).cast(kind) if x is None else (F.col(x) if isinstance(x, str) else x).cast(kind)
    return df.select(F.lit(name).alias("signal"), F.round(c(score, "double"), 6).alias("score"), c(path, "string").alias("file_path"), c(symbol, "string").alias("symbol"), c(line, "int").alias("line"), c(detail, "string").alias("detail"))


def _folder(path: str):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


@signal("broad_exception_monoculture", "handlers")
def broad_exceptions(t: dict[str, DataFrame]) -> DataFrame:
    """Folders with three handlers or more that are broad by 0.8 and swallow by 0.6."""
    g = t["handlers"].groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).agg(F.count("*").alias("n"), F.avg(F.col("broad").cast("double")).alias("b"), F.avg(F.col("swallows").cast("double")).alias("s"))
    return _found(g.filter("n >= 3 and b >= 0.8 and s >= 0.6"), "broad_exception_monoculture", F.col("b") * F.col("s"), detail="n")


def duplicate_candidates(functions: DataFrame) -> DataFrame:
    """Functions of five lines and complexity 2 or more; no dunder names, tests, tutorials or forwarding ``__getattr__``."""
    f = functions.filter((F.col("end_line") - F.col("line") + 1 >= 5) & (F.col("complexity") >= 2))
    return f.filter(~F.col("name").rlike("^__.*__$") & ~X.is_test_path(F.col("path")) & ~F.col("path").rlike("(^|/)(tutorials?|examples?|docs_src)/"))


@signal("mutant_duplicate", "functions")
def duplicates(t: dict[str, DataFrame]) -> DataFrame:
    """Equal bodies of five lines and more (.9), and similar ones by shared 3-grams."""
    f = duplicate_candidates(t["functions"]).withColumn("key", F.concat_ws(":", "path", "name", "line"))
    same = f.groupBy("body_hash").agg(F.count("*").alias("n"), F.min(F.struct("path", "name", "line")).alias("x")).filter("n > 1").select("n", "x.*")
    rep = f.groupBy("body_hash").agg(F.min_by(F.struct("key", "path", "name", "line", "ngrams", "end_line"), "key").alias("x")).select("x.*")
    near = J.blocked_pairs(rep.withColumn("loc", F.col("end_line") - F.col("line")), "key", "loc", F.col("ngrams")).join(rep.select(F.col("key").alias("a"), "path", "name", "line"), "a")
    return _found(same, "mutant_duplicate", F.lit(0.9), symbol="name", line="line", detail=F.concat(F.lit("equal to "), F.col("n") - 1)).unionByName(_found(near, "mutant_duplicate", "similarity", symbol="name", line="line", detail=F.concat(F.lit("like "), F.col("b"))))


@signal("guard_clause_deficit", "functions")
def guards(t: dict[str, DataFrame]) -> DataFrame:
    """Folders with three public functions or more of two parameters and complexity 5 that are seldom guarded; unguarded functions nested deeper than four."""
    f = t["functions"].filter(~F.col("name").startswith("_") & (F.size("parameters") >= 2) & (F.col("complexity") >= 5)).withColumn("module", _folder("path"))
    g = f.groupBy("module").agg(F.count("*").alias("n"), F.avg(F.col("guarded").cast("double")).alias("r"), F.avg("complexity").alias("cx")).filter("n >= 3 and r < 0.15")
    deep = f.filter("not guarded and nesting > 4")
    few = _found(g, "guard_clause_deficit", F.least(F.lit(1.0), (1 - F.col("r")) * F.col("cx") / 20), path="module", detail="n")
    return few.unionByName(_found(deep, "guard_clause_deficit", F.least(F.lit(1.0), 0.3 + 0.15 * (F.col("nesting") - 4)), symbol="name", line="line"))


@signal("cognitive_complexity", "functions")
def complexity(t: dict[str, DataFrame]) -> DataFrame:
    return _found(t["functions"].filter("cognitive > 15"), "cognitive_complexity", F.least(F.lit(1.0), 0.3 + 0.04 * (F.col("cognitive") - 15)), symbol="name", line="line")


@signal("explainability_deficit", "functions")
def unexplained(t: dict[str, DataFrame]) -> DataFrame:
    """Complex functions with neither docstring nor return type, by how complex and long they are; private ones count .7."""
    given = F.when(F.col("has_docstring"), 1.0).otherwise(0.0) + F.when(F.col("returns").isNotNull(), 1.0).otherwise(0.0) + F.when(F.size("decorators") > 0, 0.5).otherwise(0.0)
    loc = F.col("end_line") - F.col("line") + 1
    score = (1 - given / 2.5) * F.least(F.lit(1.0), F.col("complexity") / 20) * (0.7 + 0.3 * F.least(F.lit(1.0), loc / 30)) * F.when(F.col("name").startswith("_"), 0.7).otherwise(1.0)
    return _found(t["functions"].withColumn("s", score).filter("s >= 0.3"), "explainability_deficit", "s", symbol="name", line="line")


@signal("fan_out_explosion", "imports")
def fan_out(t: dict[str, DataFrame]) -> DataFrame:
    g = t["imports"].groupBy("path").agg(F.countDistinct(F.split("module", r"\.")[0], "level").alias("n")).filter("n > 15")
    return _found(g, "fan_out_explosion", F.least(F.lit(1.0), 0.3 + 0.035 * (F.col("n") - 15)), detail="n")


@signal("dead_code_accumulation", "functions", "imports")
def dead_code(t: dict[str, DataFrame]) -> DataFrame:
    """Files with two public functions or more that no file imports by name."""
    used = t["imports"].select(F.explode("names").alias("name")).distinct().withColumn("used", F.lit(True))
    f = t["functions"].filter(~F.col("name").startswith("_")).join(used, "name", "left")
    g = f.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("used").isNull().cast("long")).alias("dead")).filter("dead >= 2")
    return _found(g, "dead_code_accumulation", F.least(F.lit(1.0), 0.8 * F.col("dead") / F.col("n") + 0.02 * F.col("dead")), detail="dead")


@signal("circular_import", "imports", "files")
def circular(t: dict[str, DataFrame]) -> DataFrame:
    """A row a cycle of Python files (tests left out): for each import on a cycle a shortest one, each set of files once."""
    from ..operators.graph import edge_cycles

    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".")
    names = t["files"].filter("language = 'python'").filter(~X.is_test_path(F.col("path"))).select("path", module.alias("module"))
    mine = t["imports"].join(names.select("path"), "path", "left_semi")
    c = edge_cycles(mine.join(names.withColumnRenamed("path", "dst"), "module").select(F.col("path").alias("src"), "dst"))
    return _found(c, "circular_import", F.round(F.least(F.lit(1.0), 0.3 + 0.1 * F.size("path")), 3), path=F.col("path")[0], detail=F.array_join(F.concat("path", F.slice("path", 1, 1)), " -> "))


# Kinds of markers and what a line with one holds.
MARKERS = (
    ("type_safety", r"#\s*type:\s*ignore"),
    ("lint", r"#\s*noqa\b"),
    ("coverage", r"#\s*pragma:\s*no\s*cover"),
    ("type_safety", r"\bcast\s*\("),
    ("test", r"pytest\.mark\.skip"),
    ("deferred", r"#\s*(?:TODO|FIXME|HACK|XXX)\b"),
    ("type_safety", r"//\s*@ts-ignore\b"),
    ("type_safety", r"//\s*@ts-expect-error\b"),
    ("type_safety", r"//\s*@ts-nocheck\b"),
    ("type_safety", r"\bas\s+any\b"),
    ("lint", r"//\s*eslint-disable"),
)
DENSE, LEAST_LINES = 0.05, 50


@signal("bypass_accumulation", "files", "functions")
def bypasses(t: dict[str, DataFrame]) -> DataFrame:
    """Files of fifty lines or more, tests left out, with a marker on every twentieth line; a function whose return type is open counts as one. The detail has the
    count, how it divides among kinds, and the median density of all files with a marker."""
    f = t["files"].filter("language in ('python', 'typescript', 'javascript')").filter(~X.is_test_path(F.col("path")))
    f = f.withColumn("lines", F.split("content", "\n")).filter(F.size("lines") >= LEAST_LINES)
    kinds = list(dict.fromkeys(k for k, _ in MARKERS))
    of = lambda kind: sum((F.size(F.filter("lines", lambda x: x.rlike(p))) for k, p in MARKERS if k == kind), F.lit(0))  # noqa: B023, E731
    f = f.select("path", F.size("lines").alias("loc"), *(of(k).alias(k) for k in kinds))
    open_ = t["functions"].filter(F.col("returns").rlike(r"\b[Aa]ny\b")).groupBy("path").agg(F.count("*").alias("open"))
    f = f.join(open_, "path", "left").withColumn("type_safety", F.col("type_safety") + F.coalesce("open", F.lit(0)))
    f = f.withColumn("n", sum((F.col(k) for k in kinds), F.lit(0))).filter("n > 0").withColumn("density", F.col("n") / F.col("loc"))
    median = F.broadcast(f.agg(F.median("density").alias("median")))  # one number
    each = F.concat_ws(", ", *(F.when(F.col(k) > 0, F.concat(F.lit(f"{k} "), F.col(k))) for k in sorted(kinds)))
    g = f.filter(F.col("density") >= DENSE).crossJoin(median)
    return _found(g, "bypass_accumulation", F.least(F.lit(1.0), F.col("density") / DENSE), line=F.lit(1), detail=F.concat(F.col("n"), F.lit(" ("), each, F.lit("), median "), F.round("median", 4)))


# Libraries whose types ask for assertions, members whose assertion is usual there, kinds that weigh nothing, and the count that scores 1.
SDK_IMPORT = r"""from\s+["'](?:@?playwright(?:/test)?|playwright-core|discord\.js|@discordjs/[^"']+)["']"""
SDK_MEMBERS = ("on", "off", "once", "addlistener", "removelistener")
WEIGHTLESS = ("double_cast_sdk_guarded", "non_null_assertion_sdk")
BYPASSES = 5


@signal("type_safety_bypass", "files", "bypasses")
def type_bypasses(t: dict[str, DataFrame]) -> DataFrame:
    """TypeScript files, tests left out, by their ways around the type system: casts to any, double casts, non-null assertions, directives. With certain libraries, assertions on their event
    and locator calls and double casts that a check follows within ten lines weigh nothing."""
    f = t["files"].filter("language in ('typescript', 'javascript')").filter(~X.is_test_path(F.col("path"))).select("path", "content", F.col("content").rlike(SDK_IMPORT).alias("sdk"))
    b = t["bypasses"].join(f, "path").withColumn("lines", F.split("content", "\n")).withColumn("text", F.get("lines", F.col("line") - 1))
    usual = F.lower("before").isin(*(f".{m}" for m in SDK_MEMBERS)) | F.col("text").rlike(r"(?i)\.locator\s*\(.*!\s*\)")
    variable = F.regexp_extract("text", r"(?i)\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*.+\bas\s+unknown\s+as\b", 1)
    following = F.array_join(F.slice("lines", F.col("line") + 1, F.lit(10)), "\n")
    guard = F.concat(F.lit(r"(?i)if\s*\(\s*!\s*"), F.replace(variable, F.lit("$"), F.lit(r"\$")), F.lit(r"\._[A-Za-z_$][\w$]*\s*\)\s*\{[\s\S]*?\bthrow\b"))
    guarded = (variable != "") & F.regexp_like(following, guard)
    kind = F.when(F.col("sdk") & (F.col("kind") == "non_null_assertion") & usual, WEIGHTLESS[1]).when(F.col("sdk") & (F.col("kind") == "double_cast") & guarded, WEIGHTLESS[0]).otherwise(F.col("kind"))
    b = b.select("path", "line", kind.alias("kind"))
    k = b.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    g = k.groupBy("path").agg(F.sum(F.when(F.col("kind").isin(*WEIGHTLESS), 0).otherwise(F.col("n"))).alias("weight"), F.min("line").alias("line"), F.array_sort(F.collect_list(F.concat("kind", F.lit(" "), F.col("n")))).alias("kinds"))
    return _found(g.filter("weight > 0"), "type_safety_bypass", F.round(F.least(F.lit(1.0), F.col("weight") / BYPASSES), 3), line="line", detail=F.array_join("kinds", ", "))


@signal("hardcoded_secret", "files")
def secrets(t: dict[str, DataFrame]) -> DataFrame:
    from ..operators.retrieval import entropy
    from ..sources.records import lines

    at = lines(t["files"]).select("path", "line", F.regexp_extract("text", r"""([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["']([^"']+)["']""", 1).alias("name"), F.regexp_extract("text", r"""([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["']([^"']+)["']""", 2).alias("value")).filter("value <> ''")
    chars = at.select("path", "line", F.explode(F.split("value", "")).alias("c")).filter("c <> ''").groupBy("path", "line", "c").agg(F.count("*").alias("n"))
    j = at.join(entropy(chars, ["path", "line"], "n"), ["path", "line"])
    return _found(j.filter(X.secret_like(F.col("name"), F.col("value"), F.col("entropy"))), "hardcoded_secret", F.least(F.lit(1.0), 0.5 + F.col("entropy") / 10), symbol="name", line="line")


# Folders that hold others, folders that need no mention, folders of decisions, states in which a decision no longer counts.
CONTAINERS = ("src", "lib", "app", "pkg", "packages", "libs", "internal")
AUXILIARY = ("tests", "test", "scripts", "script", "benchmarks", "benchmark", "tools", "tool", "examples", "example", "samples", "sample", "demos", "demo", "fixtures", "docs", "doc", "artifacts", "work_artifacts")
DECISION_FOLDERS = ("adr", "adrs", "decisions", "architecture")
PAST = ("superseded", "deprecated", "rejected")


@signal("stale_docs", "files")
def stale_docs(t: dict[str, DataFrame]) -> DataFrame:
    """No README at the root (.4, where there is more than a file or two of packages); folders that the README (.3) or a decision that still counts (.4) names and that aren't there; folders of source at the root that the
    README doesn't name (.15). Folders are named in code spans or links, with a slash behind."""
    f = t["files"]
    root = f.filter(F.lower("path").isin("readme.md", "readme.rst", "readme.txt", "readme")).withColumn("order", F.lower("path") != "readme.md").orderBy("order", "path").limit(1)
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    state = F.lower(F.coalesce(F.nullif(F.regexp_extract("content", r"(?s)^---\s*\n.*?\nstatus:\s*(\S+)", 1), F.lit("")), F.regexp_extract("content", r"(?m)^##\s+Status\s*\n+\s*(\w+)", 1)))
    told = F.size(F.split("path", "/")) > 1
    decided = f.filter((F.lower("path").endswith(".md")) & told).filter(F.lower(folder).isin(*DECISION_FOLDERS) | (F.lower(folder).contains("adr") & (F.length(folder) <= 20))).filter(~state.isin(*PAST))
    both = root.select("path", "content", F.lit(0.3).alias("score")).unionByName(decided.select("path", "content", F.lit(0.4).alias("score")))
    plain = F.regexp_replace("content", r"\w+://\S+", " ")
    named = F.concat(F.regexp_extract_all(plain, F.lit(r"`\.?/?([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)/`"), F.lit(1)), F.regexp_extract_all(plain, F.lit(r"\]\(\.?/?([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)/\)"), F.lit(1)))
    refs = both.select("path", "score", F.explode(F.array_distinct(named)).alias("dir")).filter((F.length("dir") > 2) & ~F.col("dir").rlike(r"^v?[0-9.]+$"))
    up = f.select(F.split(F.lower("path"), "/").alias("p")).filter(F.size("p") > 1)
    dirs = up.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("there")).distinct()
    asked = refs.select("path", "score", "dir", F.explode(F.concat(F.array(F.lower("dir"), F.concat(F.lit("."), F.lower("dir"))), F.array(*(F.concat(F.lit(f"{c}/"), F.lower("dir")) for c in CONTAINERS)))).alias("there"))
    there = asked.join(dirs, "there", "left_semi").select("path", "dir").distinct()
    gone = _found(refs.join(there, ["path", "dir"], "left_anti"), "stale_docs", "score", detail="dir")
    code = f.filter("language in ('python', 'typescript', 'javascript')")
    tops = code.filter(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("top")).distinct().filter(~F.lower("top").isin(*AUXILIARY) & ~F.col("top").startswith("."))
    quiet = tops.crossJoin(F.broadcast(root.select(F.lower("content").alias("readme")))).filter(~F.col("readme").contains(F.lower("top")))  # one README
    unnamed = _found(quiet, "stale_docs", F.lit(0.15), path="top", detail=F.lit("not in the README"))
    sources = code.agg(F.count("*").alias("n"), F.bool_and(F.element_at(F.split("path", "/"), -1) == "__init__.py").alias("bare"))
    missing = sources.filter("n > 1 and not bare").join(root.agg(F.count("*").alias("readmes")).filter("readmes = 0"), F.lit(True))
    return gone.unionByName(unnamed).unionByName(_found(missing, "stale_docs", F.lit(0.4), path=F.lit(""), detail=F.lit("no README")))


def _snake(name: str):
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


#: Prefixes of names, what such a function has to do, and the score where it doesn't.
CONTRACTS = (("get_or_create_", "creates"), ("validate_", "rejects"), ("check_", "rejects"), ("ensure_", "raises"), ("is_", "boolean"), ("has_", "boolean"), ("try_", "tries"))


@signal("naming_contract_violation", "functions")
def naming(t: dict[str, DataFrame]) -> DataFrame:
    """Names that promise what the body doesn't do, in snake or camel case."""
    kept = F.coalesce(*(F.when(_snake(F.substring_index("name", ".", -1)).startswith(p), F.col(c)) for p, c in CONTRACTS))
    return _found(t["functions"].filter(~kept), "naming_contract_violation", F.lit(0.6), symbol="name", line="line")


@signal("test_polarity_deficit", "functions")
def polarity(t: dict[str, DataFrame]) -> DataFrame:
    """Folders of tests with five test functions and ten assertions or more, fewer than a tenth of which expect a failure; and, of test files, many functions that
    assert nothing."""
    f = t["functions"].filter(X.is_test_path(F.col("path")) & F.col("name").startswith("test")).withColumn("module", _folder("path"))
    g = f.groupBy("module").agg(F.count("*").alias("n"), F.sum("positive").alias("p"), F.sum("negative").alias("q"), F.sum((F.col("positive") + F.col("negative") == 0).cast("long")).alias("none"))
    r = F.col("q") / F.greatest(F.lit(1), F.col("p") + F.col("q"))
    few = _found(g.filter((F.col("n") >= 5) & (F.col("p") + F.col("q") >= 10) & (r < 0.1)), "test_polarity_deficit", F.round(F.least(F.lit(1.0), (1 - r) * F.least(F.lit(1.0), F.col("n") / 10)), 3), path="module", detail="n")
    z = F.col("none") / F.col("n")
    idle = _found(g.filter((F.col("none") >= 2) & (z >= 0.15)), "test_polarity_deficit", F.least(F.lit(1.0), 0.8 * z + 0.02 * F.col("none")), path="module", detail=F.concat(F.lit("without assertions: "), F.col("none")))
    return few.unionByName(idle)


@signal("insecure_default", "settings")
def insecure(t: dict[str, DataFrame]) -> DataFrame:
    return _found(t["settings"].filter(~X.is_test_path(F.col("path"))), "insecure_default", "score", symbol="name", line="line", detail="rule")


# Names of route decorators.
ROUTES = ("route", "api_view", "get", "post", "put", "patch", "delete", "options", "head", "websocket")
# What the name of an auth decorator contains.
AUTH_DECORATORS = ("auth", "authorize", "authenticated", "permission", "login_required", "requires", "jwt_required", "token_required")
# Parameters that say who is asking, without underscores and case, as whole names.
AUTH_PARAMETERS = ("currentuser", "authenticateduser", "authuser", "requestuser", "principal", "credentials", "token", "jwttoken", "jwtclaims", "userclaims")
# And as patterns.
AUTH_PARAMETER_PATTERNS = (
    "^(?:current|authenticated|request|auth)user(?:context|info|obj|object)?$",
    "^(?:jwt|access|id|bearer|auth)token(?:s|value|str|string)?$",
    "^(?:auth|user|principal)claims?$",
    "^credentials?$",
    "^principal$",
)
# What names of endpoints that hand out public keys contain.
PUBLIC_KEYS = ("publishable", "publishablekey", "publickey", "clientkey")
# Folders that serve a command line's own user, below one named cli.
LOCAL_SERVERS = ("serving", "serve")
#: Names and routes that are public by intent.
PUBLIC = ("health", "login", "logout", "register", "signup", "public", "webhook", "ping", "status", "callback", "openapi", "docs", "favicon", "robots")
_FRAMEWORKS = ("fastapi", "django", "rest_framework", "flask", "starlette", "sanic", "express", "fastify", "@nestjs", "koa", "hono")


def frameworks(imports: DataFrame) -> DataFrame:
    """path, framework: the first of the list that the file's imports name."""
    first = F.coalesce(*(F.when(F.lower("module").contains(x), F.struct(F.lit(k).alias("k"), F.lit("django" if x == "rest_framework" else x.lstrip("@")).alias("name"))) for k, x in enumerate(_FRAMEWORKS)))
    return imports.groupBy("path").agg(F.min(first).alias("f")).select("path", F.coalesce("f.name", F.lit("unknown")).alias("framework"))


@signal("missing_authorization", "functions", "imports")
def unauthorized(t: dict[str, DataFrame]) -> DataFrame:
    """Route handlers without an auth decorator or parameter, unless public by name or route, or in tests and tools. Of several routes of one
    endpoint, the most specific names it."""
    plain = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]", "")
    bare = lambda d: F.lower(F.substring_index(F.substring_index(F.trim(d), "(", 1), ".", -1))
    routed = lambda d: bare(d).isin(*ROUTES)
    contains = lambda c, words: F.lit(False) if not words else contains(c, words[1:]) | c.contains(words[0].replace("_", ""))
    known = lambda x: plain(x).isin(*AUTH_PARAMETERS) | plain(x).rlike("|".join(AUTH_PARAMETER_PATTERNS))
    f = t["functions"].filter(F.exists("decorators", routed) & ~F.exists("decorators", lambda d: contains(F.replace(bare(d), F.lit("_"), F.lit("")), AUTH_DECORATORS)) & ~F.exists("parameters", known))
    folders = F.split(F.lower("path"), "/")
    local = F.array_contains(folders, "cli") & F.arrays_overlap(folders, F.array(*map(F.lit, LOCAL_SERVERS)))
    f = f.filter(~X.is_test_path(F.col("path")) & ~local & ~F.col("path").rlike(r"(^|/)(devtools?|internal|scripts|examples?)/"))
    route = F.explode(F.filter("decorators", routed))
    f = f.select("path", "name", "line", "has_docstring", route.alias("d")).withColumn("route", F.regexp_extract("d", r"""['"]([^'"]*)['"]""", 1))
    name = F.replace(F.lower(F.substring_index("name", ".", -1)), F.lit("_"), F.lit(""))
    f = f.filter(~contains(name, PUBLIC) & ~contains(F.regexp_replace(F.lower("route"), "[_/-]", ""), PUBLIC))
    f = f.groupBy("path", "name", "line", "has_docstring").agg(F.max_by("route", F.struct(F.col("route").startswith("/"), F.length("route"), "route")).alias("route"))
    f = f.join(frameworks(t["imports"]), "path", "left")
    score = F.when(F.col("has_docstring") & contains(name, PUBLIC_KEYS), 0.35).otherwise(0.85)
    return _found(f, "missing_authorization", score, symbol="name", line="line", detail=F.concat_ws(" ", F.coalesce("framework", F.lit("unknown")), "route"))


@signal("phantom_reference", "parsed")
def phantoms(t: dict[str, DataFrame]) -> DataFrame:
    """Files that call names which they neither bind nor import (files that import everything of a module are left out)."""
    p = t["parsed"].filter("not names.open").select("path", F.array_except("names.called", "names.bound").alias("gone")).filter(F.size("gone") > 0)
    return _found(p, "phantom_reference", F.round(F.least(F.lit(1.0), 0.3 + 0.15 * F.size("gone")), 3), detail=F.array_join("gone", ","))


@signal("pattern_fragmentation", "handlers")
def fragments(t: dict[str, DataFrame]) -> DataFrame:
    """Folders whose handlers follow more than one pattern; the most common one is the canon."""
    variant = F.to_json(F.struct(F.array_sort("exceptions").alias("exceptions"), F.col("swallows").alias("swallows")))
    v = t["handlers"].groupBy(_folder("path").alias("module"), variant.alias("variant")).agg(F.count("*").alias("n"))
    g = v.groupBy("module").agg(F.count("*").alias("variants"), F.sum("n").alias("n"), F.max_by("variant", F.struct("n", "variant")).alias("canon")).filter("variants >= 2")
    return _found(g, "pattern_fragmentation", F.least(F.lit(1.0), (1 - 1 / F.col("variants")) * F.least(F.lit(1.5), 1 + 0.04 * F.greatest(F.col("n") - 2, F.lit(0)))), path="module", detail="canon")


def _tokens(name: str):
    return F.array_distinct(F.filter(F.split(_snake(name), "_+"), lambda x: x != ""))


@signal("cohesion_deficit", "functions", "files")
def cohesion(t: dict[str, DataFrame]) -> DataFrame:
    """Files of four functions or more whose names share no words. A function's best likeness is found by its words, not by all pairs."""
    f = t["functions"].filter(~X.is_test_path(F.col("path"))).select("path", "name", "line", _tokens("name").alias("w"))
    words = f.select("path", "name", "line", F.size("w").alias("n"), F.explode("w").alias("word"))
    other = words.select("path", F.col("name").alias("o_name"), F.col("line").alias("o_line"), F.col("n").alias("o_n"), "word")
    both = words.join(other, ["path", "word"]).filter("line <> o_line").groupBy("path", "name", "line", "n", "o_name", "o_line", "o_n").agg(F.count("*").alias("k"))
    best = both.groupBy("path", "line").agg(F.max(F.col("k") / (F.col("n") + F.col("o_n") - F.col("k"))).alias("best"))
    g = f.join(best, ["path", "line"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    first = F.col("w")[0]
    heads = f.groupBy("path", first.alias("head")).agg(F.count("*").alias("m")).groupBy("path").agg(F.max("m").alias("m"))
    g = g.groupBy("path").agg(F.count("*").alias("n"), F.avg((F.col("best") < 0.15).cast("double")).alias("alone"), F.avg("best").alias("mean")).filter("n >= 4").join(heads, "path")
    many = t["files"].agg((0.7 + 0.3 * F.least(F.lit(1.0), F.count("*") / 20)).alias("repo"))  # one number
    raw = (0.65 * F.col("alone") + 0.35 * (1 - F.col("mean"))) * F.least(F.lit(1.0), (F.col("n") - 2) / 4) * F.col("repo") * F.when(F.col("m") >= 0.6 * F.col("n"), 0.55).otherwise(1.0)
    g = g.crossJoin(F.broadcast(many)).withColumn("s", F.round(F.least(F.lit(0.79), raw), 3)).filter("s >= 0.35")
    return _found(g, "cohesion_deficit", "s", detail="n")


# Folders by layer; those that any layer may import have -1.
LAYERS = {0: ("api", "routes", "views", "handlers", "controllers", "scripts", "commands", "cli"), 1: ("services", "core", "domain", "use_cases"), 2: ("db", "repositories", "storage", "infrastructure"), -1: ("config", "settings", "constants", "types", "utils", "helpers", "common", "shared", "base", "exceptions", "errors", "enums", "schemas", "models")}


def layer(path: str):
    """The layer of the first folder that has one (null: none)."""
    known = F.create_map(*(F.lit(x) for k, names in LAYERS.items() for n in names for x in (n, k)))
    return F.get(F.filter(F.transform(F.split(F.lower(path), "/"), lambda x: known[x]), lambda x: x.isNotNull()), F.lit(0))


def file_edges(t: dict[str, DataFrame]) -> DataFrame:
    """src, dst, line: imports of files by files, of a module or of a name in a package, relative ones included. The first line of each."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".")
    names = t["files"].filter("language = 'python'").select(F.col("path").alias("dst"), module.alias("module"))
    up = F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - F.col("level"), F.lit(0))), ".")
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.when(up != "", up), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    asked = t["imports"].filter("top").select("path", "line", base.alias("base"), "names")
    told = asked.select("path", "line", F.explode(F.concat(F.array("base"), F.transform("names", lambda x: F.concat_ws(".", "base", x)))).alias("module"))
    return told.join(names, "module").filter("path <> dst").groupBy(F.col("path").alias("src"), "dst").agg(F.min("line").alias("line"))


def policy(spark, boundaries: tuple[tuple[str, str, tuple[str, ...]], ...] = (), lazy: tuple[tuple[str, str, tuple[str, ...], bool], ...] = ()) -> DataFrame:
    """The table ``policy`` of a configuration: boundaries (name, glob of files, denied globs of modules) and lazy imports (name, glob of files, modules, whether only imports at the top count)."""
    either = lambda globs: "|".join(X.glob_regex(g) for g in globs) or "^$"
    rows = [("boundary", n, X.glob_regex(f), either(deny), False) for n, f, deny in boundaries] + [("lazy", n, X.glob_regex(f), either([*modules, *(f"{m}.**" for m in modules)]), top) for n, f, modules, top in lazy]
    return spark.createDataFrame(rows, "kind string, name string, files string, modules string, top_only boolean")


def _policy_violations(t: dict[str, DataFrame]) -> DataFrame:
    """Imports that a boundary denies (.8), and heavy modules that are imported at the top where they shouldn't be (.75)."""
    rules = F.broadcast(t["policy"])  # a configuration
    slashed = F.replace("module", F.lit("."), F.lit("/"))
    told = t["imports"].join(rules, F.expr("path rlike files")).filter((F.col("kind") == "lazy") | F.rlike(slashed, F.col("modules")) | F.rlike("module", F.col("modules")))
    told = told.filter((F.col("kind") == "boundary") | (F.rlike("module", F.col("modules")) & (~F.col("top_only") | F.col("top"))))
    return _found(told, "architecture_violation", F.when(F.col("kind") == "boundary", 0.8).otherwise(0.75), line="line", detail=F.concat(F.when(F.col("kind") == "boundary", "denied by ").otherwise("lazy by "), "name", F.lit(": "), "module"))


def _churn(t: dict[str, DataFrame]) -> DataFrame | None:
    """path, churn: changes a week, where histories are there."""
    return t["histories"].select("path", (F.col("commits_30d") / 30 * 7).alias("churn")) if "histories" in t else None


def _with_churn(d: DataFrame, t: dict[str, DataFrame], path: str) -> DataFrame:
    churn = _churn(t)
    return d.withColumn("churn", F.lit(0.0)) if churn is None else d.join(churn.withColumnRenamed("path", path), path, "left").withColumn("churn", F.coalesce("churn", F.lit(0.0)))


def _blast_radius(t: dict[str, DataFrame], e: DataFrame) -> DataFrame:
    """Files that twice the mean of all files (five at least) depend on, through others too; if they change little, more than fifty."""
    from ..operators import graph as G

    n = t["files"].filter("language = 'python'").agg(F.count("*").alias("n"))
    d = G.cut(G.dependents(e))
    least = d.agg(F.sum("n_dependents").alias("all")).crossJoin(F.broadcast(n)).select("n", F.greatest(F.lit(5.0), 2 * F.col("all") / F.col("n")).alias("least"))  # one row
    far = _with_churn(d.crossJoin(F.broadcast(least)), t, "node").filter("n_dependents >= least and (churn > 1 or n_dependents > 50)")
    return _found(far, "architecture_violation", F.least(F.lit(1.0), F.round(F.col("n_dependents") / F.col("n") * 0.8, 2)), path="node", detail=F.concat(F.lit("blast radius "), "n_dependents"))


# Bases of abstract classes.
ABSTRACT = ("ABC", "ABCMeta", "Protocol", "Interface")


def _painful(t: dict[str, DataFrame], degrees: DataFrame) -> DataFrame:
    """Concrete and stable files that three others or more import: far from the line on which what is depended upon is abstract. Small ones with little coupling stay below .5; files without functions don't count."""
    of = t["classes"].groupBy("path").agg(F.count("*").alias("classes"), F.sum(F.exists("bases", lambda b: F.substring_index(b, ".", -1).isin(*ABSTRACT)).cast("int")).alias("abstract"))
    fn = t["functions"].groupBy("path").agg(F.count("*").alias("functions"))
    size = t["files"].select("path", "line_count").join(fn, "path").join(of, "path", "left").fillna(0, ["classes", "abstract"])
    d = degrees.withColumnRenamed("node", "path").join(size, "path").withColumn("i", F.col("ce") / (F.col("ca") + F.col("ce")))
    d = d.withColumn("distance", F.abs(F.when(F.col("classes") > 0, F.col("abstract") / F.col("classes")).otherwise(0.0) + F.col("i") - 1)).filter("distance >= 0.7 and i <= 0.5 and ca >= 3")
    tiny = (F.col("line_count") <= 20) & (F.col("classes") + F.col("functions") <= 2) & (F.col("ce") <= 1) & (F.col("ca") < 6)
    score = F.least(F.lit(1.0), F.round(F.col("distance") * 0.7, 2))
    return _found(d, "architecture_violation", F.when(tiny, F.least(score, F.lit(0.49))).otherwise(score), detail=F.lit("zone of pain"))


def _unstable(t: dict[str, DataFrame], e: DataFrame, degrees: DataFrame) -> DataFrame:
    """Stable files (two importers, instability .4 at most) that import an unstable one (.7, or a change a week); not within one extension."""
    i = degrees.select("node", "ca", (F.col("ce") / (F.col("ca") + F.col("ce"))).alias("i"))
    own = lambda c: F.regexp_extract(c, r"(?:^|/)extensions/([^/]+)/", 1)
    j = e.join(i.toDF("src", "src_ca", "src_i"), "src").join(i.toDF("dst", "dst_ca", "dst_i"), "dst").filter("src_ca >= 2 and src_i <= 0.4").filter((own("src") == "") | (own("src") != own("dst")))
    j = _with_churn(j, t, "dst").filter("dst_i >= 0.7 or churn >= 1")
    return _found(j, "architecture_violation", F.least(F.lit(1.0), F.round(F.col("dst_i") * 0.6 + F.least("churn", F.lit(2.0)) * 0.2, 2)), path="src", line="line", detail=F.concat(F.lit("unstable dependency "), "dst"))


def _hidden(t: dict[str, DataFrame], e: DataFrame) -> DataFrame:
    """Of the ten pairs that change together most those without an import either way and of different folders."""
    known = t["changes"].join(t["files"].select("path"), "path", "left_semi").select("hash", "path").distinct()
    c = known.join(known.groupBy("hash").agg(F.count("*").alias("n")).filter("n between 2 and 20"), "hash")
    own = c.groupBy("path").agg(F.count("*").alias("own"))
    pairs = c.select("hash", F.col("path").alias("a")).join(c.select("hash", F.col("path").alias("b")), "hash").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k")).filter("k >= 2").orderBy(F.desc("k"), "a", "b").limit(10)
    linked = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = pairs.join(linked, ["a", "b"], "left_anti").filter((_folder("a") != _folder("b")) | (_folder("a") == "")).join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    s = F.least(F.lit(1.0), F.round(F.round(F.col("k") / F.least("x", "y"), 3) * 0.7, 2))
    return _found(pairs.withColumn("s", s).filter("s >= 0.2"), "architecture_violation", "s", path="a", detail=F.concat(F.lit("changes with "), "b"))


@signal("architecture_violation", "imports", "files", "classes", "functions")
def violations(t: dict[str, DataFrame]) -> DataFrame:
    """Imports from a lower layer into a higher one (half as bad if many import the target), import cycles (of these the five largest), files that depend on much
    and have much depending on them, files that much depends on through others, concrete and stable files that many import, stable files that import unstable ones; with ``policy`` also denied and eager imports,
    with ``changes`` (hash, path) pairs that change together without an import, with ``histories`` how much files change."""
    from ..operators import graph as G

    e = G.cut(file_edges(t))
    hub = G.hubs(e).select(F.col("node").alias("dst"), F.lit(0.5).alias("damp"))
    up = e.withColumn("a", layer("src")).withColumn("b", layer("dst")).filter("a > b and b >= 0").join(hub, "dst", "left")
    rise = _found(up, "architecture_violation", 0.5 * F.coalesce("damp", F.lit(1.0)), path="src", line="line", detail=F.concat(F.lit("imports upward "), F.col("dst")))
    cycles = G.strong_components(e).groupBy("component").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "component").limit(5)
    d = G.cut(G.degrees(e))
    mean = d.agg(F.greatest(F.lit(6), F.floor(2 * F.avg(F.col("ca") + F.col("ce")))).alias("least"))  # one number
    god = d.crossJoin(F.broadcast(mean)).filter("ca + ce >= least and ca >= 2 and ce >= 2")
    parts = [rise, _found(cycles, "architecture_violation", F.lit(0.6), path="component", detail=F.concat(F.lit("cycle of "), F.col("size"))), _found(god, "architecture_violation", F.lit(0.5), path="node", detail=F.lit("depends on much and much on it")), _blast_radius(t, e)]
    # With fewer than four files, how files depend on each other says little.
    many = F.broadcast(t["files"].agg((F.count("*") >= 4).alias("many")))
    parts += [x.crossJoin(many).filter("many").drop("many") for x in (_painful(t, d), _unstable(t, e, d))]
    parts += [_policy_violations(t)] if "policy" in t else []
    parts += [_hidden(t, e)] if "changes" in t else []
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@signal("co_change_coupling", "commits", "changes", "imports", "files")
def coupled(t: dict[str, DataFrame]) -> DataFrame:
    """Pairs of files that change together without an import between them, nor parallel implementations or a package in common. The ten strongest.
    ``commits``: hash, is_merge, is_automated; ``changes``: hash, path. Commits of more than twenty files say nothing."""
    weight = F.when(F.col("is_merge"), 0.35).otherwise(1.0) * F.when(F.col("is_automated"), 0.5).otherwise(1.0)
    known = t["changes"].join(t["files"].select("path"), "path", "left_semi").select("hash", "path").distinct()
    sized = known.groupBy("hash").agg(F.count("*").alias("n")).filter("n between 2 and 20").join(t["commits"].select("hash", weight.alias("w")), "hash")
    c = known.join(sized, "hash")
    alone = known.join(t["commits"].select("hash", weight.alias("w")), "hash").groupBy("path").agg(F.sum("w").alias("own"))
    pairs = c.select("hash", "w", F.col("path").alias("a")).join(c.select("hash", F.col("path").alias("b")), "hash").filter("a < b").groupBy("a", "b").agg(F.sum("w").alias("both")).filter("both >= 2.5")
    e = file_edges(t).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    stem = lambda x: F.regexp_extract(x, r"([^/]+)\.[a-z]+$", 1)
    pairs = pairs.join(e, ["a", "b"], "left_anti").filter((stem("a") != stem("b")) & ((_folder("a") != _folder("b")) | (_folder("a") == "")))
    pairs = pairs.join(alone.toDF("a", "x"), "a").join(alone.toDF("b", "y"), "b").withColumn("sure", F.col("both") / F.least("x", "y")).filter("sure >= 0.45")
    s = F.round(F.least(F.lit(0.79), 0.55 * F.col("sure") + 0.45 * F.least(F.lit(1.0), F.col("both") / 8)), 3)
    return _found(pairs.withColumn("s", s).filter("s >= 0.2").orderBy(F.desc("s"), "a", "b").limit(10), "co_change_coupling", "s", path="a", detail="b")


@signal("temporal_volatility", "histories")
def volatile(t: dict[str, DataFrame]) -> DataFrame:
    """Files far above the mean in commits of 30 days, authors or fixes. ``histories``: path, commits_30d, authors, fixes, tool_share."""
    h = t["histories"]
    stats = h.agg(*(x for c in ("commits_30d", "authors", "fixes") for x in (F.avg(c).alias(f"m_{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"d_{c}"))))  # one row
    z = {c: F.when(F.col(f"d_{c}") < 0.001, 0.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")))) for c in ("commits_30d", "authors", "fixes")}
    h = h.crossJoin(F.broadcast(stats)).withColumn("top", F.greatest(*z.values())).withColumn("mean", sum(z.values(), F.lit(0.0)) / 3)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") / 3)) * F.when(F.col("tool_share") > 0.3, 1.3).otherwise(1.0)
    return _found(h.withColumn("s", F.least(F.lit(1.0), s)).filter("top >= 1.5 and s >= 0.2"), "temporal_volatility", "s")


@signal("system_misalignment", "imports", "first_commits")
def misaligned(t: dict[str, DataFrame]) -> DataFrame:
    """Packages that only recent files of a folder import. ``first_commits``: path, recent. Without a tenth of established files there is no finding."""
    f = t["imports"].filter("level = 0").join(t["first_commits"], "path").select(_folder("path").alias("module"), F.split("module", r"\.")[0].alias("package"), "recent")
    old = t["first_commits"].agg((F.avg((~F.col("recent")).cast("double")) >= 0.1).alias("enough"))  # one number
    g = f.groupBy("module", "package").agg(F.bool_and("recent").alias("novel")).filter("novel").groupBy("module").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))
    return _found(g.crossJoin(F.broadcast(old)).filter("enough"), "system_misalignment", F.least(F.lit(1.0), 0.25 * F.col("n")), path="module", detail="packages")


@signal("exception_contract_divergence", "functions", "functions_before")
def diverged(t: dict[str, DataFrame]) -> DataFrame:
    """Folders with functions that raise other exceptions than they did, at equal parameters."""
    side = lambda x, n: t[x].filter(~F.col("name").startswith("_")).groupBy("path", "name").agg(F.min_by(F.struct(F.size("parameters").alias("p"), "exceptions"), "line").alias(n))
    j = side("functions", "now").join(side("functions_before", "then"), ["path", "name"]).filter("now.p = then.p").withColumn("changed", F.col("now.exceptions") != F.col("then.exceptions"))
    g = j.groupBy(_folder("path").alias("module")).agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("long")).alias("k")).filter("k > 0")
    return _found(g, "exception_contract_divergence", F.round(F.least(F.lit(1.0), 2 * F.col("k") / F.col("n")), 3), path="module", detail="k")


@signal("ts_architecture", "files")
def ts_architecture(t: dict[str, DataFrame]) -> DataFrame:
    """Cycles among TypeScript files, and imports across packages (folders under ``packages``) or up the layers; user interface never imports infrastructure."""
    from ..operators import graph as G
    from ..sources.typescript import import_graph

    e = G.cut(import_graph(t["files"]))
    package = lambda c: F.regexp_extract(c, r"(?:^|/)packages/([^/]+)/", 1)
    cycles = G.strong_components(e).groupBy("component").agg(F.max("size").alias("size"))
    out = _found(cycles, "ts_architecture", F.least(F.lit(1.0), 0.3 + 0.1 * F.col("size")), path="component", detail=F.concat(F.lit("cycle of "), F.col("size")))
    cross = e.filter((package("src") != "") & (package("dst") != "") & (package("src") != package("dst")))
    out = out.unionByName(_found(cross, "ts_architecture", F.lit(0.6), path="src", detail=F.concat(F.lit("other package: "), F.col("dst"))))
    up = e.withColumn("a", layer("src")).withColumn("b", layer("dst")).filter("a > b and b >= 0")
    out = out.unionByName(_found(up, "ts_architecture", F.lit(0.7), path="src", detail=F.concat(F.lit("layer: "), F.col("dst"))))
    ban = e.filter(F.col("src").rlike(r"(^|/)(ui|components|views)/") & F.col("dst").rlike(r"(^|/)(infra|infrastructure|db)/"))
    return out.unionByName(_found(ban, "ts_architecture", F.lit(0.8), path="src", detail=F.concat(F.lit("infrastructure: "), F.col("dst"))))


def tables(source: DataFrame, parts: tuple[str, ...] | None = None, fields: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The tables of a file tree; each file is parsed once. ``parts`` and ``fields``: what is worked out of each Python file and function, where not all is read. Functions and classes are those of Python and TypeScript; classes there are types of kind ``class``."""
    from ..operators.graph import cut
    from ..sources.records import flat, parse_python
    from ..sources.typescript import declarations

    parsed = cut(parse_python(source.filter("language = 'python'"), *(None if x is None else frozenset(x) for x in (parts, fields))))
    typed = cut(declarations(source))
    out = {"files": source, "parsed": parsed, "types": flat(typed, "types"), "bypasses": flat(typed, "bypasses")} | {k: flat(parsed, k) for k in ("functions", "classes", "imports", "handlers", "settings")}
    functions = out["functions"]
    out["functions"] = functions.unionByName(flat(typed, "functions").select(*functions.columns))
    out["classes"] = out["classes"].unionByName(out["types"].filter("kind = 'class'").select(*out["classes"].columns))
    return out


def runnable(there: set[str]) -> dict[str, str | None]:
    """Signals with the reason why one can't run (null: it can)."""
    return {n: (None if set(needs) <= there else "needs " + ", ".join(sorted(set(needs) - there))) for n, (needs, _) in SIGNALS.items()}


def run(t: dict[str, DataFrame], only: set[str] | None = None) -> DataFrame:
    out = None
    for n, why in sorted(runnable(set(t)).items()):
        if why is None and (only is None or n in only):
            f = SIGNALS[n][1](t)
            out = f if out is None else out.unionByName(f)
    return out
