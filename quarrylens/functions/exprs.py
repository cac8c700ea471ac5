"""Column builders: pure expressions that stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ladders of severity and grade (lower bounds), by falling score.
SEVERITY_BOUNDS = ((0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low"), (0.0, "info"))
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
GRADE_BOUNDS = ((0.8, "F"), (0.6, "D"), (0.4, "C"), (0.2, "B"))
# Literals that begin a known credential.
SECRET_PREFIXES = ("sk-", "ghp_", "AKIA", "xox")


def severity(score: Column) -> Column:
    out = F.lit("info")
    for bound, name in reversed(SEVERITY_BOUNDS[:-1]):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(len(SEVERITY_RANK))
    for k, v in SEVERITY_RANK.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("A")
    for bound, name in reversed(GRADE_BOUNDS):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def name_tokens(name: Column, min_length: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case parts of a camelCase or snake_case name, sorted."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    parts = F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda x: (F.length(x) >= min_length) & ~x.isin(*stop) if stop else F.length(x) >= min_length)
    return F.array_sort(F.array_distinct(parts))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Set Jaccard of two arrays; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_ngrams(tokens: Column, n: int = 3) -> Column:
    """Sliding n-grams, space-joined; empty below n tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case runs of [A-Za-z0-9_]; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def stable_title(title: Column) -> Column:
    """Mask what changes from run to run: digits, and parenthesised references."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)", ""), "[0-9]+", "N"))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def truncate_words(text: Column, limit: int) -> Column:
    """Cut at the last space within the limit."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut), F.lit("...")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, clipped to [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole and part days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000


def parse_time(raw: Column) -> Column:
    """ISO time with an optional trailing Z; null if empty or malformed."""
    return F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: ** crosses folders, * and ? don't."""
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    return "^" + "".join(rules.get(p, re.escape(p)) for p in parts) + "$"


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[jt]sx?$")


def generated(content: Column, lines: int = 5) -> Column:
    """A marker of generated files in the first lines."""
    head = F.lower(F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n"))
    return head.contains("generated by") | head.contains("do not edit") | head.contains("@generated")


def secret_like(name: Column, value: Column, entropy: Column, least_entropy: float = 3.5, least_length: int = 16) -> Column:
    """A known credential prefix, or a secret-like name with a long value of high entropy per character; calls and plain URLs are safe."""
    bare = F.regexp_replace(value, "^(Bearer|token) ", "")
    known = F.lit(False)
    for p in SECRET_PREFIXES:
        known = known | bare.startswith(p)
    named = F.lower(name).rlike("(secret|token|passw|api_?key|credential)")
    safe = bare.rlike(r"(getenv|environ|config)[.(\[]|^https?://[^@]*$|^\{\{|^\$\{")
    return ~safe & (known | (named & (F.length(bare) >= least_length) & (entropy >= least_entropy)))


def module_of(path: Column) -> Column:
    """The dotted module of a file: without ending, ``__init__`` and a leading ``src``."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "^src/", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def relative_module(path: Column, level: Column, module: Column) -> Column:
    """The dotted module that an import with ``level`` dots means in a file."""
    parts = F.split(path, "/")
    up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)))
    return F.array_join(F.concat(up, F.array(module)), ".")


def parallel_pair(a: str, b: str) -> Column:
    """Whether two files are parallel implementations: of one folder or one name."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[a-z]+$", 1)
    return (folder(a) == folder(b)) | (stem(a) == stem(b))


#: Columns by response profile.
PROFILES = {"planner": ("signal", "severity", "module"), "coder": ("signal", "severity", "file_path", "start_line", "end_line", "title"), "verifier": ("signal", "severity", "score", "file_path"), "merge_readiness": ("signal", "severity", "score")}


def profile(findings: DataFrame, name: str | None) -> DataFrame:
    """Only the columns of a profile that are there (all without one)."""
    return findings.select(*(c for c in PROFILES[name] if c in findings.columns)) if name else findings
