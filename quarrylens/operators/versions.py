"""Two versions of a file tree: only files whose content changed are analysed again, and findings that the earlier version had are told from new ones in stages."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .graph import cut


def file_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, state: added, removed, modified (another SHA-256) or same."""
    h = lambda d, name: d.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias(name))
    j = h(before, "old").join(h(after, "new"), "path", "full")
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("same").alias("state"))


class Versions(NamedTuple):
    states: DataFrame
    before: DataFrame
    after: DataFrame
    parsed: DataFrame


def analyse_versions(before: DataFrame, after: DataFrame, analyse: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> Versions:
    """The findings of both versions by an analysis whose findings of a file follow from that file alone. Of the later version only added and modified files are analysed; the findings of the others are carried
    over. ``known``: the earlier version's findings, where they are saved; then nothing of it is analysed. ``parsed``: version, files (how many were analysed)."""
    states = cut(file_states(before, after))
    old = cut(analyse(before)) if known is None else known
    touched = states.filter("state in ('added', 'modified')").select("path")
    fresh = cut(analyse(after.join(touched, "path", "left_semi")))
    stay = states.filter("state = 'same'").select(F.col("path").alias("file_path"))
    later = old.join(stay, "file_path", "left_semi").select(*fresh.columns).unionByName(fresh)
    first = before.agg(F.count("*").alias("files")) if known is None else before.sparkSession.range(1).select(F.lit(0).cast("long").alias("files"))
    parsed = first.select(F.lit("before").alias("version"), "files").unionByName(touched.agg(F.count("*").alias("files")).select(F.lit("after").alias("version"), "files"))
    return Versions(states, old, later, parsed)


def fingerprinted(findings: DataFrame, title: str = "title") -> DataFrame:
    """Adds fp1 (by lines), fp2 (by symbol and stable title) and fuzzy (by stable title alone)."""
    c = lambda name: F.col(name) if name in findings.columns else F.lit(None)
    stable = X.stable_title(F.coalesce(F.col(title), F.lit("")))
    start, end = F.coalesce(c("start_line"), c("line"), F.lit(0)), F.coalesce(c("end_line"), F.lit(0))
    return findings.withColumns({"fp1": X.fingerprint(F.col("signal"), F.col("file_path"), start, end, F.col(title)), "fp2": X.fingerprint(F.col("signal"), F.col("file_path"), c("symbol"), stable), "fuzzy": X.fingerprint(F.col("signal"), F.col("file_path"), stable)})


def told_apart(new: DataFrame, head: DataFrame, title: str = "title", fuzzy: bool = True) -> DataFrame:
    """The rows of ``new`` with ``known_by``: exact, lines or title (the first stage that finds the row in ``head``), or null for one that is new."""
    out, stages = fingerprinted(new, title), {"fp2": "exact", "fp1": "lines"} | ({"fuzzy": "title"} if fuzzy else {})
    there = fingerprinted(head, title)
    for key in stages:
        out = out.join(there.select(key, F.lit(True).alias(f"in_{key}")).distinct(), key, "left")
    known = F.coalesce(*(F.when(F.col(f"in_{key}"), name) for key, name in stages.items()))
    return out.withColumn("known_by", known).select(*new.columns, "known_by")


def new_findings(new: DataFrame, head: DataFrame, title: str = "title", fuzzy: bool = True) -> DataFrame:
    return told_apart(new, head, title, fuzzy).filter("known_by is null").drop("known_by")


def before_and_after(versions: Versions, title: str = "title") -> DataFrame:
    """One row: findings and mean score before and after, how many are new and how many are resolved (neither side knows the other's)."""
    count = lambda d, name: d.agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias(f"score_{name}"))
    new = new_findings(versions.after, versions.before, title).agg(F.count("*").alias("n_new"))
    gone = new_findings(versions.before, versions.after, title).agg(F.count("*").alias("n_resolved"))
    out = count(versions.before, "before")
    for one in (count(versions.after, "after"), new, gone):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out
