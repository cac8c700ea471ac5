"""Quality rules learned as a decision list over text statistics.

Statistics of every whole text are counted in array operations inside the tasks, without a shuffle. A
bounded sample of labelled rows (``SAMPLE_ROWS``, in hash order of the id, so the same rows each time)
goes to the driver, where sequential covering learns rules for bad texts: a rule grows by the threshold
condition of greatest information gain on two thirds of the rows, is pruned from its end on the last
third, is kept if it is precise there, and takes the rows it covers away; the bad texts of one that isn't are set aside. The list becomes one Spark
conditional expression, which decides all rows.

Defined cases: null and empty texts have no words and fail the base rule. Shares with an empty
denominator are 0. Repeated rows are judged alike. Without usable labels the list is empty and the base
rule decides alone. Labels that repeat an id count as several rows. Of equal gains the first feature and the
least threshold win, of equal worth the shorter rule. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, bounded_sample, kept, mix, shared_folder, slices, table, tokenise, tuned, windows

SAMPLE_ROWS = 20_000
MAX_CONDITIONS, CUTS = 4, 48
LEAST_PRECISION, LEAST_COVER = 0.97, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:'\"()[]{}-_=+~^/\\@`")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks", "longest_word")


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics in ``COUNTS``, one value a text."""
    t = tokenise(texts, PLAIN, lower=False)
    n = len(t.offsets) - 1
    counts = t.counts()

    def of_bytes(which: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(which)))
        return total[t.offsets[1:]] - total[t.offsets[:-1]]

    starts_char = (t.data & 0xC0) != 0x80
    distinct = np.unique(mix(t.hash ^ mix(t.row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    h, at = windows(t.hash, t.row, 3)
    cover = np.zeros(len(t.hash) + 1, np.int64)
    if len(at):
        _, back, times = np.unique(mix(h ^ mix(t.row[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 3, -1)
    repeated = np.bincount(t.row[np.cumsum(cover[:-1]) > 0], minlength=n)
    lines = tokenise(texts, _LINE, lower=False)
    first_word = np.searchsorted(t.start, lines.start)
    full = np.flatnonzero((first_word < len(t.start)) & (t.start[np.minimum(first_word, max(len(t.start) - 1, 0))] < lines.end)) if len(t.start) else np.zeros(0, np.int64)
    n_lines = np.bincount(lines.row[full], minlength=n)
    one = np.unique(mix(lines.hash[full] ^ mix(lines.row[full].astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    chars = np.concatenate(([0], np.cumsum(starts_char)))
    size = chars[t.end] - chars[t.start]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, t.row, size)
    return {
        "n_words": counts, "word_chars": np.bincount(t.row, size, n).astype(np.int64), "n_symbols": of_bytes(_SYMBOL[t.data]), "n_dup_lines": n_lines - np.bincount(lines.row[full][one], minlength=n),
        "n_repeat_words": repeated, "n_distinct": np.bincount(t.row[distinct], minlength=n), "n_lines": n_lines, "n_upper": of_bytes(_UPPER[t.data]), "n_digits": of_bytes(_DIGIT[t.data]), "n_marks": of_bytes(_MARK[t.data]), "longest_word": longest,
    }


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of ``COUNTS``, a row a document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                got = text_counts(piece.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id")} | {c: pa.array(got[c], pa.int64()) for c in COUNTS})

    kind = dict(docs.dtypes)[key]
    tuned(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What conditions may ask for, by a readable name. Variety is the log of distinct words over the log of words,
    since a plain share of distinct words falls with the length of any text."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "variety": F.when(F.col("n_words") > 1, F.log(F.col("n_distinct")) / F.log(F.col("n_words"))).otherwise(1.0), "words_per_line": share("n_words", "n_lines"), "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "marks_per_word": share("n_marks", "n_words"), "longest_word": F.col("longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, at_least, threshold) hold: the text is bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, named: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, cut in self.conditions:
            out = out & (named[name] >= cut if at_least else named[name] < cut)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, cut in self.conditions:
            out &= x[name] >= cut if at_least else x[name] < cut
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if g else '<'} {c:.6g}" for n, g, c in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    own, chosen = np.ones(len(bad), bool), []
    while len(chosen) < MAX_CONDITIONS and (own & ~bad).any():
        p, n = (own & bad).sum(), (own & ~bad).sum()
        best = (1e-9, None)
        for name, values in x.items():
            v, b = values[own], bad[own]
            at = np.searchsorted(np.sort(cuts[name]), v, side="right")
            pos, neg = np.bincount(at[b], minlength=len(cuts[name]) + 1), np.bincount(at[~b], minlength=len(cuts[name]) + 1)
            under_p, under_n = np.cumsum(pos)[:-1], np.cumsum(neg)[:-1]
            for at_least, pp, nn in ((False, under_p, under_n), (True, p - under_p, n - under_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), -1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (name, at_least, float(cuts[name][gain.argmax()])))
        if best[1] is None:
            break
        chosen.append(best[1])
        own &= Rule((best[1],)).holds(x)
    return Rule(tuple(chosen))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Sequential covering: grow on folds 0 and 1, prune on fold 2, until too few bad rows are left or no rule can be grown for them. Each round takes rows away or sets some aside, so
    their number bounds the rounds."""
    rules: list[Rule] = []
    left, aside = np.ones(len(bad), bool), np.zeros(len(bad), bool)
    while True:
        grow, prune = left & ~aside & (fold < 2), left & (fold == 2)
        if (grow & bad).sum() < LEAST_COVER:
            break
        part = {k: v[grow] for k, v in x.items()}
        # Cuts lie where the bad texts lie: quantiles of theirs and of all.
        cuts = {k: np.unique(np.quantile(np.concatenate((v, v[bad[grow]])), np.linspace(0, 1, CUTS + 1)[1:])) for k, v in part.items()}
        rule = _grow(part, bad[grow], cuts)
        if not rule.conditions:
            break
        test = {k: v[prune] for k, v in x.items()}

        def worth(r: Rule) -> tuple[float, float]:
            own = r.holds(test)
            p, n = (own & bad[prune]).sum(), (own & ~bad[prune]).sum()
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=worth)
        own = rule.holds(x) & left
        good = own & (fold == 2)
        if own.sum() < LEAST_COVER or (own & bad).sum() < LEAST_PRECISION * own.sum() or (good & bad).sum() < LEAST_PRECISION * good.sum():
            # Not precise enough: the bad texts that it was grown for are set aside, and others are tried.
            if not (own & grow & bad).any():
                break
            aside |= own & bad
            continue
        rules.append(rule)
        left &= ~own
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` rows of ``stats`` that ``labels`` (doc_id, quality) marks."""
    named = features()
    labelled = stats.join(labels.filter("quality is not null").select("doc_id", "quality"), "doc_id").select(*(c.alias(n) for n, c in named.items()), F.col("quality"), F.xxhash64("doc_id").alias("draw"))
    rows = bounded_sample(labelled, "draw", sample_rows, "quality", "words")
    if not len(rows) or rows.quality.nunique() < 2:
        return []
    x = {n: rows[n].to_numpy(float) for n in named}
    return learn(x, rows.quality.to_numpy() == 0, (rows.draw.to_numpy().astype(np.uint64) >> np.uint64(17)).astype(np.int64) % 3)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: index of the first rule that holds, null if none does."""
    named = features()
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, r in enumerate(rules):
        out = out.when(r.column(named), F.lit(k))
    return out.otherwise(F.lit(None).cast("int"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = kept(statistics(table(spark, sf_dir, "documents")), shared_folder(spark, "rules"), "stats")
    rules = learn_rules(stats, table(spark, sf_dir, "labels"))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
