"""Toxic passages by maximum-scoring segments over token log-odds.

Lexicon. Over the labelled training texts, each distinct text once, Spark counts in how many toxic and clean texts each word,
and each four-letter stem, occurs, and how often in clean ones. A word's toxic share has a Dirichlet prior (two
categories) centred on its stem's share, and a stem's on the global share; its score is the log-odds against the global
share. Of all words and stems, those enter whose toxic share is significantly high: the binomial tail (Chernoff's
bound) under Benjamini and Hochberg's procedure over every tested word, at the false discovery rate ``FALSE_SHARE``, so
that chance words stay out however many words the corpus has. Words that are significantly not as toxic as such a stem override
it. Tasks write the lexicon, whole, as sorted arrays by range of the hash into the shared folder, and scoring tasks map these
into memory, so nothing of it passes through the driver.

Segments. In a text a word scores its own log-odds, else its stem's, else the ordinary word's score, log((1-Q)/(1-P)): P is
the measured share of lexicon tokens among the tokens of clean texts, Q the sum of p exp(s) over the entries, their share where
each is as much more frequent as its odds say. So the sum of p exp(s) over all tokens is 1: Karlin and Altschul's lambda is 1 and the
mean score of clean text is below 0, by construction (``background`` asserts it). A linear scan (Ruzzo and Tompa's) yields all maximal
segments, disjoint.

Calibration. A segment of score S in a text of n words has the expectation E = K n exp(-S) in clean text; K is the maximum
likelihood of the extreme-value law over the best segments of clean training texts. A segment is significant where E is at most
``E_VALUE``; a text's evidence is the sum of -log E over its significant segments, 0 without any. A logistic curve over it,
fitted to histograms of all labelled training rows, gives the probability.

Defined cases: null and empty texts have no segment and the score of no evidence. Without labels of both
kinds the score is the share of toxic ones (0 without any). Rows of ``labels`` that repeat a document count as several
when the curve is fitted; a text with contrary labels is toxic to the lexicon if at least half say so. Repeated documents are scored alike. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, kept, mapped, remainder, shared_folder, slices, store, table, tokenise, tuned

HELD_OUT = (5, 0)
STEM = 4
PRIOR = 4.0
#: Of the entries, at most this share is expected to be there by chance.
FALSE_SHARE = 0.01
#: Entries of a file of the lexicon, about.
BUCKET_ENTRIES = 500_000
#: Lexicon tokens are at most this share of a toxic passage.
MOST_DENSE = 0.5
E_VALUE = 1.0
#: Bins of the histograms of evidence and of -log p.
BIN, LEVELS = 0.25, 1200


def maximal_segments(at: list[int], score: list[float], ordinary: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the end, score) of a sequence that scores ``ordinary`` (below 0) but at the given places."""
    # Each candidate: first, past, sum before it, sum up to its end, and the place of the last one before it that has a lesser sum before it. The way left goes along
    # those places, so none is passed twice; where it ends, all candidates so far are final and leave the list.
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for p, s in zip(at, score, strict=True):
        total += ordinary * (p - last)
        last = p + 1
        if s <= 0:
            total += s
            continue
        first, before = p, total
        total += s
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k = found[k][4]
            if k < 0:
                done += [(x[0], x[1], x[3] - x[2]) for x in found]
                found = [(first, p + 1, before, total, -1)]
                break
            if found[k][3] >= total:
                found.append((first, p + 1, before, total, k))
                break
            # One segment from that candidate on; the search goes on from the candidate that it was linked to.
            first, before = found[k][0], found[k][2]
            link = found[k][4]
            del found[k:]
            k = link
    return done + [(x[0], x[1], x[3] - x[2]) for x in found]


@dataclass
class Lexicon:
    """Where the arrays of keys and scores are: words in ``1``, stems in ``0``, a file a bucket. No folder: empty."""

    folder: str | None = None
    buckets: int = 1
    written: frozenset[int] = frozenset()
    ordinary: float = -0.02
    shift: float = 0.0
    k: float = 1.0

    def scores(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        out = np.full(len(word), np.nan)
        if self.folder is None or not len(word):
            return out
        for kind, own in ((0, stem), (1, word)):
            distinct, back = np.unique(own, return_inverse=True)
            found = np.full(len(distinct), np.nan)
            cuts = np.searchsorted(_bucket(distinct, self.buckets), np.arange(self.buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                if int(b) not in self.written:
                    continue
                keys, values = mapped(f"{self.folder}/{kind}/{b:05d}")
                if len(keys):
                    part = distinct[cuts[b] : cuts[b + 1]]
                    at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                    found[cuts[b] : cuts[b + 1]] = np.where(keys[at] == part, values[at], np.nan)
            out = np.where(np.isnan(found[back]), out, found[back])
        return out + self.shift


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The high bits of a hash choose its file."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def stored(wanted: DataFrame, folder: str) -> Lexicon:
    """Write all entries (kind, key, s) as sorted arrays. Tasks do it, a bucket each."""
    buckets = max(1, -(-wanted.count() // BUCKET_ENTRIES))

    def write(entries: pa.Table) -> pa.Table:
        keys, kind = np.asarray(entries.column("key")).view(np.uint64), np.asarray(entries.column("kind"))
        s, b = np.asarray(entries.column("s")), entries.column("bucket")[0].as_py()
        for k in (0, 1):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(keys[own])]
            store(f"{folder}/lexicon/{k}/{b:05d}", [keys[own], s[own]])
        return pa.table({"bucket": pa.array([b], pa.int64())})

    bucket = F.shiftright(F.shiftrightunsigned("key", 32) * buckets, 32)
    done = wanted.select(bucket.alias("bucket"), "kind", "key", "s").groupBy("bucket").applyInArrow(write, "bucket long").collect()  # a number a file
    return Lexicon(f"{folder}/lexicon", buckets, frozenset(r.bucket for r in done))


def count_tokens(labelled: DataFrame) -> DataFrame:
    """``labelled``: text, toxic. Rows: key, its stem (null for a stem itself), toxic and clean texts with it, tokens in clean texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                t = tokenise(piece.column("text"), ALNUM)
                toxic = np.asarray(piece.column("toxic")) > 0
                stem = t.prefix(STEM)
                for key, parent in ((t.hash, stem), (stem, None)):
                    keys, at, code, tokens = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    pair = np.unique(code * np.int64(len(toxic)) + t.row)
                    own, bad = pair // max(len(toxic), 1), toxic[pair % max(len(toxic), 1)]
                    pos, n = np.bincount(own, bad, len(keys)).astype(np.int64), np.bincount(own, minlength=len(keys))
                    clean = tokens - np.bincount(code, toxic[t.row], len(keys)).astype(np.int64)
                    up = pa.nulls(len(keys), pa.int64()) if parent is None else pa.array(parent[at].view(np.int64))
                    yield pa.RecordBatch.from_pydict({"stem": up, "key": pa.array(keys.view(np.int64)), "pos": pa.array(pos), "neg": pa.array(n - pos), "clean": pa.array(clean)})

    rows = labelled.select("text", "toxic").mapInArrow(count, "stem long, key long, pos long, neg long, clean long")
    return rows.groupBy("stem", "key").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "clean")))


def _tail(pos: Column, n: Column, share: Column) -> Column:
    """-log of Chernoff's bound on the chance of ``pos`` or more of ``n`` at the given share (0 where there are fewer than expected)."""
    x = pos / n
    term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return F.when(x > share, n * (term(x, share) + term(1 - x, 1 - share))).otherwise(0.0)


def discovered(tested: DataFrame, level: str) -> DataFrame:
    """Rows of ``tested`` that are significant by Benjamini and Hochberg's procedure: the largest p of rank r with p <= r / m times the rate.
    Levels (-log p) are compared in steps of 1/8, rounded down, so never more rows than by the exact procedure."""
    step = F.floor(F.least(F.col(level), F.lit(LEVELS / 8.0)) * 8).cast("int")
    rows = tested.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # LEVELS rows at most
    m, rank, least = sum(r.n for r in rows), 0, None
    for r in rows:
        rank += r.n
        if r.step and -r.step / 8 <= np.log(FALSE_SHARE * rank / m):
            least = r.step
    return tested.filter(step >= least) if least is not None else tested.filter("false")


def learn_lexicon(labelled: DataFrame, folder: str) -> tuple[Lexicon, float]:
    """``labelled``: text, toxic. The lexicon (without K), and the share of toxic texts."""
    sizes = labelled.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    share = sizes[0] / sizes[1] if sizes[1] else 0.0
    if not 0 < share < 1:
        return Lexicon(), share
    counts = kept(count_tokens(labelled), folder, "counts")
    logit = lambda p: F.log(p / (1 - p))

    def judged(df: DataFrame, prior: Column) -> DataFrame:
        theta = (F.col("pos") + PRIOR * prior) / (F.col("pos") + F.col("neg") + PRIOR)
        return df.withColumn("theta", theta).withColumn("s", logit(theta) - float(np.log(share / (1 - share)))).withColumn("level", _tail(F.col("pos"), F.col("pos") + F.col("neg"), F.lit(share)))

    stems = judged(counts.filter("stem is null"), F.lit(share))
    marked = kept(discovered(stems, "level").select("key", "theta", "s", "clean"), folder, "stems")
    parents = stems.select(F.col("key").alias("stem"), F.col("theta").alias("prior")).join(marked.select(F.col("key").alias("stem"), F.lit(True).alias("marked")), "stem", "left")
    words = judged(counts.filter("stem is not null").join(parents, "stem"), F.col("prior"))
    words = kept(words.withColumn("below", F.when(F.col("marked"), _tail(F.col("neg"), F.col("pos") + F.col("neg"), 1 - F.col("prior"))).otherwise(0.0)), folder, "words")
    # A word of a marked stem that is as toxic as the stem needs no entry of its own, but its own score is the better one.
    own = discovered(words, "level").unionByName(discovered(words.filter("marked"), "below")).dropDuplicates(["key"])
    own = kept(own.select("key", "stem", "s", "clean"), folder, "own")
    # A stem stands for the words of it that have no entry.
    used = own.groupBy(F.col("stem").alias("key")).agg(F.sum("clean").alias("used"))
    wanted = marked.join(used, "key", "left").select(F.lit(0).alias("kind"), "key", "s", (F.col("clean") - F.coalesce("used", F.lit(0))).alias("clean"))
    wanted = kept(wanted.unionByName(own.select(F.lit(1).alias("kind"), "key", "s", "clean")), folder, "entries")
    lexicon = stored(wanted, folder)
    total = counts.filter("stem is not null").agg(F.sum("clean")).first()[0] or 0
    lexicon.ordinary, lexicon.shift = background(wanted, total)
    return lexicon, share


def background(entries: DataFrame, total: int) -> tuple[float, float]:
    """The ordinary word's score, and what is added to all entries' scores (0 unless they would fill more than ``MOST_DENSE`` of a passage).
    ``entries``: s, and clean, the tokens of clean texts (``total``) that score it."""
    p = (F.col("clean") + 0.5) / F.lit(total + 1.0)
    n, share, dense, mean = entries.agg(F.count("*"), F.sum(p), F.sum(p * F.exp("s")), F.sum(p * F.col("s"))).first()
    if not n or share >= 1:
        return -0.02, 0.0
    shift = min(0.0, float(np.log(MOST_DENSE / dense)))
    dense *= float(np.exp(shift))
    ordinary = float(np.log((1 - dense) / (1 - share)))
    # By Jensen's inequality: the mean of the scores is below the log of the mean of their exponentials, which is 0.
    if mean + shift * share + (1 - share) * ordinary > 1e-12 or abs(dense + (1 - share) * np.exp(ordinary) - 1) > 1e-9:
        raise AssertionError("the background of clean text must score below 0 with lambda 1")
    return min(ordinary, -1e-9), shift


def passages(docs: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, and the maximal segments (first and past-the-end word, score)."""
    tuned(docs.sparkSession)
    segment = pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                t = tokenise(piece.column("text"), ALNUM)
                counts = t.counts()
                base = np.cumsum(counts) - counts
                s = lexicon.scores(t.hash, t.prefix(STEM))
                hit = np.flatnonzero(~np.isnan(s))
                cuts = np.searchsorted(t.row[hit], np.arange(len(counts) + 1))
                found = [[] for _ in counts]
                for row in np.flatnonzero(np.diff(cuts)):
                    own = hit[cuts[row] : cuts[row + 1]]
                    found[row] = [{"first": a, "past": b, "score": x} for a, b, x in maximal_segments((own - base[row]).tolist(), s[own].tolist(), lexicon.ordinary)]
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "segments": pa.array(found, pa.list_(segment))})

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, segments array<struct<first:int,past:int,score:double>>")


def extreme_value_k(clean: DataFrame) -> float:
    """K of P(best >= S) = 1 - exp(-K n exp(-S)), by maximum likelihood over the best segments of clean texts (n_words, segments): a
    text without any has a best score of at most 0, which is all that is known of it. Half a text is added to each side."""
    best = F.coalesce(F.array_max(F.transform("segments", lambda x: x["score"])), F.lit(0.0))
    seen, mass = clean.agg(F.sum((best > 0).cast("double")), F.sum(F.col("n_words") * F.exp(-F.greatest(best, F.lit(0.0))))).first()
    return ((seen or 0.0) + 0.5) / ((mass or 0.0) + 0.5)


def significant(found: DataFrame, k: float) -> DataFrame:
    """Keeps the segments whose expectation in clean text is at most ``E_VALUE``, with it, and adds their evidence."""
    least = lambda x: F.log(F.lit(k) * F.col("n_words")) - x["score"]
    out = found.withColumn("segments", F.filter(F.transform("segments", lambda x: F.struct(x["first"].alias("first"), x["past"].alias("past"), x["score"].alias("score"), F.exp(least(x)).alias("expected"))), lambda x: x["expected"] <= E_VALUE))
    return out.withColumn("evidence", F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["score"] - F.log(F.lit(k) * F.col("n_words"))))


def fit_curve(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over weighted values, with a faint Gaussian prior (Newton's steps)."""
    w, n = np.zeros(2), pos + neg
    design = np.stack([np.ones(len(x)), x], axis=1)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (pos - n * p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted, segments, for every row of ``docs``."""
    folder = shared_folder(docs.sparkSession, "toxic")
    out = remainder("doc_id", held_out[0]) == held_out[1]
    marks = labels.filter("toxic is not null").select("doc_id", "toxic").filter(~out)
    # Copies say no more than one text does: of equal texts the lexicon reads one. Only ids and hashes meet here.
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).filter(~out)
    told = d.select("doc_id", "text_hash").join(marks.hint("merge"), "doc_id").groupBy("text_hash")
    told = told.agg(F.min("doc_id").alias("doc_id"), (2 * F.sum((F.col("toxic") > 0).cast("long")) >= F.count("*")).cast("int").alias("toxic"))
    # Labels grow with the documents, so they are never broadcast, however few they are today.
    read = d.join(told.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    lexicon, share = learn_lexicon(read.select("text", "toxic"), folder)
    found = kept(passages(docs, lexicon), folder, "passages")
    if lexicon.folder:
        clean = told.filter("toxic = 0").select("doc_id")
        lexicon.k = extreme_value_k(found.join(clean.hint("merge"), "doc_id"))
    found = significant(found, lexicon.k)
    level = F.least(F.lit(60.0), "evidence")
    bins = found.select("doc_id", level.alias("level")).join(marks.hint("merge"), "doc_id").groupBy(F.round(F.col("level") / BIN).cast("int").alias("bin"))
    rows = bins.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("pos"), F.sum((F.col("toxic") <= 0).cast("long")).alias("neg")).orderBy("bin").toPandas()  # 241 bins at most
    if 0 < share < 1:
        a, b = fit_curve(rows.bin.to_numpy(float) * BIN, rows.pos.to_numpy(float), rows.neg.to_numpy(float))
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * level)))
    else:
        score = F.lit(float(share))
    scored = found.select("doc_id", out.alias("held_out"), score.cast("double").alias("score"), "segments")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"))
