"""Quality by hierarchical empirical Bayes: a document classifier, hosts and paths.

1. A classifier over binned text statistics gives each document's probability of being good. It is a
   logistic regression, fitted on at most ``SAMPLE_ROWS`` labelled rows (in hash order of the id).
2. Grouped sums over all documents give each host's and each path's count and mean probability. The
   strength of the prior comes from the data, by the method of moments: the spread between hosts beyond
   what their sizes explain. A host's mean is shrunk toward the global mean, a path's toward its host's;
   sparse sites keep little of their own. A document's own probability is left out of its site's sums.
3. The document's log-odds are moved by those of its path's mean against the global mean.

Only sums meet by site, with map-side combining, so a host with a third of all rows is one row per task; the
way back to the documents is a join on (host, path) that Spark broadcasts if it is small and can split if not.

Defined cases: null hosts and paths are sites of their own. Null and empty texts have statistics of 0 and are
judged as such. Without labels of both kinds the classifier gives the share of good labels (1 without any). Repeated rows are judged alike
and count in their site; ties in the sample's draw go by label, then statistics. Columns listed in ``keep`` are carried along under their names (with an
underscore before one that a column of the result has); others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bounded_sample, kept, shared_folder, slices, table, tuned
from .quality_rules import text_counts

SAMPLE_ROWS = 20_000
BINS = 12
RIDGE = 0.5
MAX_STRENGTH = 1e4
FEATURES = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "variety", "words_per_line", "upper_share", "digit_share", "marks_per_word", "log_longest")


def features(texts: pa.Array) -> np.ndarray:
    """One row a text, one column a feature of ``FEATURES``."""
    c = {k: v.astype(float) for k, v in text_counts(texts).items()}

    def share(a: str, b: str) -> np.ndarray:
        return np.divide(c[a], c[b], out=np.zeros(len(c[a])), where=c[b] > 0)

    words = c["n_words"]
    variety = np.ones(len(words))
    many = words > 1
    variety[many] = np.log(c["n_distinct"][many]) / np.log(words[many])
    return np.stack([np.log1p(words), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), variety, share("n_words", "n_lines"), share("n_upper", "word_chars"), share("n_digits", "word_chars"), share("n_marks", "n_words"), np.log1p(c["longest_word"])], axis=1)


@dataclass
class Classifier:
    """Additive log-odds over bins of each feature."""

    edges: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            out += w[np.searchsorted(e, x[:, k], side="right")]
        return out

    def column(self, x: str) -> Column:
        """The log-odds of the array column ``x`` as one expression: a feature's bin is the number of edges at or below it."""
        out = F.lit(self.bias)
        for k, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            place = F.lit(1)
            for edge in e.tolist():
                place = place + (F.col(x)[k] >= edge).cast("int")
            out = out + F.element_at(F.array(*map(F.lit, w.tolist())), place)
        return out


def fit(x: np.ndarray, good: np.ndarray) -> Classifier:
    """Ridge logistic regression on one-hot bins, by Newton's steps."""
    if not len(good) or good.all() or not good.any():
        share = good.mean() if len(good) else 1.0
        return Classifier(bias=float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    # Quantiles of each label's rows alike, so that rare bad texts have bins of their own.
    edges = [np.unique(np.concatenate([np.quantile(x[good == g, k], np.linspace(0, 1, BINS // 2 + 1)[1:-1]) for g in (True, False)])) for k in range(x.shape[1])]
    blocks = [np.eye(len(e) + 1)[np.searchsorted(e, x[:, k], side="right")] for k, e in enumerate(edges)]
    design = np.concatenate([np.ones((len(x), 1)), *blocks], axis=1)
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(h, design.T @ (good - p) - ridge * w)
        w += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    cuts = np.cumsum([1, *(b.shape[1] for b in blocks)])
    return Classifier(edges, [w[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], float(w[0]))


def _strength(groups: DataFrame, mean: float) -> float:
    """Method of moments: m with Var(site mean) = v / n + v_between, v_between = mean (1 - mean) / (m + 1)."""
    g = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within")).first()
    if not g["k"] or g["k"] < 2 or g["n"] <= g["k"]:
        return MAX_STRENGTH
    inner = g["within"] / (g["n"] - g["k"])
    v = (g["between"] - (g["k"] - 1) * inner) / (g["n"] - g["nn"] / g["n"])
    return float(np.clip(mean * (1 - mean) / max(v, 1e-12) - 1, 1.0, MAX_STRENGTH))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``scored``: host, path, p. Rows: host, path, path_n, path_s, host_n, host_s; then global mean, host and path strengths."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = float(np.clip(total[1] / total[0], 1e-6, 1 - 1e-6)) if total[0] else 0.5
    up, down = _strength(hosts, mean), _strength(paths, mean)
    h = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(h, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return sites, mean, up, down


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, host: str | Column = "source", path: str | Column = "lang", key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keep`` columns (``key`` if none), p_document, host_mean, path_mean, p_good."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "quality")
    at = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    keep = keep or (key,)
    names = [f"k{i}" for i in range(len(keep))]
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), at(host).alias("host"), at(path).alias("path"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    carried = ["key", "host", "path", *names]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = features(piece.column("text"))
                yield pa.RecordBatch.from_pydict({n: piece.column(n) for n in carried} | {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    # The texts are measured once; what is kept goes along.
    measured = kept(d.mapInArrow(measure, ", ".join(f"{n} {kinds[n]}" for n in carried) + ", x array<double>"), folder, "features")
    marks = labels.filter("quality is not null").select(F.col("doc_id").alias("key"), "quality")
    rows = bounded_sample(measured.join(marks, "key").select("x", "quality", F.xxhash64("key").alias("draw")), "draw", sample_rows, "quality", "x")
    model = fit(np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, len(FEATURES))), rows.quality.to_numpy() > 0)
    scored = measured.withColumn("p_document", 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), model.column("x"))))))
    sites, mean, up, down = site_posteriors(kept(scored.select("host", "path", F.col("p_document").alias("p")), folder, "scored"))
    sites = kept(sites, folder, "sites").select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "path_n", "path_s", "host_n", "host_s")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")), "left")
    own = F.col("p_document")
    out = out.withColumn("host_mean", (F.col("host_s") - own + up * mean) / (F.col("host_n") - 1 + up))
    out = out.withColumn("path_mean", (F.col("path_s") - own + down * F.col("host_mean")) / (F.col("path_n") - 1 + down))
    odds = _logit(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), own))) + _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "path_mean"))) - _logit(F.lit(mean))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, apart(keep, ("p_document", "host_mean", "path_mean", "p_good")), strict=True)), "p_document", "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("p_good"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_document", "host_mean", "path_mean", "p_good", (F.col("p_good") >= 0.5).alias("kept"))
