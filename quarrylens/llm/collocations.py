"""Phrases of two to four words that stand together more often than apart, for each language.

Candidates come from a sketch: every phrase falls into one of 2^48 cells, and a cell's count is an upper bound of the count of each phrase in it. Only cells that are
hit exist, as rows that Spark sums, so the sketch is as large as the data ask for. Pairs are counted first; phrases of three and four words only
where the bound of each of their pairs reaches the threshold. Phrases all of whose bounds reach it, and their single words, are the keys.

Keys are compiled into Aho-Corasick automata, shard by shard of the texts: a task gathers texts of some megabytes, with the keys that stand in them, and scans them with
an automaton of those keys alone. So the documents are scanned once, however many keys there are, and a worker's memory is that of a shard. A key stands between spaces, and
so does every word of the scanned text, with a line feed between pieces; so matches are whole words, never cross a piece, and overlap freely. Spark sums the shards. What
follows (thresholds, cuts, phrases inside longer ones, ranks) is joins on exact counts.

Tasks add up cells before they hand them on. Hot cells lie in sorted arrays in the shared folder and are mapped by the workers. Ranks are taken in shares of a language first, so
no task orders more than a share's phrases.

Defined cases: null and empty texts have no words, a null language is ``und``. Repeated rows count each. Texts without separators are one piece. Ties of
score rank by count, then phrase. Empty tables, or no phrase that reaches the threshold, give no rows. Further columns are ignored. Words are hashed for the sketch and to
gather a shard's keys (64 bits, so two keys of a shard are taken for one with a chance of 2^-64); counts are of the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BASE, Tokens, kept, mapped, mix, shared_folder, slices, store, table, tokenise, tuned
from .divergence import words_at

LEAST = 30
MOST_WORDS = 4
SCALE = 2_000_000
#: A candidate goes if a longer one around it has this share of its count, in hundredths.
INSIDE = 80
TOP = 2000
SHARES = 64
CELL_BITS = 48
#: Keys of an automaton at most; keys, and bytes of text, from which on a shard is scanned.
BLOCK_KEYS, PASS_KEYS, SHARD_BYTES = 400_000, 300_000, 32 << 20
#: Cells that a task gathers before it adds them up; leading bits of a cell by which cells are dealt out.
HELD_CELLS, PART_BITS = 3 << 20, 12
#: Groups in which the counts of phrases are summed.
PHRASE_PARTS = 1024
#: Hot cells in a file.
FILE_CELLS = 1 << 22
COUNT_BYTES = 2 << 20

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE
_WORD[[0x20, 0x09]] = False
#: Lower case, tabs as spaces, ends of pieces as line feeds.
_PLAIN = bytes(0x0A if _PIECE[b] else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_EDGE, _SPACES = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")


def guarded(texts: list[bytes]) -> str:
    """The words of all texts, each between spaces, with a line feed between pieces."""
    joined = b" " + b"\n".join(texts).translate(_PLAIN) + b" "
    return _EDGE.sub(b" \n ", _SPACES.sub(b" ", joined)).decode("utf-8", "surrogateescape")


class Phrases:
    """The words of a slice, the pieces that they stand in, and the cells of their runs."""

    def __init__(self, batch: pa.RecordBatch):
        self.t: Tokens = tokenise(batch.column("text"), _WORD)
        t = self.t
        ends = np.concatenate(([0], np.cumsum(_PIECE[t.data])))
        opens = np.ones(len(t.hash), bool)
        opens[1:] = (ends[t.start[1:]] > ends[t.end[:-1]]) | (t.row[1:] != t.row[:-1])
        self.piece = np.cumsum(opens)
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        seed = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.lang = np.asarray(lang.indices)[t.row] if len(t.row) else np.zeros(0, np.int32)
        self.seed = seed[self.lang]

    def places(self, size: int) -> np.ndarray:
        """Where runs of so many words in one piece begin."""
        n = max(0, len(self.piece) - size + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        """64-bit hashes of runs of so many words."""
        acc = self.seed[at] + np.uint64(size)
        for k in range(size):
            acc = mix(acc * np.uint64(_BASE) + self.t.hash[at + k])
        return acc

    def cells(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.runs(at, size) >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def text(self, at: np.ndarray, size: int) -> pa.Array:
        words = [words_at(self.t, at + k) for k in range(size)]
        return words[0] if size == 1 else pc.binary_join_element_wise(*words, " ")


class Hot:
    """Cells whose count reaches the threshold, sorted, in 2^bits files by their leading bits."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def has(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), bool)
        file = cells >> (CELL_BITS - self.bits)
        for f in np.unique(file).tolist():
            own = np.flatnonzero(file == f)
            (known,) = mapped(f"{self.folder}/{f:06d}")
            if len(known):
                at = np.minimum(np.searchsorted(known, cells[own]), len(known) - 1)
                out[own] = known[at] == cells[own]
        return out


def _store_hot(hot: DataFrame, folder: str) -> Hot:
    """Writes the cells; a file without cells is there too."""
    bits = max(0, (hot.count() // FILE_CELLS).bit_length())

    def write(rows: pa.Table) -> pa.Table:
        f, cells = rows.column("file")[0].as_py(), np.sort(np.asarray(rows.column("cell"), np.int64))
        store(f"{folder}/{f:06d}", [cells[cells >= 0]])
        return pa.table({"file": pa.array([f], pa.int64())})

    rows = hot.select("cell", F.shiftright("cell", CELL_BITS - bits).alias("file")).unionByName(hot.sparkSession.range(1 << bits).select(F.lit(-1).cast("long").alias("cell"), F.col("id").alias("file")))
    rows.groupBy("file").applyInArrow(write, "file long").agg(F.count("*")).first()
    return Hot(folder, bits)


def _merged(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, with its sum."""
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    return cell[first], np.add.reduceat(n, first) if len(first) else n


def _tally(cells: Callable[[Phrases], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells and their counts, as lists by the cells' leading bits. A task adds up what it gathers, and hands it on when many different cells are held."""

    def rows(cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        bound = np.searchsorted(cell, np.arange((1 << PART_BITS) + 1) << (CELL_BITS - PART_BITS))
        part = np.flatnonzero(bound[1:] > bound[:-1])
        for i in range(0, len(part), 256):
            own = part[i : i + 256]
            first, ends = bound[own[0]], bound[own + 1]
            at = pa.array(np.concatenate(([0], ends - first)), pa.int32())
            yield pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int32()), "cells": pa.ListArray.from_arrays(at, pa.array(cell[first : ends[-1]])), "counts": pa.ListArray.from_arrays(at, pa.array(n[first : ends[-1]]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            for piece in slices(batch, limit=COUNT_BYTES):
                new.append(cells(Phrases(piece)))
                size += len(new[-1])
                if size >= HELD_CELLS:
                    cell, n = np.unique(np.concatenate(new), return_counts=True)
                    held, new, size = _merged(np.concatenate((held[0], cell)), np.concatenate((held[1], n))), [], 0
                    if len(held[0]) >= HELD_CELLS:
                        yield from rows(*held)
                        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cell, n = np.unique(np.concatenate([*new, held[0][:0]]), return_counts=True)
        yield from rows(*_merged(np.concatenate((held[0], cell)), np.concatenate((held[1], n))))

    return run


def _chained(p: Phrases, hot: Hot) -> list[np.ndarray]:
    """Where runs of 2, 3, ... words begin all of whose pairs are in hot cells."""
    pair = p.places(2)
    good = np.zeros(len(p.piece) + MOST_WORDS, bool)
    good[pair[hot.has(p.cells(pair, 2))]] = True
    out = [np.flatnonzero(good)]
    for k in range(1, MOST_WORDS - 1):
        out.append(out[-1][good[out[-1] + k]])
    return out


def sketch(d: DataFrame, folder: str, least: int) -> tuple[Hot, Hot]:
    """Hot cells of pairs; and those of longer phrases, and of the words that stand in hot pairs often enough."""

    def total(rows: pa.Table) -> pa.Table:
        cell, n = _merged(*(np.asarray(rows.column(c).combine_chunks().flatten(), np.int64) for c in ("cells", "counts")))
        return pa.table({"cell": pa.array(cell[n >= least], pa.int64())})

    def hot(cells: Callable[[Phrases], np.ndarray], name: str) -> Hot:
        summed = d.mapInArrow(_tally(cells), "part int, cells array<long>, counts array<long>").groupBy("part").applyInArrow(total, "cell long")
        return _store_hot(kept(summed, folder, name), f"{folder}/hot-{name}")

    def longer(p: Phrases) -> np.ndarray:
        at = _chained(p, pairs)
        inside = np.zeros(len(p.lang), bool)
        inside[at[0]] = inside[at[0] + 1] = True
        return np.concatenate([p.cells(np.flatnonzero(inside), 1), *(p.cells(begin, k) for k, begin in enumerate(at[1:], 3))])

    pairs = hot(lambda p: p.cells(p.places(2), 2), "pairs")
    return pairs, hot(longer, "longer")


class _Shard:
    """Texts of a language, and the keys that stand in them: phrases whose upper bounds reach the threshold. Words of such phrases are counted as they come."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.bytes = self.total = 0
        self.seen = np.zeros(0, np.uint64)
        self.keys: list[tuple[int, pa.Array]] = []
        self.words: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, p: Phrases, rows: pa.RecordBatch, runs: dict[int, tuple[np.ndarray, np.ndarray]], total: int) -> None:
        """``runs``: by the number of words, where they begin and their hashes."""
        self.texts += rows.column("text").cast(pa.binary()).to_pylist()
        self.bytes += sum(map(len, self.texts[len(self.texts) - rows.num_rows :]))
        self.total += total
        for size, (begin, hashes) in runs.items():
            hashes, one, n = np.unique(hashes, return_index=True, return_counts=True)
            if size == 1:
                self.words.append((hashes, n, p.text(begin[one], 1)))
                continue
            known = np.minimum(np.searchsorted(self.seen, hashes), max(len(self.seen) - 1, 0))
            new = self.seen[known] != hashes if len(self.seen) else np.ones(len(hashes), bool)
            if new.any():
                self.seen = np.sort(np.concatenate((self.seen, hashes[new])))
                self.keys.append((size, p.text(begin[one[new]], size)))

    def counted(self, lang: str) -> Iterator[pa.RecordBatch]:
        """How often each word and key stands in the texts, overlaps included; and a row without a phrase, the number of all words."""
        yield _rows(lang, pa.array([None], pa.string()), np.zeros(1), np.array([self.total]))
        hashes, one, back = np.unique(np.concatenate([h for h, _, _ in self.words]), return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n, _ in self.words]), len(hashes)).astype(np.int64)
        yield _rows(lang, pa.concat_arrays([x.cast(pa.string()) for _, _, x in self.words]).take(pa.array(one)), np.ones(len(one)), n)
        if not self.keys:
            return
        text = guarded(self.texts)
        phrases, sizes = pa.concat_arrays([x.cast(pa.string()) for _, x in self.keys]), np.repeat([k for k, _ in self.keys], [len(x) for _, x in self.keys])
        for i in range(0, len(phrases), BLOCK_KEYS):
            own = phrases[i : i + BLOCK_KEYS]
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, raw in enumerate(own.cast(pa.binary()).to_pylist()):
                automaton.add_word(f" {raw.decode('utf-8', 'surrogateescape')} ", k)
            automaton.make_automaton()
            n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32), minlength=len(own))
            yield _rows(lang, own, sizes[i : i + BLOCK_KEYS], n)


def _rows(lang: str, phrases: pa.Array, sizes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of a shard as lists, dealt out by a hash of the phrase."""
    part = np.fromiter(map(crc32, phrases.cast(pa.binary()).fill_null(b"").to_pylist()), np.int64) % PHRASE_PARTS
    order = np.argsort(part, kind="stable")
    own, begin = np.unique(part[order], return_index=True)
    at = pa.array(np.append(begin, len(order)), pa.int32())
    columns = {"phrases": phrases.take(pa.array(order)), "sizes": pa.array(np.asarray(sizes)[order], pa.int32()), "counts": pa.array(n[order], pa.int64())}
    return pa.RecordBatch.from_pydict({"part": pa.array(own, pa.int32()), "lang": pa.array([lang] * len(own), pa.string())} | {c: pa.ListArray.from_arrays(at, x) for c, x in columns.items()})


def frequencies(d: DataFrame, pairs: Hot, more: Hot, least: int, folder: str) -> DataFrame:
    """lang, phrase, size, f: how often each word and phrase stands in its language's texts, overlaps included, from the threshold on; and a language's number of words, without a phrase."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        for batch in batches:
            for piece in slices(batch, limit=COUNT_BYTES):
                p = Phrases(piece)
                at = _chained(p, pairs)
                every = np.arange(len(p.lang))
                runs = {1: every[more.has(p.cells(every, 1))], 2: at[0]} | {size: at[size - 2][more.has(p.cells(at[size - 2], size))] for size in range(3, MOST_WORDS + 1)}
                hashes = {size: p.runs(begin, size) for size, begin in runs.items()}
                for k, lang in enumerate(p.langs):
                    own = {size: p.lang[begin] == k for size, begin in runs.items()}
                    shards.setdefault(lang, _Shard()).add(p, piece.filter(pc.equal(piece.column("lang"), lang)), {size: (begin[own[size]], hashes[size][own[size]]) for size, begin in runs.items()}, np.count_nonzero(p.lang == k))
                for lang in [x for x, shard in shards.items() if len(shard.seen) >= PASS_KEYS]:
                    yield from shards.pop(lang).counted(lang)
                while sum(shard.bytes for shard in shards.values()) >= SHARD_BYTES:
                    lang = max(shards, key=lambda x: shards[x].bytes)
                    yield from shards.pop(lang).counted(lang)
        for lang, shard in shards.items():
            yield from shard.counted(lang)

    def total(rows: pa.Table) -> pa.Table:
        lists = {c: rows.column(c).combine_chunks() for c in ("phrases", "sizes", "counts")}
        n = np.asarray(pc.list_value_length(lists["sizes"]), np.int64)
        lang = rows.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n)))
        every = pa.table({"lang": lang, "phrase": lists["phrases"].flatten(), "size": lists["sizes"].flatten(), "f": lists["counts"].flatten()})
        summed = every.group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["lang", "phrase", "size", "f"])
        return summed.filter(pc.or_(pc.is_null(summed["phrase"]), pc.greater_equal(summed["f"], least)))

    counted = d.mapInArrow(scan, "part int, lang string, phrases array<string>, sizes array<int>, counts array<long>")
    return kept(counted.groupBy("part").applyInArrow(total, "lang string, phrase string, size int, f long"), folder, "frequencies")


def score_phrases(freq: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that reach the threshold and are not inside a longer one of nearly their count."""
    long = freq.filter((F.col("size") > 1) & (F.col("f") >= least)).withColumn("w", F.split("phrase", " "))
    joined = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = cut.join(freq.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(freq.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.withColumn("score", F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div (CAST(l AS DECIMAL(20, 0)) + r)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    parts = [(b, n) for n in range(2, MOST_WORDS) for b in range(1, MOST_WORDS - n + 2)]
    inner = F.array(*(F.when(F.col("size") > n, F.when(F.col("size") >= b + n - 1, joined(F.lit(b), F.lit(n)))) for b, n in parts))
    around = long.filter("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    best = best.join(around, ["lang", "phrase"], "left")
    return best.filter(f"longer IS NULL OR 100 * longer < {INSIDE} * a").drop("longer")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "collocations")
    d = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    pairs, more = sketch(d, folder, least)
    every = frequencies(d, pairs, more, least, folder)
    freq, words = every.filter("phrase IS NOT NULL"), every.filter("phrase IS NULL").select("lang", F.col("f").alias("words"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rank = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    best = rank(rank(score_phrases(freq, least), F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).drop("rank"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, h.f AS l, r.f AS r, CAST((2000000 * CAST(x.a AS HUGEINT)) // CAST(h.f + r.f AS HUGEINT) AS BIGINT) AS score, cut
      FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS o FROM c, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
