"""Benchmark decontamination with an FM-index per training shard.

Each Arrow batch of documents is one shard. Its words become symbols: the words of the benchmark have
symbols of their own, all others share one that no test phrase holds (runs of it, and runs of
benchmark words too short for any phrase, shrink to one symbol, which loses no occurrence). All test
phrases are searched backward at once through wavelet-matrix ranks, occurrences are located by sampled
suffix positions, and covered words are merged into removal spans. A document lies whole in one shard,
so no document is shuffled. The benchmark's windows are cut and made distinct in tasks and written as arrays in blocks of
``BLOCK_PHRASES`` to the shared folder; a task maps them and searches its shard for each block in one pass over the documents, so
neither the driver nor a broadcast holds any of it.

Defined cases: a null or empty document, or an item without words, matches nothing. Repeated rows each
get a row. Items with equal ids count once; a null id counts as the empty string. Further columns,
whatever their names, are ignored unless listed in ``keep``; a kept column that has the name of one of the result gets an underscore before it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Tokens, apart, kept, mapped, shared_folder, slices, store, table, tokenise, tuned
from .fm_index import FMIndex

WINDOW = 10
BLOCK_PHRASES = 200_000
SHARD_BYTES = 2 << 20


class Phrases:
    """The distinct windows of a block, as symbols, from arrays of the shared folder: vocabulary (sorted word hashes), phrase sizes, symbols of all
    phrases end to end, owners of all phrases end to end with their ends, and the ends and bytes of the item ids."""

    def __init__(self, uri: str | None):
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        if uri is None:
            return
        self.vocabulary, size, symbols, self.owner_ends, self.owners, self.id_ends, self.id_bytes = mapped(uri)
        begin = np.cumsum(size) - size
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            self.groups.append((symbols[begin[own][:, None] + np.arange(n)].astype(np.int64), own))
        self.shortest = int(size.min()) if len(size) else 0

    def names(self, phrases: np.ndarray) -> list[str]:
        """Item ids that own any of the phrases."""
        own = np.unique(np.concatenate([self.owners[self.owner_ends[p] : self.owner_ends[p + 1]] for p in phrases.tolist()]))
        return [self.id_bytes[self.id_ends[k] : self.id_ends[k + 1]].tobytes().decode() for k in own.tolist()]

    def find(self, t: Tokens, cover: np.ndarray, items: list[set[str]]) -> None:
        """Adds to ``cover`` where hit words of the texts begin (+1) and end (-1), and to ``items`` those found in each text."""
        if not len(t.hash) or not self.groups:
            return
        at = np.minimum(np.searchsorted(self.vocabulary, t.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == t.hash
        first = known & np.concatenate(([True], ~known[:-1] | (t.row[1:] != t.row[:-1])))
        run = np.cumsum(first)[known] - 1
        long = np.bincount(run)[run] >= self.shortest if len(run) else run.astype(bool)
        place = np.flatnonzero(known)[long]  # the words that stay
        if not len(place):
            return
        gap = np.concatenate(([True], run[long][1:] != run[long][:-1]))
        seat = np.arange(len(place)) + np.cumsum(gap)  # a separator before each run
        seq = np.ones(seat[-1] + 3, np.int64)
        seq[seat], seq[-1] = at[place] + 2, 0
        index = FMIndex(seq, len(self.vocabulary) + 2)
        word_of = np.zeros(len(seq), np.int64)
        word_of[seat] = place
        for phrases, number in self.groups:
            which, where = index.locate(*index.search(phrases))
            word = word_of[where]
            np.add.at(cover, word, 1)
            np.add.at(cover, word + phrases.shape[1], -1)
            pair = np.unique(t.row[word] * np.int64(len(number)) + which)
            row, own = pair // len(number), number[pair % len(number)]
            cuts = [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                items[int(row[a])].update(self.names(own[a:b]))


@functools.lru_cache(maxsize=8)
def _phrases(uri: str) -> Phrases:
    return Phrases(uri)


def store_phrases(benchmark: DataFrame, folder: str, *, item: str, text: str, window: int) -> list[str]:
    """Cut the items' windows, make them distinct and write them as arrays, all in tasks; the files' names. A block has about ``BLOCK_PHRASES``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t"):
                t = tokenise(piece.column("t"), ALNUM)
                n = t.counts()
                base = np.cumsum(n) - n
                size = np.minimum(n, window)
                number = np.where(n > 0, n - size + 1, 0)
                row = np.repeat(np.arange(len(n)), number)
                begin = base[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                words = [t.hash[a : a + k].tobytes() for a, k in zip(begin.tolist(), size[row].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"phrase": pa.array(words, pa.binary()), "item": piece.column("i").take(pa.array(row))})

    def write(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in rows.column("phrase").to_pylist()]
        vocabulary, symbols = np.unique(np.concatenate(words), return_inverse=True)
        owners = rows.column("owners").combine_chunks()
        owners = owners.chunk(0) if isinstance(owners, pa.ChunkedArray) else owners
        ids = owners.flatten().dictionary_encode()
        names = [x.encode() for x in ids.dictionary.to_pylist()]
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(owners)))).astype(np.int64)
        uri = f"{folder}/phrases/{block:06d}"
        store(uri, [vocabulary, np.array([len(w) for w in words], np.int32), (symbols + 2).astype(np.int32), ends, np.asarray(ids.indices).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64), np.frombuffer(b"".join(names), np.uint8)])
        return pa.table({"file": [uri]})

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    found = kept(rows.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("owners")), folder, "windows")
    blocks = max(1, -(-found.count() // BLOCK_PHRASES))
    files = found.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks))).groupBy("block").applyInArrow(write, "file string")
    return sorted(r.file for r in files.collect())  # a name a block


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.concatenate(([0], cut + 1))].tolist(), (hit[np.concatenate((cut, [len(hit) - 1]))] + 1).tolist(), strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_words, n_hit, item_ids (sorted), spans (first and past-the-end word of each removal) and
    clean_text (the text without the spans; null texts come back empty)."""
    spark = tuned(docs.sparkSession)
    files = store_phrases(benchmark, shared_folder(spark, "phrases"), item=item, text=item_text, window=window)
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    names = [f"k{i}" for i in range(len(keep))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SHARD_BYTES):
                t = tokenise(piece.column("text"), ALNUM)
                counts = t.counts()
                base = np.cumsum(counts) - counts
                cover, items = np.zeros(len(t.hash) + 1, np.int64), [set() for _ in counts]
                for f in files:
                    _phrases(f).find(t, cover, items)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                cuts = np.searchsorted(t.row[hit], np.arange(len(counts) + 1))
                spans = [_spans(hit[a:b] - base[row]) for row, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
                yield pa.RecordBatch.from_pydict({n: piece.column(n) for n in names} | {
                    "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(np.diff(cuts), pa.int64()), "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array([[{"first": a, "past": b} for a, b in x] for x in spans], span),
                    "clean_text": pa.array([_without(t, row, int(base[row]), x) for row, x in enumerate(spans)], pa.binary()).cast(pa.string()),
                })

    own = ("n_words", "n_hit", "item_ids", "spans", "clean_text")
    d = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    carried = "".join(f"{n} {d.schema[n].dataType.simpleString()}, " for n in names)
    out = d.mapInArrow(search, f"{carried}n_words long, n_hit long, item_ids array<string>, spans array<struct<first:int,past:int>>, clean_text string")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, apart(keep, own), strict=True)), *own)


def _without(t, row: int, base: int, spans: list[tuple[int, int]]) -> bytes:
    """The text of a row without the words of the spans and what stands between them."""
    start, stop = int(t.offsets[row]), int(t.offsets[row + 1])
    parts = []
    for a, b in spans:
        parts.append(t.data[start : t.start[base + a]].tobytes())
        start = int(t.end[base + b - 1])
    return b"".join([*parts, t.data[start:stop].tobytes()])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
