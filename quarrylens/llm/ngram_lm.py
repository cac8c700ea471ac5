"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays.

Tokens are ASCII-lowered words and one end mark a text; order-1 start marks stand before each text.
Counting: a first pass counts words, which gives each its number (its place among the sorted hashes) and finds the frequent ones. In a second,
every Arrow slice is reduced to distinct n-grams of the top order with counts, as blocks of word numbers. The n-grams of a bucket of next-to-last words meet in one task: all contexts and
all shorter n-grams down to pairs share that word, so the task finishes all orders but the lowest, and only counts of last words go on.
N-grams whose next-to-last word is frequent (more than ``HOT_TOKENS`` tokens) are dealt by the hash of the whole n-gram instead and
merged order by order, partial sums first, so no word, pair or context is a task's burden. Counts of counts give each order's three discounts.

Arrays are files of the shared folder, replaced as a whole by a retry, and listed in a manifest: one that is gone is an error, not an empty one.
A table of n-grams keeps the next 32 bits of each hash after those that its place in the array tells, so an n-gram that was never seen is taken
for another with a chance of about 4e-9, whatever the size of the corpus; the three most usual values take two bits. Words have whole hashes of 64 bits.

Scoring: tasks map the arrays into memory and look up the distinct n-grams of a slice, bucket by bucket, so pages are shared by the workers
of a machine. Documents aren't shuffled.

Buckets grow in number with the input, so a bucket's task and its search depth stay the same. A task deals to ``FAN`` parts at
most; with more buckets than that the parts are dealt again. The production order is 3: see README.md for its disk figures.

Defined cases: null and empty texts have the end mark only. Repeated rows count each time. Without
training texts every token has the probability 1/(V+1) = 1. Further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, kept, mapped, mix, remainder, shared_folder, slices, store, table, tokenise, tuned

ORDER = 3
HELD_OUT = (7, 2)
BUCKET_TEXT_BYTES = 16 << 20
FLUSH_TOKENS = 2_000_000
#: A word with more tokens is frequent.
HOT_TOKENS = 2_000_000
#: Bytes of text a file of words; parts that a task deals to.
BUCKET_WORD_BYTES, FAN = 64 << 20, 256
SCORE_BYTES = 2 << 20
#: Discounts where the counts of counts of a small corpus give none within their range.
FALLBACK = (0.5, 1.0, 1.5)
END = np.uint64(0x5851F42D4C957F2D)
#: The number of the start mark; words have 1 and up.
START = np.uint64(0)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _combined(context: np.ndarray, suffix: np.ndarray, k: int) -> np.ndarray:
    """The hash of a k-gram from those of its first and of its last k-1 words."""
    with np.errstate(over="ignore"):
        return mix(context * _STEP + suffix + np.uint64(k))


def shifted(h: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The token k places before each token of its text, or the start mark."""
    if k == 0:
        return h
    out = np.full(len(h), START, np.uint64)
    if k < len(h):
        same = row[k:] == row[:-k]
        out[k:][same] = h[:-k][same]
    return out


def grams(words: list[np.ndarray]) -> list[list[np.ndarray]]:
    """``words``: numbers of the words of n-grams, a column a place. [k-1][i]: hash of the k words from place i."""
    out = [[mix(w + np.uint64(1)) for w in words]]
    for k in range(2, len(words) + 1):
        out.append([_combined(out[-1][i], out[-1][i + 1], k) for i in range(len(words) - k + 1)])
    return out


def with_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end mark after each text, the text of each, tokens a text."""
    t = tokenise(texts, PLAIN)
    counts = t.counts() + 1
    h = np.full(int(counts.sum()), END, np.uint64)
    ends = np.cumsum(counts) - 1
    keep = np.ones(len(h), bool)
    keep[ends] = False
    h[keep] = t.hash
    return h, np.repeat(np.arange(len(counts)), counts), counts


def _sorted(columns: int) -> int:
    """The column that a block's rows are sorted by: the next-to-last word of an n-gram."""
    return max(columns - 2, 0)


def _packed(hashes: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Columns of hashes as a sorted dictionary and codes (one column is sorted, so its codes become steps),
    then columns of small numbers; all as byte planes, those that are worth it compressed."""
    import zlib

    columns: list[tuple[np.ndarray, bool]] = []
    for k, c in enumerate(hashes):
        own, code = np.unique(c, return_inverse=True)
        columns += [(np.diff(own, prepend=np.uint64(0)), False), (np.diff(code, prepend=0) if k == _sorted(len(hashes)) else code, True)]
    columns += [(n, True) for n in numbers]
    head, body = [len(hashes), len(numbers)], []
    for c, small in columns:
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        raw = np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        body.append(zlib.compress(raw, 1) if small else raw)
        head += [len(c), width, len(body[-1]), int(small)]
    return np.array(head, "<i8").tobytes() + b"".join(body)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    import zlib

    m, w = np.frombuffer(raw, "<i8", 2).tolist()
    specs = np.frombuffer(raw, "<i8", 4 * (2 * m + w), 16).reshape(-1, 4).tolist()
    at, columns = 16 + 32 * len(specs), []
    for n, width, size, small in specs:
        own = raw[at : at + size]
        at += size
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(zlib.decompress(own) if small else own, np.uint8).reshape(width, n).T
        columns.append(full.reshape(-1).view("<u8") if n else np.zeros(0, np.uint64))
    out = [np.cumsum(columns[2 * k], dtype=np.uint64)[(np.cumsum(columns[2 * k + 1]) if k == _sorted(m) else columns[2 * k + 1]).astype(np.int64)] for k in range(m)]
    return out + columns[2 * m :]


def _grouped(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], *(np.add.reduceat(v[order], at).astype(np.uint64) if len(keys) else np.zeros(0, np.uint64) for v in values)]


def _merged(key: np.ndarray, n: np.ndarray, carried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, with sums of n and with the columns that a key determines."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n[order], at) if len(key) else n, [c[order[at]] for c in carried]


#: Blocks: n-grams by the hash of the whole, counts of words, statistics of contexts, n-grams by their next-to-last word, counts of last words.
WHOLE, WORD, CONTEXT, LOCAL, LAST = range(5)
#: Rows that aren't dealt: words that are frequent, numbers of a bucket.
FREQUENT, NUMBERS = 8, 9
_BLOCKS = "kind int, bucket int, part int, block binary"


def _by_word(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of n-grams with these next-to-last words (numbers)."""
    return _bucket(mix(words + np.uint64(1)), buckets)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The high bits of a hash choose its bucket."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _dealt(kind: int, bucket: np.ndarray, hashes: list[np.ndarray], numbers: list[np.ndarray], buckets: int, parts: int = FAN) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows (kind, bucket or -1, part, block); within a block, rows are sorted by the column before the last, whose codes then take least room."""
    parts = min(parts, buckets)
    part = bucket * parts // buckets
    order = np.lexsort((hashes[0], hashes[_sorted(len(hashes))], part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        yield kind, p if parts == buckets else -1, p, _packed([c[own] for c in hashes], [c[own] for c in numbers])


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "bucket", "part", "block"])


def _joined(blocks: list[bytes]) -> list[np.ndarray]:
    parts = [_unpacked(x) for x in blocks]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _coded(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of the distinct rows, the most usual first, and a code a row: two bits for the first three, four to a byte, and for the others
    3, with their places and codes apart."""
    row = columns[0].astype(np.uint64)
    for c in columns[1:]:
        row = mix(row) + c.astype(np.uint64)
    _, first, code, times = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, first = place[code], first[order]
    rare = np.flatnonzero(code > 2)
    two = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    two[: len(code)] = np.minimum(code, 3)
    packed = two[0::4] | (two[1::4] << 2) | (two[2::4] << 4) | (two[3::4] << 6)
    return [packed, rare.astype(np.uint32), code[rare].astype(np.min_scalar_type(max(len(first) - 1, 0))), *(c[first].astype(np.uint64) for c in columns)]


def _decoded(coded: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """The rows of ``_coded`` at the given places."""
    packed, rare, codes, *columns = coded
    code = ((packed[at >> 2] >> ((at & 3) * 2).astype(np.uint8)) & 3).astype(np.int64)
    other = np.flatnonzero(code == 3)
    code[other] = codes[np.searchsorted(rare, at[other].astype(np.uint32))]
    return [c[code] for c in columns]


def _table(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays to store: where each run of the hashes' first bits begins, the next 32 bits of each, sorted, and the values."""
    keys = mix(keys)  # the bucket may tell the first bits of the hash itself
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(0, int(len(keys) // 16).bit_length())
    runs = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
    return [runs.astype(np.uint32), ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), *_coded([c[order] for c in columns])]


def _found(table: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The values of each key in arrays of ``_table`` (0 where there is none)."""
    runs, low, *coded = table
    out = [np.zeros(len(keys)) for _ in coded[3:]]
    if not len(low):
        return out
    bits = (len(runs) - 1).bit_length() - 1
    keys = mix(keys)
    run = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    own = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    a, b = runs[run].astype(np.int64), runs[run + 1].astype(np.int64)
    end, last = b.copy(), len(low) - 1
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        mid = (a + b) >> 1
        less = (a < b) & (low[np.minimum(mid, last)] < own)
        a, b = np.where(less, mid + 1, a), np.where(less, b, np.maximum(mid, a))
    at = np.minimum(a, last)
    hit = (a < end) & (low[at] == own)
    for o, c in zip(out, _decoded(coded, at[hit]), strict=True):
        o[hit] = c
    return out


def _counted(words: list[np.ndarray], n: np.ndarray, k: int):
    """Merge n-grams of order k. Their hashes and counts, their contexts with sums (all, once, twice, more often), the words but the first
    of each, and the numbers for the discounts."""
    places = grams(words)
    key, n, carried = _merged(places[-1][0], n, [*words[1:], places[k - 2][0]])
    one, two, more = (n == 1), (n == 2), (n > 2)
    stats = np.array([*((n == x).sum() for x in (1, 2, 3, 4)), n.sum(), one.sum(), two.sum(), more.sum()], float)
    return key, n, _grouped(carried[-1], n, one, two, more), carried[:-1], stats


class Model:
    """Where the arrays of a trained model are, which there are, and its few numbers."""

    def __init__(self, folder: str, order: int, buckets: int):
        self.folder, self.order, self.buckets = folder, order, buckets
        self.word_buckets = self.whole_buckets = 1
        self.written: dict[str, np.ndarray] = {}
        self.discounts: dict[int, np.ndarray] = {}
        self.tokens = self.vocabulary = self.continuations = 0
        self.base = np.zeros(2, np.int64)

    def words(self, hashes: np.ndarray, columns: int = 0) -> list[np.ndarray]:
        """Numbers of words (one beyond all for a word that the model lacks), and with ``columns`` their training and continuation counts."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, out = np.full(len(distinct), self.base[-1] + 1, np.uint64), np.zeros((columns, len(distinct)))
        cuts = np.searchsorted(_bucket(distinct, self.word_buckets), np.arange(self.word_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            every, own = self._arrays("w", b), distinct[cuts[b] : cuts[b + 1]]
            if every is not None:
                at = np.minimum(np.searchsorted(every[0], own), len(every[0]) - 1)
                hit = np.flatnonzero(every[0][at] == own)
                number[cuts[b] + hit] = self.base[b] + at[hit] + 1
                if columns:
                    out[0, cuts[b] + hit] = _decoded(every[1:], at[hit])[0]
                    out[1, cuts[b] + hit] = _decoded(self._arrays("1", b), at[hit])[0]
        return [number[back], *out[:, back]]

    def add(self, level: str, buckets: list[int], of: int) -> None:
        there = np.zeros(of, bool)
        there[buckets] = True
        self.written[level] = there

    def frequent(self, words: np.ndarray) -> np.ndarray:
        if "frequent" not in self.written:
            return np.zeros(len(words), bool)
        (all_,) = mapped(f"{self.folder}/frequent/00000")
        return all_[np.minimum(np.searchsorted(all_, words), len(all_) - 1)] == words

    def _arrays(self, level: str, bucket: int) -> list[np.ndarray] | None:
        there = self.written.get(level)
        return mapped(f"{self.folder}/{level}/{bucket:05d}") if there is not None and there[bucket] else None

    def lookup(self, level: str, keys: np.ndarray, before: np.ndarray, hot: np.ndarray, columns: int) -> list[np.ndarray]:
        """Values of each key (0 where the model lacks it). ``before``: the next-to-last word of the n-gram, ``hot``: that is frequent.
        Keys are made distinct; only buckets that some of them fall in are touched."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        hot = hot[first]
        bucket = np.where(hot, self.buckets + _bucket(distinct, self.whole_buckets), _by_word(before[first], self.buckets))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        out = np.zeros((columns, len(distinct)))
        cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            b = int(bucket[p])
            arrays = self._arrays(level, b) if b < self.buckets else self._arrays(f"{level}w", b - self.buckets)
            if arrays is not None:
                out[:, order[p:q]] = _found(arrays, distinct[order[p:q]])
        return list(out[:, back])

    def probabilities(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interpolated probability of each token, and its training count."""
        h, count, continued = self.words(h, 2)
        words = [shifted(h, row, k) for k in range(self.order - 1, -1, -1)]
        places, before = grams(words), words[-2]
        p = np.full(len(h), 1.0 / (self.vocabulary + 1))
        hot = self.frequent(before)
        for k in range(1, self.order + 1):
            d = self.discounts[k]
            if k == 1:
                c, total = continued, np.full(len(h), float(self.continuations))
                ones, twos, more = (np.full(len(h), x) for x in self.level_one)
            else:
                c = self.lookup(str(k), places[k - 1][-1], before, hot, 1)[0]
                total, ones, twos, more = self.lookup(f"c{k}", places[k - 2][-2], before, hot, 4)
            cut = d[np.minimum(c, 3).astype(np.int64)]
            free = d[1] * ones + d[2] * twos + d[3] * more
            seen = total > 0
            safe = np.where(seen, total, 1)
            p = np.where(seen, np.maximum(c - cut, 0) / safe + free / safe * p, p)
        return p, count


def _bucket_of(kind: int, columns: list[np.ndarray], model: Model) -> np.ndarray:
    """The bucket of each row of a block's columns (CONTEXT and WORD: hashes, else numbers of words)."""
    if kind == LAST:
        return np.searchsorted(model.base[1:], columns[0].astype(np.int64) - 1, side="right")
    if kind == LOCAL:
        return _by_word(columns[-2], model.buckets)
    if kind == WHOLE:
        return _bucket(grams(columns)[-1][0], model.whole_buckets)
    return _bucket(columns[0], model.whole_buckets if kind == CONTEXT else model.word_buckets)


def _buckets_of(model: Model) -> dict[int, int]:
    return {WHOLE: model.whole_buckets, CONTEXT: model.whole_buckets, LOCAL: model.buckets, WORD: model.word_buckets, LAST: model.word_buckets}


def _settled(rows: DataFrame, model: Model) -> DataFrame:
    """Blocks that each lie in one bucket. Where a kind has more than ``FAN`` buckets, parts are dealt again, ``FAN`` ways a pass, in tasks that
    each take a share of a part, so blocks grow in number with the data and not with its square."""
    buckets = _buckets_of(model)
    parts = FAN
    while parts < max(buckets.values()):
        parts *= FAN
        done, rest = rows.filter("bucket >= 0"), rows.filter("bucket < 0")

        def again(batches: Iterator[pa.RecordBatch], parts: int = parts) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for kind, blocks in held.items():
                    *columns, n = _joined(blocks) if kind in (WHOLE, LOCAL, WORD, LAST) else (*_joined(blocks), None)
                    hashes, numbers = (columns, [n]) if n is not None else (columns[:1], columns[1:])
                    yield _batch(list(_dealt(kind, _bucket_of(kind, hashes, model), hashes, numbers, buckets[kind], parts)))

            for batch in batches:
                for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                    held.setdefault(kind, []).append(block.as_py())
                    size += len(held[kind][-1])
                    if size > 8 * FLUSH_TOKENS:
                        yield from flush()
                        held, size = {}, 0
            yield from flush()

        # Sorted by part, so a task holds few parts at a time and each flush few children of them.
        rest = rest.repartition("kind", "part", F.pmod(F.xxhash64("block"), F.lit(16))).sortWithinPartitions("kind", "part").mapInArrow(again, _BLOCKS)
        rows = done.unionByName(rest)
    return rows


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER) -> Model:
    """Counts ``docs`` and returns the stored model (order 2 or more)."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "ngram")
    # The bytes of text set the number of buckets: it grows with the input, a bucket's task doesn't.
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    model = Model(folder, order, max(4, -(-int(size) // BUCKET_TEXT_BYTES)))
    model.word_buckets = max(1, -(-int(size) // BUCKET_WORD_BYTES))
    fits = np.zeros((order + 1, 8))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch):
                own, times = np.unique(with_ends(piece.column("text"))[0], return_counts=True)
                word, n = np.concatenate((word, own)), np.concatenate((n, times))
                if len(word) > FLUSH_TOKENS:
                    word, n = _grouped(word, n.astype(np.int64))
                    n = n.astype(np.int64)
                    if len(word) > FLUSH_TOKENS // 2:
                        yield _batch(list(_dealt(WORD, _bucket(word, model.word_buckets), [word], [n], model.word_buckets)))
                        word, n = word[:0], n[:0]
        if len(word):
            word, n = _grouped(word, n)
            yield _batch(list(_dealt(WORD, _bucket(word, model.word_buckets), [word], [n], model.word_buckets)))

    texts = docs.select(F.col(text).alias("text"))
    done = _merge(texts.mapInArrow(count_words, _BLOCKS), model, 0, fits)
    # Of each word with more than HOT_TOKENS tokens eight bytes: as many as there are buckets, at most.
    frequent = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r.block), np.uint64) for r in done.filter(f"kind = {FREQUENT}").select("block").toLocalIterator())])
    if len(frequent):
        numbers = model.words(frequent)[0]
        store(f"{folder}/frequent/00000", [np.unique(np.append(numbers, START)) if END in frequent else np.unique(numbers)])
        model.add("frequent", [0], 1)
        model.whole_buckets = model.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the words of distinct n-grams of the top order, with counts."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                rows = np.cumsum([0, *(row[-1] + 1 for _, row in held[:-1])])
                h, row = np.concatenate([h for h, _ in held]), np.concatenate([r + a for (_, r), a in zip(held, rows, strict=True)])
                h = model.words(h)[0]
                words = [shifted(h, row, k) for k in range(order - 1, -1, -1)]
                _, n, words = _merged(grams(words)[-1][0], np.ones(len(h), np.int64), words)
                hot = model.frequent(words[-2])
                for kind, own in ((WHOLE, np.flatnonzero(hot)), (LOCAL, np.flatnonzero(~hot))):
                    if len(own):
                        columns = [w[own] for w in words]
                        yield _batch(list(_dealt(kind, _bucket_of(kind, columns, model), columns, [n[own]], model.whole_buckets if kind == WHOLE else model.buckets)))

        for batch in batches:
            for piece in slices(batch):
                h, row, _ = with_ends(piece.column("text"))
                held.append((h, row))
                size += len(h)
                if size > FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    rows, last = texts.mapInArrow(count, _BLOCKS), []
    for k in range(order, 0, -1):
        if k == 1:
            rows = functools.reduce(DataFrame.unionByName, last, rows)
        done = _merge(rows, model, k, fits)
        rows = done.filter(f"kind in ({WHOLE}, {CONTEXT})")
        last.append(done.filter(f"kind = {LAST}"))
    for k in range(1, order + 1):
        n = fits[k]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        d = [((j + 1 - (j + 2) * y * n[j + 1] / n[j]) if n[j] else 0.0) for j in range(3)]
        model.discounts[k] = np.array([0.0, *(x if 0 < x < j + 1 else f for j, (x, f) in enumerate(zip(d, FALLBACK, strict=True)))])
    model.continuations, model.level_one = float(fits[1][4]), fits[1][5:8]
    return model


def _merge(rows: DataFrame, model: Model, k: int, fits: np.ndarray) -> DataFrame:
    """Merge each bucket's blocks, write its arrays and pass on blocks for the orders below. ``k``: the order of WHOLE blocks; CONTEXT blocks belong to
    order k+1. Adds to ``fits`` and the manifest; returns the new blocks. For k = 0, words are counted and numbered."""
    folder, order, buckets = model.folder, model.order, _buckets_of(model)

    def merge(pairs: pa.Table) -> pa.Table:
        kind, b = pairs.column("kind")[0].as_py(), pairs.column("bucket")[0].as_py()
        columns = _joined([x.as_py() for x in pairs.column("block")])
        out: list[tuple[int, int, int, bytes]] = []
        stats, words = np.zeros((order + 1, 8)), np.zeros(2)

        def last(word: np.ndarray, n: np.ndarray) -> None:
            word, n = _grouped(word, n)
            out.extend(_dealt(LAST, _bucket_of(LAST, [word], model), [word], [n], buckets[LAST]))

        if kind == WORD:
            word, n = _grouped(*columns)
            store(f"{folder}/w/{b:05d}", [word, *_coded([n])])
            words[:] = n.sum(dtype=np.int64), len(word)
            if (n > HOT_TOKENS).any():
                out.append((FREQUENT, b, 0, word[n > HOT_TOKENS].tobytes()))
        elif kind == LOCAL:
            *grams_, n = columns
            for j in range(order, 1, -1):
                key, n, context, grams_, stats[j] = _counted(grams_, n, j)
                store(f"{folder}/{j}/{b:05d}", _table(key, [n]))
                store(f"{folder}/c{j}/{b:05d}", _table(context[0], context[1:]))
                n = np.ones(len(key), np.int64)
            last(grams_[0], n)
        elif kind == WHOLE:
            key, n, context, below, stats[k] = _counted(columns[:-1], columns[-1], k)
            store(f"{folder}/{k}w/{b:05d}", _table(key, [n]))
            out.extend(_dealt(CONTEXT, _bucket_of(CONTEXT, context, model), context[:1], context[1:], buckets[CONTEXT]))
            if k == 2:
                last(below[0], np.ones(len(key), np.int64))
            else:
                _, n, below = _merged(grams(below)[-1][0], np.ones(len(key), np.int64), below)
                out.extend(_dealt(WHOLE, _bucket_of(WHOLE, below, model), below, [n], buckets[WHOLE]))
        elif kind == CONTEXT:
            context = _grouped(*columns)
            store(f"{folder}/c{k + 1}w/{b:05d}", _table(context[0], context[1:]))
        else:
            word, n = _grouped(*columns)
            continued = np.zeros(int(model.base[b + 1] - model.base[b]), np.uint64)
            continued[word.astype(np.int64) - 1 - model.base[b]] = n
            store(f"{folder}/1/{b:05d}", _coded([continued]))
            one, two, more = (n == 1), (n == 2), (n > 2)
            stats[1] = [*((n == x).sum() for x in (1, 2, 3, 4)), n.sum(), one.sum(), two.sum(), more.sum()]
        out.append((NUMBERS, b, kind, np.concatenate((stats.ravel(), words)).tobytes()))
        return pa.Table.from_batches([_batch(out)])

    done = kept(_settled(rows, model).groupBy("kind", "bucket").applyInArrow(merge, _BLOCKS), folder, f"blocks-{k}")
    words, there, sizes = np.zeros(2), {}, np.zeros(buckets[WORD], np.int64)
    for r in done.filter(f"kind = {NUMBERS}").select("bucket", "part", "block").toLocalIterator():  # some numbers a bucket
        own = np.frombuffer(bytes(r.block))
        fits += own[:-2].reshape(fits.shape)
        words += own[-2:]
        sizes[r.bucket if r.part == WORD else 0] += int(own[-1])
        there.setdefault(r.part, []).append(r.bucket)
    names = {LOCAL: [f"{p}{j}" for j in range(order, 1, -1) for p in ("", "c")], WHOLE: [f"{k}w"], CONTEXT: [f"c{k + 1}w"], LAST: ["1"], WORD: ["w"]}
    for kind, own in there.items():
        for name in names[kind]:
            model.add(name, own, buckets[kind])
    if k == 0:
        model.base = np.concatenate(([0], np.cumsum(sizes)))
        model.tokens, model.vocabulary = int(words[0]), int(words[1])
    return done


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a text: doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probabilities)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SCORE_BYTES):
                h, row, counts = with_ends(piece.column("text"))
                p, c = model.probabilities(h, row)
                own = lambda x: np.bincount(row, x, len(counts))
                base = np.log10((c + 1) / (model.tokens + model.vocabulary + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "n_known": pa.array(own(c > 0).astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(counts), model.tokens, np.int64)), "base_score": pa.array(own(base)), "score": pa.array(own(np.log10(p))),
                })

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(measure, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    model = train(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
