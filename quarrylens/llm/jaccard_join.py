"""N-gram Jaccard self-join with Bayesian candidate pruning.

A text is the set of its five-word shingles (ASCII-lowered words; a text of fewer words, but not none,
has one shingle). Equal sets are one class; from there on classes stand for their documents.

1. 96 MinHash values of 16 bits a class. Bands of four values propose candidates: a pair at the threshold 0.8 is
   proposed by at least one of 24 bands with probability 1 - 3e-6, more similar ones more surely.
2. Within a bucket, pairs are compared on their MinHash values in steps of 16. After each step the
   posterior of the Jaccard similarity (uniform prior; Beta(m+1, n-m+1) after m matches of n) gives the
   probability that the threshold is reached; a pair whose probability falls below ``TOLERANCE`` is dropped for good.
3. Classes that are left in some pair have their shingle sets written once, in files of the shared folder
   (classes that pairs connect lie together). The buckets are then gone through again, and every surviving pair is verified exactly
   on its two sets, in the first band that both share, so once. Pairs that the pruning dropped are never verified.

Buckets of more than ``BLOCK`` members are cut into blocks, and each pair of blocks is one row of signatures:
memory is bounded, pairs exist only inside arrays, shingle sets are mapped from their files and never copied per block, and what leaves a task is one
row a member (its count of links) and a spanning forest, never the pairs of a group.

Defined cases: null texts and texts without words have no shingles, link to nothing and are a class each
(by themselves). Repeated rows are members of one class and count as links of each other. Further
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN, fresh, kept, mapped, mix, row_hash, shared_folder, slices, store, table, tokenise, tuned, windows
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
#: Members whose pairs are compared at once, about, and bytes of a file of sets.
GROUP_ROWS, FILE_BYTES = 20_000, 32 << 20
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = tokenise(texts, PLAIN)
    counts = t.counts()
    h, at = windows(t.hash, t.row, SHINGLE)
    row = t.row[at]
    ends = np.searchsorted(row, np.arange(len(counts) + 1))
    base = np.concatenate(([0], np.cumsum(counts)))
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            yield np.unique(h[ends[i] : ends[i + 1]])
        elif n:
            acc = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in t.hash[base[i] : base[i + 1]]:
                    acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
            yield mix(np.array([acc], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[i : i + 4096, None] * _A).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        for piece in slices(batch):
            digest, sign, size = [], [], []
            for s in shingle_sets(piece.column("text")):
                if not len(s):
                    digest.append(None), sign.append(None), size.append(0)
                    continue
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                sign.append(_signature(s).astype("<u2").tobytes())
                size.append(len(s))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "text_hash": piece.column("text_hash"), "digest": pa.array(digest, pa.binary()), "sign": pa.array(sign, pa.binary()), "size": pa.array(size, pa.int64())})


def keep_least(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): the smallest m whose posterior P(J >= threshold) isn't below the tolerance.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose tail at t is the chance of at most m of n+1 coins of weight t.
    """
    out = []
    for k in range(step, n + 1, step):
        tail = np.cumsum([comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(k + 1)])
        out.append((k, int(np.argmax(tail >= tolerance))))
    return out


_STEPS = keep_least()


def surviving(sign: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of signature rows that no step drops."""
    match = np.zeros(len(i), np.int32)
    done = 0
    for upto, least in _STEPS:
        match += (sign[i, done:upto] == sign[j, done:upto]).sum(axis=1, dtype=np.int32)
        go = match >= least
        i, j, match, done = i[go], j[go], match[go], upto
    return i, j


def _pairs(group: np.ndarray, block: np.ndarray, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same group, a distance at a time; in a group of two blocks only those across."""
    for k in range(1, len(group)):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            return
        yield (x := i[~across[i] | (block[i] != block[i + k])]), x + k


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs connect it with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _edges(cls: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component: as connected as all its pairs, in as many rows as it has members."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return cls[label[at]], cls[at]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows with one or two blocks of members (lists ``x`` and ``y``): the members' columns, the row and the block of each member and whether the
    row has two blocks. Many small rows come at once."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("x")), 0)) + np.asarray(pc.fill_null(pc.list_value_length(batch.column("y")), 0))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP_ROWS, prepend=0))
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        piece = batch.slice(a, b - a)
        if not piece.num_rows:
            continue
        x, y = piece.column("x"), piece.column("y")
        members = pa.concat_arrays([pc.list_flatten(x), pc.list_flatten(y)])
        group = np.concatenate((np.asarray(pc.list_parent_indices(x)), np.asarray(pc.list_parent_indices(y)))).astype(np.int64)
        block = np.repeat([0, 1], [len(group) - len(pc.list_flatten(y)), len(pc.list_flatten(y))])
        order = np.argsort(group, kind="stable")
        across = np.asarray(pc.is_valid(y))
        own = {f.name: members.field(k).take(pa.array(order)) for k, f in enumerate(members.type)}
        columns = {n: np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(len(c), -1) if n == "sign" else np.asarray(c) for n, c in own.items()}
        yield columns, group[order], block[order], across[group[order]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that pruning leaves."""
    for batch in batches:
        for c, group, block, across in _groups(batch):
            label = np.arange(len(group))
            for i, j in _pairs(group, block, across):
                i, j = surviving(c["sign"], i, j)
                if len(i):
                    label = _least(len(group), np.concatenate((np.arange(len(group)), i)), np.concatenate((label, j)))
            a, b = _edges(c["cls"], label)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, by blocks of the dense value-by-set matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    pool, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(pool), 4096):
        a, b = np.searchsorted(code, (at, at + 4096))
        m = np.zeros((len(sets), min(4096, len(pool) - at)), np.float32)
        m[owner[a:b], code[a:b] - at] = 1
        common += m @ m.T
    return common


def _verify(folder: str):
    """Exact similarity of the pairs that pruning leaves, in the first band that both have: a row a member with its links, and the rows of a spanning
    forest (no links)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, group, block, across in _groups(batch):
                cls, members, n = c["cls"], c["members"], len(group)
                bands = c["sign"].view("<u8")  # four values of 16 bits
                own, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j in _pairs(group, block, across):
                    i, j = surviving(c["sign"], i, j)
                    first = (bands[i] == bands[j]).argmax(axis=1) == c["band_no"][i] if len(i) else np.zeros(0, bool)
                    own.append(i[first])
                    other.append(j[first])
                i, j = np.concatenate(own), np.concatenate(other)
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                similar = np.zeros(len(i), bool)
                # The pairs of a row of ``batch`` are consecutive now.
                cuts = [*np.flatnonzero(np.diff(group[i], prepend=-1)).tolist(), len(i)]
                for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                    used, back = np.unique(np.concatenate((i[p:q], j[p:q])), return_inverse=True)
                    sets = [_stored_set(folder, int(c["file"][k]), int(c["at"][k])) for k in used]
                    size = np.array([len(x) for x in sets])
                    x, y = back[: q - p], back[q - p :]
                    if q - p > 2 * len(used):
                        common = overlaps(sets)[x, y]
                    else:
                        common = np.array([len(np.intersect1d(sets[g], sets[h], assume_unique=True)) for g, h in zip(x.tolist(), y.tolist(), strict=True)])
                    similar[p:q] = common >= THRESHOLD * (size[x] + size[y] - common) - 1e-4
                i, j = i[similar], j[similar]
                links = np.bincount(i, members[j], n).astype(np.int64) + np.bincount(j, members[i], n).astype(np.int64)
                x, y = _edges(cls, _least(n, i, j))
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate((cls[at], x))), "b": pa.array(np.concatenate((cls[at], y))), "links": pa.array(np.concatenate((links[at], np.zeros(len(x), np.int64))))})

    return verify


def _stored_set(folder: str, file: int, at: int) -> np.ndarray:
    ends, values = mapped(f"{folder}/sets/{file:06d}")
    return values[int(ends[at]) : int(ends[at + 1])]


def _store_sets(folder: str):
    """Write the sets of a partition, sorted by component and class, as one file: where each begins, and all values. Yields class, file, place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        cls, sets = [], []
        for batch in batches:
            for c, x in zip(batch.column("cls").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if not cls or c != cls[-1]:  # equal rows of a table have equal sets
                    cls.append(c)
                    sets.append(np.frombuffer(x, np.uint64))
        if cls:
            store(f"{folder}/sets/{file:06d}", [np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64), np.concatenate(sets)])
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "file": pa.array(np.full(len(cls), file, np.int32)), "at": pa.array(np.arange(len(cls), dtype=np.int32))})

    return write


def _in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``: band, n (members of that bucket), cls, and ``columns``. One row a bucket, or, in larger ones, one for each block and each pair of blocks:
    x, y (lists of members; y null within a block). A list has about ``BLOCK`` members, so no bucket is collected whole."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.select("band", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("blk"), F.struct("cls", *columns).alias("member"))
    lists = rows.groupBy("band", "blocks", "blk").agg(F.collect_list("member").alias("x"))
    inside = lists.select("x", F.lit(None).cast(dict(lists.dtypes)["x"]).alias("y"))
    some = lists.filter("blocks > 1")
    low = some.filter("blk < blocks - 1").select("band", "x", F.explode(F.sequence(F.col("blk") + 1, F.col("blocks") - 1)).alias("blk"))
    return inside.unionByName(low.join(some.select("band", "blk", F.col("x").alias("y")), ["band", "blk"]).select("x", "y"))


def similarity_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash, class_id (least id of its class; its own without words), group_id (least class
    of those that links join), n_links (other documents with a similarity of at least the threshold)."""
    spark = tuned(docs.sparkSession)
    folder = shared_folder(spark, "jaccard")
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    f = kept(d.mapInArrow(_features, "doc_id long, text_hash long, digest binary, sign binary, size long"), folder, "features")

    # A class is known by the least (id, text) of its documents, and numbered when it is written (hashes of many classes would collide).
    classes = f.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "doc_id", "text_hash", "sign", "size")).alias("r"), F.count("*").alias("members"))
    classes = kept(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "r.doc_id", "r.text_hash", "r.sign", "r.size", "members"), folder, "classes")

    # Buckets of at least two classes; only their rows get a signature.
    banded = classes.select("cls", F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.substring("sign", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)))).alias("band_no", "band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    rows = kept(banded.join(sizes, "band"), folder, "buckets").join(classes.select("cls", "sign", "members", "size", "doc_id", "text_hash"), "cls")
    near = _in_blocks(rows, "sign").mapInArrow(_candidates, "a long, b long").distinct()
    member = kept(components(near, folder, "candidates"), folder, "members")

    # Shingle sets of the classes that are left in a pair, once each, those of a component together.
    wanted = kept(member.select(F.col("node").alias("cls"), "component").join(classes.select("cls", "doc_id", "text_hash", "size"), "cls"), folder, "wanted")
    files = max(1, -(-8 * (wanted.agg(F.sum("size")).first()[0] or 0) // FILE_BYTES))
    own = wanted.select("cls", "component", F.col("doc_id").alias("w_doc"), F.col("text_hash").alias("w_hash"))
    # Never broadcast, however few they are today: they grow with the documents.
    found = d.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_hash") == F.col("w_hash"))).select("cls", "component", "text")
    found = found.mapInArrow(_with_shingles, "cls long, component long, shingles binary").repartitionByRange(files, "component", "cls").sortWithinPartitions("component", "cls")
    places = kept(found.mapInArrow(_store_sets(folder), "cls long, file int, at int"), folder, "places")
    exact = _in_blocks(rows.join(places, "cls"), "band_no", "sign", "members", "file", "at").mapInArrow(_verify(folder), "a long, b long, links long")
    exact = kept(exact, folder, "exact")
    links = exact.filter("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    group = components(exact.filter("links = 0").select("a", "b"), folder, "groups")

    named = classes.select("cls", "digest", F.col("doc_id").alias("class_id"), "members")
    least = group.join(named.select(F.col("cls").alias("node"), "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("group_id"))
    group = group.join(least, "component").select(F.col("node").alias("cls"), "group_id", F.col("component").alias("group"))
    named = named.join(links, "cls", "left").join(group, "cls", "left")
    named = named.select("digest", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("group", "cls").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    return f.select("doc_id", "text_hash", "digest").join(named, "digest", "left").select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document of least id (then least text hash), once; of rows with that id and text the one whose columns
    together have the least hash. Texts without words are no copies of each other and stay, but of rows with equal id and text one is left."""
    rows = kept(similarity_classes(docs, key=key, text=text), shared_folder(docs.sparkSession, "one"), "rows")
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")
    one = rows.filter("group is not null").groupBy("group").agg(F.min(first).alias("r")).select("r.doc_id", "r.text_hash")
    one = one.unionByName(rows.filter("group is null").select("doc_id", "text_hash").distinct())
    # The names of added columns must be none of the table's.
    own_hash, own_row, w_id, w_hash, w_row = fresh(docs, "text_hash", "row_hash", "one_id", "one_hash", "one_row")
    hashed = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(own_row, row_hash(docs))
    one = one.toDF(w_id, w_hash)
    same = F.col(key).eqNullSafe(F.col(w_id)) & (F.col(own_hash) == F.col(w_hash))
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return hashed.join(one, same, "left_semi").drop(own_hash, own_row)
    least = hashed.groupBy(F.col(key).alias(w_id), F.col(own_hash).alias(w_hash)).agg(F.min(own_row).alias(w_row)).join(one.toDF("a", "b"), F.col(w_id).eqNullSafe(F.col("a")) & (F.col(w_hash) == F.col("b")), "left_semi")
    # What is left of equal id, text and row hash are equal rows.
    return hashed.join(least, same & (F.col(own_row) == F.col(w_row)), "left_semi").dropDuplicates([key, own_hash, own_row]).drop(own_hash, own_row)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            sets = [s.tobytes() for s in shingle_sets(piece.column("text"))]
            yield pa.RecordBatch.from_pydict({n: piece.column(n) for n in ("cls", "component")} | {"shingles": pa.array(sets, pa.binary())})


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS low FROM c GROUP BY a),
q AS (SELECT a, count(*) AS links, min(CASE WHEN same THEN b END) AS twin FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, least(doc_id, coalesce(low, doc_id)) AS group_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN q ON q.a = doc_id LEFT JOIN m ON m.a = doc_id
"""
