"""An inverted-file index of vectors: lists around centroids, of which a query reads the few that lie nearest.

Centroids come from k-means (by cosine) over at most ``SAMPLE`` vectors, drawn by a hash of their keys; every vector of the table is then put into the list of its
nearest centroid, in tasks. Lists are folders of blocks, so a search reads the lists that some query probes and no others, block by block; queries are dealt to tasks. The index is a folder: it can be loaded again and extended with further vectors.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .retrieval import BLOCK

#: Vectors that the centroids are fitted on, at most; and centroids at most.
SAMPLE, MOST_LISTS = 20_000, 4096
ROUNDS = 12


class VectorIndex(NamedTuple):
    folder: str
    centroids: np.ndarray
    kind: str

    def table(self, spark: SparkSession) -> DataFrame:
        """list, ids and unit vectors of each block."""
        return spark.read.schema(f"ids array<{self.kind}>, vectors array<array<double>>, list int").parquet(f"{self.folder}/lists")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by cosine. Starts from vectors far from each other; a centroid that loses its vectors stays where it is."""
    x = _unit(np.asarray(sample, np.float64))
    at, nearest = [0], x @ x[0]
    while len(at) < min(lists, len(x)):
        at.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c[full] = _unit(total[full])
    return c


def _draw(vectors: DataFrame, key: str, n: int, limit: int) -> DataFrame:
    """Rows by a threshold of the hash of their keys, about nine tenths of ``limit`` where there are more. Not the least ones in order: for those each task would hand ``limit`` rows to the driver."""
    if n <= limit:
        return vectors
    return vectors.filter(F.xxhash64(key) < F.lit(-(1 << 63) + int((1 << 64) * (0.9 * limit / n))))


def build_index(vectors: DataFrame, key: str, vector: str, folder: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Fits centroids and puts every vector of other than zero length into a list. By default as many lists as the root of twice the rows, up to ``MOST_LISTS``."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0))
    n = v.count()
    drawn = _draw(v, "id", n, sample).select("id", F.col("v").cast("array<float>").alias("v")).toArrow().sort_by("id")  # about ``sample`` rows at most, as one block of numbers
    drawn = _matrix(drawn.column("v")) if drawn.num_rows else np.zeros((0, 0))
    lists = lists or int(min(MOST_LISTS, max(1, round((2 * n) ** 0.5))))
    centroids = fit_centroids(drawn, lists) if len(drawn) else np.zeros((0, 0))
    index = VectorIndex(folder, centroids, dict(v.dtypes)["id"])
    rows = pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{folder}/centroids")
    spark.range(1).select(F.lit(index.kind).alias("kind")).write.mode("overwrite").parquet(f"{folder}/kind")
    return extend(index, v, "id", "v", mode="overwrite")


def load_index(spark: SparkSession, folder: str) -> VectorIndex:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # at most MOST_LISTS rows
    return VectorIndex(folder, np.array([r.centroid for r in rows]), spark.read.parquet(f"{folder}/kind").first().kind)


def extend(index: VectorIndex, vectors: DataFrame, key: str, vector: str, mode: str = "append") -> VectorIndex:
    """Puts vectors into the lists of their nearest centroids."""
    c = index.centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(c):
                x = _unit(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_pydict({"list": pa.array(np.argmax(x @ c.T, axis=1), pa.int32()), "id": batch.column("id"), "v": _lists(x)})

    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0))
    placed = v.mapInArrow(assign, f"list int, id {index.kind}, v array<double>")
    size = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a list
    blocks = placed.join(size, "list").groupBy("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    blocks.select("list", F.col("x.id").alias("ids"), F.col("x.v").alias("vectors")).write.mode(mode).partitionBy("list").parquet(f"{index.folder}/lists")
    return index


def _chosen(s: np.ndarray, least: int = 24, most: int = 48, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Query rows and lists that ``probes`` takes, by the cosines of queries and centroids."""
    order = np.argsort(-s, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(s, order, 1)
    i, j = np.nonzero((near >= near[:, :1] - margin) | (np.arange(order.shape[1]) < least))
    return i, order[i, j]


def _queries(queries: DataFrame, key: str, vector: str) -> DataFrame:
    return queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.exists("v", lambda x: x != 0))


def probes(index: VectorIndex, queries: DataFrame, key: str, vector: str, **choice) -> DataFrame:
    """query, list, v: of each query the ``least`` (24) nearest lists, and further ones, up to ``most`` (48), whose centroid is nearly as near as the best (by ``margin``, 0.1)."""
    c = index.centroids

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(c):
                x = _unit(_matrix(batch.column("v")))
                i, lists = _chosen(x @ c.T, **choice)
                yield pa.RecordBatch.from_pydict({"query": batch.column("id").take(pa.array(i)), "list": pa.array(lists, pa.int32()), "v": pa.array(list(x[i]), pa.list_(pa.float64()))})

    q = _queries(queries, key, vector)
    return q.mapInArrow(choose, f"query {dict(q.dtypes)['id']}, list int, v array<double>")


def _ranges(index: VectorIndex, spark: SparkSession) -> np.ndarray:
    """Least and greatest angle of each list's vectors to its centroid; an empty list has none (inf, -inf)."""
    c = index.centroids

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                place = batch.column("list")[row].as_py()
                a = np.arccos(np.clip(_matrix(batch.column("vectors")[row].values) @ c[place], -1, 1))
                yield pa.RecordBatch.from_pydict({"list": pa.array([place], pa.int32()), "low": pa.array([a.min()]), "high": pa.array([a.max()])})

    out = np.tile([[np.inf, -np.inf]], (len(c), 1))
    for r in index.table(spark).mapInArrow(angles, "list int, low double, high double").groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # at most MOST_LISTS rows
        out[r["list"]] = r.low, r.high
    return out


#: Radians by which angles may be off (an angle near zero loses half of its cosine's digits).
SLACK = 1e-6
#: Queries in a block, and tasks of a search, at most; bytes of lists that a worker keeps.
QUERIES, TASKS, KEPT_BYTES = 512, 2000, 64 << 20


def _lists(x: np.ndarray) -> pa.Array:
    """Rows as lists of numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _blocks(index: VectorIndex, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """ids and unit vectors of blocks of about ``QUERIES`` queries, as far as possible of such that lie near each other, each block a task (up to ``TASKS``)."""
    c = index.centroids
    q = _queries(queries, key, vector)
    groups = max(1, -(-q.count() // QUERIES))
    areas = c if groups >= len(c) else fit_centroids(c, groups)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(areas):
                x = _unit(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_pydict({"area": pa.array(np.argmax(x @ areas.T, axis=1), pa.int32()), "id": batch.column("id"), "v": _lists(x)})

    placed = q.mapInArrow(assign, f"area int, id {dict(q.dtypes)['id']}, v array<double>")
    size = placed.groupBy("area").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))  # a row an area
    blocks = placed.join(size, "area").groupBy("area", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    return blocks.select(F.col("x.id").alias("ids"), F.col("x.v").alias("vectors")).repartition(min(TASKS, groups))


class _Reader:
    """Lists of an index, read from its folder; the last ones are kept, up to ``KEPT_BYTES``."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.top = fs.FileSystem.from_uri(f"{folder}/lists")
        self.kept: OrderedDict[int, list[tuple[pa.Array, np.ndarray]]] = OrderedDict()

    def blocks(self, place: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """ids and vectors of each block of a list, one after the other; an empty list has none."""
        if place in self.kept:
            self.kept.move_to_end(place)
            yield from self.kept[place]
            return
        from pyarrow import fs, parquet

        files = self.fs.get_file_info(fs.FileSelector(f"{self.top}/list={place}", allow_not_found=True))
        held, size = [], 0
        for f in sorted(x.path for x in files if x.base_name.startswith("part-") and x.path.endswith(".parquet")):
            with self.fs.open_input_file(f) as source:
                for batch in parquet.ParquetFile(source).iter_batches(batch_size=1, columns=["ids", "vectors"]):
                    block = batch.column("ids")[0].values, _matrix(batch.column("vectors")[0].values)
                    size += block[1].nbytes
                    held = [*held, block] if size <= KEPT_BYTES // 4 else []
                    yield block
        if size <= KEPT_BYTES // 4:  # longer lists are read again
            self.kept[place] = held
        while sum(x.nbytes for b in self.kept.values() for _, x in b) > KEPT_BYTES:
            self.kept.popitem(last=False)


class _Best:
    """The k best of each query of a block so far, by similarity (nine digits), then id; those of ``least`` or more."""

    def __init__(self, ids: pa.Array, k: int, least: float):
        self.ids, self.k, self.least = ids, k, least
        self.own = ids.to_numpy(zero_copy_only=False)
        self.s, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), self.own[0], np.int64 if self.own.dtype.kind in "iu" else object)

    @property
    def last(self) -> np.ndarray:
        return self.s[:, -1]

    def add(self, rows: np.ndarray, s: np.ndarray, ids: pa.Array) -> None:
        """Similarities of some queries and the vectors of a block."""
        theirs = ids.to_numpy(zero_copy_only=False)
        if len(at := np.flatnonzero(pc.is_in(ids, self.ids))):  # a vector doesn't find its own key
            s[:, at] = np.where(self.own[rows][:, None] == theirs[at][None, :], -np.inf, s[:, at])
        least = self.last[rows] - 1e-9
        good = s >= np.maximum(least, self.least)[:, None]
        if np.count_nonzero(good) > 4 * self.k * len(rows) and s.shape[1] > self.k:
            good &= s >= np.partition(s, -self.k, axis=1)[:, -self.k][:, None] - 1e-9
        i, j = np.nonzero(good)
        if not len(i):
            return
        touched = np.unique(i)
        row = np.concatenate((np.repeat(touched, self.k), i))
        value = np.concatenate((self.s[rows[touched]].ravel(), s[i, j]))
        name = np.concatenate((self.id[rows[touched]].ravel(), theirs[j]))
        rank = name if name.dtype.kind in "iu" else np.unique(name, return_inverse=True)[1]
        order = np.lexsort((rank, -np.round(value, 9), row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, nth = order[nth < self.k], rows[row[nth < self.k]], nth[nth < self.k]
        self.s[row, nth], self.id[row, nth] = value[order], name[order]

    def rows(self, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        i, j = np.nonzero(self.s >= self.least)
        return pa.RecordBatch.from_pydict({"query": self.ids.take(pa.array(i)).cast(kinds[0]), "id": pa.array(self.id[i, j], kinds[1]), "similarity": pa.array(self.s[i, j])})


def search_index(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, exact: bool = False, least: float = -2.0, **choice) -> DataFrame:
    """query, id, similarity of the k most similar vectors in the probed lists (ties by the smaller id; a vector doesn't find its own key), of those with a similarity of ``least`` or more.

    A task holds a block of queries and the k best of each, and reads the lists that they ask for from the index's folder, one after the other. So neither vectors nor candidates are
    shuffled, and memory is bounded by a block of queries and one of a list, however long the lists are. Queries have a key each.

    With ``exact``, of all vectors: further lists are read, nearest first, as long as one may hold a vector as near as a query's k-th best so far. By the triangle inequality such a
    vector's angle to its centroid differs from the query's by the angle of the k-th at most.
    """
    c = index.centroids
    ranges = _ranges(index, queries.sparkSession) if exact else None
    kinds = tuple(pa.string() if x == "string" else to_arrow_type(StructType.fromDDL(f"x {x}")["x"].dataType) for x in (dict(queries.dtypes)[key], index.kind))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index.folder)
        for batch in batches:
            for r in range(batch.num_rows):
                x, best = _matrix(batch.column("vectors")[r].values), _Best(batch.column("ids")[r].values, k, least)
                s = x @ c.T
                probed = np.zeros(s.shape, bool)
                probed[_chosen(s, **choice)] = True
                order = np.argsort(-s.max(axis=0), kind="stable")

                def read(place: int, rows: np.ndarray, x: np.ndarray = x, best: _Best = best) -> None:
                    if len(rows):
                        for ids, vectors in reader.blocks(place):
                            best.add(rows, x[rows] @ vectors.T, ids)

                for place in order[probed.any(axis=0)[order]].tolist():
                    read(place, np.flatnonzero(probed[:, place]))
                if ranges is not None:
                    angles = np.arccos(np.clip(s, -1, 1))
                    # How far a query must look at least to meet a list; the lists with the least come first.
                    away = np.maximum(ranges[None, :, 0] - angles, angles - ranges[None, :, 1])
                    away[probed] = np.inf
                    for place in np.argsort(away.min(axis=0), kind="stable").tolist():
                        read(place, np.flatnonzero(away[:, place] <= np.arccos(np.clip(np.maximum(best.last, least) - 2e-9, -1, 1)) + SLACK))
                yield best.rows(kinds)

    if not len(c):
        return queries.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[key]}, id {index.kind}, similarity double")
    return _blocks(index, queries, key, vector).mapInArrow(search, f"query {dict(queries.dtypes)[key]}, id {index.kind}, similarity double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: wanted (rows of ``exact``), found (those that ``found`` has) and recall."""
    hit = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
