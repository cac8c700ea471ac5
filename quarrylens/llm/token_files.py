"""Token-ID output: Parquet files with a list column of token ids.

Documents are range-partitioned by id, tokenised inside the tasks and written by the task that holds
them, one file a partition, in ascending order. Row groups hold ``GROUP_TOKENS`` ids or fewer (a longer
document has a group of its own), so a reader can fetch the ids of few documents; page indexes and
statistics on doc_id let it skip the rest, and metadata columns lie apart from the ids. Ids are uint16
where the vocabulary allows, dictionary-encoded while the dictionary pays and plain beyond; positions
and lengths are delta-encoded. A retried task replaces its file as a whole.

The tokenizer splits at white space before any merge and drops it, so a text's ids are those of its
white-space-separated pieces in turn: pieces are encoded once for a slice and their ids gathered by
array. Special tokens' strings within texts are ordinary text.

Reading: ``token_table`` opens the files as a table for Spark's reader, which takes only the columns asked for, and by statistics and page
indexes only the row groups and pages that a filter on doc_id (or metadata) leaves; ``fetch`` does so for given documents.

Defined cases: a null or empty text has the end id only. Rows with equal ids lie side by side in the
order of a hash of their texts, by which a repeated or null id is also split among files. A null id sorts first. An empty table makes one file
without rows. Further columns can be written beside the ids (``metadata``), under their names, or with an underscore before one that the
files or ``read_tokens`` use themselves (``RESERVED``); others are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import PLAIN, apart, filesystem, shared_folder, slices, table, tokenise, tuned

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
GROUP_TOKENS = 1 << 20
FILE_TEXT_BYTES = 32 << 20
CACHE_PIECES = 3_000_000
#: Names of columns of the files and of what is read back from them.
RESERVED = ("doc_id", "first", "n_tokens", "ids", "start", "ids_crc32")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Ids of texts through the ids of their pieces. Pieces that this worker has seen are kept in sorted arrays, about 20 bytes each, up to a bound."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        size, ids = [], []
        for at in range(0, len(pieces), 4096):
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False):
                own = e.ids
                size.append(len(own))
                ids += own
        size = np.array(size, np.int32)
        begin = len(self.flat) + np.cumsum(size, dtype=np.int32) - size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.flat = np.concatenate((self.flat, np.array(ids, self.kind)))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by the end id, and the number of ids of each text."""
        t = tokenise(texts, PLAIN, lower=False)
        counts = t.counts()
        keys, first, code = np.unique(t.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            whole = t.data.tobytes()
            self._learn(keys[new], [whole[a:b].decode() for a, b in zip(t.start[first[new]].tolist(), t.end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        # The end of a text is one more piece, which lies before all others.
        flat = np.concatenate((np.array([end_id], self.kind), self.flat))
        begin, size = np.concatenate(([0], self.begin[at] + 1)).astype(np.int32), np.concatenate(([1], self.size[at])).astype(np.int32)
        row = np.zeros(len(code) + len(counts), np.int32)
        ends = np.cumsum(counts + 1) - 1
        inside = np.ones(len(row), bool)
        inside[ends] = False
        row[inside] = code + 1
        lengths = size[row]
        upto = np.cumsum(lengths, dtype=np.int64)
        index = np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)
        index += np.repeat(begin[row] - (upto - lengths).astype(np.int32), lengths)
        total = np.diff(upto[ends], prepend=0) if len(ends) else np.zeros(0, np.int64)
        return flat[index], total


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns a row a file: file, part, n_docs, n_tokens."""
    spark = tuned(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // FILE_TEXT_BYTES), 2 * spark.sparkContext.defaultParallelism if size > FILE_TEXT_BYTES else 1)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(metadata)))
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by, "text")
    names = {f"m{i}": m for i, m in enumerate(apart(metadata, RESERVED))}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(path), TaskContext.get().partitionId()
        fs, top = filesystem(folder)
        writer = out = None
        n_docs = n_tokens = 0
        own, target = f"{top}/.{part:06d}-{uuid.uuid4().hex}", f"{top}/part-{part:06d}.parquet"
        for batch in batches:
            for piece in slices(batch, limit=1 << 20):
                ids, counts = encoder.encode(piece.column("text"), end_id)
                ends = np.concatenate(([0], np.cumsum(counts)))
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids))
                columns = {"doc_id": piece.column("doc_id"), "first": pa.array(n_tokens + ends[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": lists}
                columns |= {names[n]: piece.column(n) for n in piece.schema.names if n in names}
                t = pa.table(columns)
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = _writer(out, t.schema, list(names.values()))
                at = 0
                while at < t.num_rows:
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_TOKENS, side="right")) - 1)
                    writer.write_table(t.slice(at, stop - at), row_group_size=stop - at)
                    at = stop
                n_docs += t.num_rows
                n_tokens += int(ends[-1])
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, target)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/part-{part:06d}.parquet"], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    done = rows.mapInArrow(write, "file string, part int, n_docs long, n_tokens long")
    done.write.mode("overwrite").parquet(f"{folder}.files")
    files = spark.read.parquet(f"{folder}.files")
    if not files.isEmpty():
        return files
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_list(pa.from_numpy_dtype(_encoder(path).kind))), *((m, to_arrow_type(rows.schema[n].dataType)) for n, m in names.items())])
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/part-000000.parquet") as out:
        _writer(out, schema, list(names.values())).close()
    return spark.createDataFrame([(f"{folder}/part-000000.parquet", 0, 0, 0)], files.schema)


def _writer(out, schema: pa.Schema, metadata: list[str]) -> pq.ParquetWriter:
    """Dictionary codes for ids and metadata, deltas for positions and lengths, a page index over pages of 128 KB."""
    return pq.ParquetWriter(out, schema, compression="zstd", compression_level=1, use_dictionary=["ids.list.element", *metadata], column_encoding={"first": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, write_page_index=True, dictionary_pagesize_limit=1 << 18, data_page_size=1 << 17)


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a table: doc_id, first (place of the first id within its file), n_tokens, ids and the metadata columns. Spark reads only the
    columns used, and skips row groups and pages by a filter on doc_id."""
    return spark.read.parquet(f"{folder}/part-*.parquet")


def fetch(spark: SparkSession, folder: str, ids: list, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and ``columns`` of the given documents (a list that a user asks for), reading only the row groups and pages that can hold them."""
    wanted = F.lit(False)
    for i in sorted({x for x in ids if x is not None}):
        wanted = wanted | (F.col("doc_id") == i)
    return token_table(spark, folder).filter(wanted | F.col("doc_id").isNull() if None in ids else wanted).select("doc_id", *columns)


def read_tokens(spark: SparkSession, files: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Digests read back from the files: doc_id, start, n_tokens, ids_crc32 and the given further columns.

    A task reads the row groups of a file one by one. ``start`` adds the tokens of all files before.
    """
    before = (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before")  # a row a file
    listed = files.select("file", before)
    parts = files.count()
    first = files.limit(1).select("file").collect()
    columns = tuple(apart(columns, RESERVED))
    fs, path = filesystem(first[0][0])
    with fs.open_input_file(path) as f:
        arrow = pq.ParquetFile(f).schema_arrow
    from pyspark.sql.pandas.types import from_arrow_schema

    kinds = {f.name: f.dataType for f in from_arrow_schema(pa.schema([arrow.field(c) for c in ("doc_id", *columns)]))}
    schema = StructType([StructField("doc_id", kinds["doc_id"]), *(StructField(x, from_arrow_schema(pa.schema([(x, pa.int64())]))[0].dataType) for x in ("start", "n_tokens", "ids_crc32")), *(StructField(c, kinds[c]) for c in columns)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    source = pq.ParquetFile(f)
                    for g in range(source.num_row_groups):
                        t = source.read_row_group(g, columns=["doc_id", "first", "n_tokens", "ids", *columns]).combine_chunks()
                        lists = t.column("ids").chunk(0)
                        ends = np.asarray(lists.offsets)
                        ids = np.asarray(lists.values).astype("<u4")
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                        out = {"doc_id": t.column("doc_id").chunk(0), "start": pc.add(t.column("first").chunk(0), offset), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                        yield pa.RecordBatch.from_pydict(out | {c: t.column(c).chunk(0) for c in columns})

    return listed.repartition(parts).mapInArrow(read, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), folder))
