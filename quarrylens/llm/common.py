"""What the operators share: vectorised word hashing inside Arrow batches, the shared folder, and sessions settings.

Texts reach Python only as Arrow batches inside Spark tasks. A batch is cut into slices of about
``SLICE_BYTES`` so that the working memory of a task is a small multiple of that (or of the longest
single text), whatever the table holds.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1024

_MULT = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = _lowered()
#: Words are runs of anything but ASCII white space.
PLAIN = ~_SPACE
#: Words are runs of ASCII letters, digits and every code point above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection, so it adds no collisions)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BASE = 0xB5297A4D3F84D5B5
#: Bytes of a word that the table below covers; longer words take a cryptographic hash.
_PLACES = 64
#: A random value for each byte at each place of a word. A word's hash is their sum, so two words collide with
#: probability 2**-64 whatever they look like (a polynomial modulo 2**64 has words that collide for any base).
_TABLE = {False: mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(_MULT)).reshape(_PLACES, 256)}
_TABLE[True] = _TABLE[False][:, LOWER]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of ascending, disjoint, non-empty spans of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    index = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    index[start] = start
    np.maximum.accumulate(index, out=index)
    np.subtract(np.arange(n, dtype=index.dtype), index, out=index)
    np.minimum(index, _PLACES - 1, out=index)
    index <<= 8
    index |= data
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[lower].ravel()[index], out=total[1:])
    h = mix(total[end] - total[start])
    long = np.flatnonzero(end - start > _PLACES)
    if len(long):
        whole = (LOWER[data] if lower else data).tobytes()
        h[long] = np.frombuffer(b"".join(blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64)
    return h


class Tokens(NamedTuple):
    """Words of some texts: hash, row of the text, first and past-the-end byte in ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    lower: bool

    def prefix(self, chars: int) -> np.ndarray:
        """Hashes of the words' first code points (of the whole word where it has no more)."""
        begins = np.flatnonzero((self.data & 0xC0) != 0x80)
        nth = np.searchsorted(begins, self.start) + chars
        end = np.minimum(self.end, np.where(nth < len(begins), begins[np.minimum(nth, len(begins) - 1)], len(self.data))) if len(begins) else self.end
        return hash_spans(self.data, self.start, end, self.lower)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len+1 offsets; null texts are empty."""
    texts = pa.chunked_array([texts]).combine_chunks() if not isinstance(texts, pa.Array) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def tokenise(texts: pa.Array, member: np.ndarray = PLAIN, lower: bool = True) -> Tokens:
    """Words of each text with a 64-bit hash of their bytes; all work is on whole byte arrays."""
    data, off = raw_bytes(texts)
    n = len(data)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return Tokens(hash_spans(data, start, end, lower), row, start, end, data, off, lower)


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each run of ``size`` words that lies in one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    acc = np.zeros(len(at), np.uint64)
    for k in range(size):
        acc = acc * np.uint64(_BASE) + h[at + k]
    return mix(acc), at


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece have about ``limit`` bytes (a longer text stays whole)."""
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) if batch.num_rows else []
    at, total = 0, 0
    for i, x in enumerate(size):
        if total + x > limit and i > at:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += x
    if batch.num_rows > at:
        yield batch.slice(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to be none of the table's."""
    there, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        out.append(n)
    return out


def apart(names: tuple[str, ...] | list[str], own: tuple[str, ...]) -> list[str]:
    """Names for carried columns: one that an operator's own column has gets underscores before it."""
    there, out = {c.lower() for c in own}, []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        there.add(n.lower())
        out.append(n)
    return out


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; a null counts as itself wherever it stands."""
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*plain, *(x.isNull() for x in plain))


def running_before(df: DataFrame, keys: tuple[str, ...], order: str, value: str, name: str, step: int = 1024) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys with a lesser ``order`` (a long, distinct within the keys). In two levels, so
    that one task sorts ``step`` rows, or one row for each ``step`` of them."""
    from pyspark.sql import Window

    top, prior, *mine = fresh(df, "top", "prior", *(f"key{i}" for i in range(len(keys))), "its_top")
    df = df.withColumn(top, F.floor(F.col(order) / step))
    sums = df.groupBy(*keys, top).agg(F.sum(value).alias(prior))
    sums = sums.withColumn(prior, F.sum(prior).over(Window.partitionBy(*keys).orderBy(top)) - F.col(prior)).toDF(*mine, prior)
    within = F.sum(value).over(Window.partitionBy(*keys, top).orderBy(order)) - F.col(value)
    same = F.lit(True)
    for a, b in zip((*keys, top), mine, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return df.withColumn(name, within).join(sums, same).withColumn(name, F.col(name) + F.col(prior)).drop(top, prior, *mine)


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that rows with long texts don't pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, m: int) -> Column:
    """crc32 of the key as text, modulo m (null counts as the empty text)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def bounded_sample(df: DataFrame, draw: str, limit: int, *ties: str):
    """The ``limit`` rows of least ``draw`` (a 64-bit hash), as pandas. Only about that many rows leave the tasks:
    a threshold on the hash, from the number of rows, comes before the exact cut."""
    n = df.count()
    if n > 2 * limit:
        df = df.filter(F.col(draw) < F.lit(-(1 << 63) + int((1 << 64) * (1.2 * limit / n + 200 / n))))
    return df.orderBy(draw, *ties).limit(limit).toPandas()


# --- the shared folder -------------------------------------------------------------------------


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. A path without a scheme is one of Hadoop's default file system, as it is for checkpoints.
    Where the setting is unset, a local folder in local mode; an error elsewhere."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    if "://" not in top:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        top = re.sub("^file:/(?!/)", "file:///", path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no earlier stage."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store(uri: str, parts: list[np.ndarray]) -> None:
    """Write arrays as one file: a header line of dtypes and lengths, then raw values; a retry replaces it whole."""
    fs_, path = filesystem(uri)
    fs_.create_dir(os.path.dirname(path), recursive=True)
    head = (";".join(f"{p.dtype.str},{len(p)}" for p in parts)).encode()
    head = head.ljust(-(-(len(head) + 1) // 64) * 64 - 1) + b"\n"
    own = f"{path}.{uuid.uuid4().hex}"
    with fs_.open_output_stream(own) as out:
        out.write(head)
        for p in parts:
            out.write(np.ascontiguousarray(p).tobytes().ljust(-(-p.nbytes // 64) * 64, b"\0"))
    fs_.move(own, path)


#: Files that a worker keeps open at once, and bytes that it keeps of files it can't map.
MAPPED_FILES, FETCHED_BYTES = 4096, 128 << 20
_mapped: OrderedDict[str, tuple[list[np.ndarray], int]] = OrderedDict()


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of ``store``, memory-mapped (read into memory where the folder isn't mounted). A missing file is an error:
    callers know from a manifest what was written. The least recently used files are let go."""
    if uri in _mapped:
        _mapped.move_to_end(uri)
        return _mapped[uri][0]
    from pyarrow import fs

    fs_, path = filesystem(uri)
    if fs_.get_file_info(path).type != fs.FileType.File:
        raise FileNotFoundError(f"{uri} was written and is gone")
    fetched = 0
    if isinstance(fs_, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs_.open_input_file(path) as source:
            raw = np.frombuffer(source.read(), np.uint8)
        fetched = len(raw)
    stop = int(np.flatnonzero(raw[:4096] == 10)[0])
    at, parts = stop + 1, []
    for spec in bytes(raw[:stop]).decode().strip().split(";"):
        kind, n = spec.split(",")
        size = int(n) * np.dtype(kind).itemsize
        parts.append(raw[at : at + size].view(kind))
        at += -(-size // 64) * 64
    _mapped[uri] = parts, fetched
    while len(_mapped) > MAPPED_FILES or (len(_mapped) > 1 and sum(n for _, n in _mapped.values()) > FETCHED_BYTES):
        _mapped.popitem(last=False)
    return parts
