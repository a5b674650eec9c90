"""What the operators share: vectorised words and hashes over Arrow strings, packed arrays, scratch tables.

Texts are worked on as UTF-8 bytes, many documents at a time. All white space and
ASCII classes used by the operators are single bytes, so words found in bytes are the
words found in characters.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers of the two independent polynomial hashes (arbitrary odd constants).
MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 1 << 19
#: Values that are hashed at once; the tables of powers are about as long.
BLOCK = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_POW: dict[int, np.ndarray] = {}


def powers(mult: int, n: int) -> np.ndarray:
    """mult**0 .. mult**(n-1), modulo 2**64."""
    have = _POW.get(mult)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        full = np.full(size, mult, U64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 21:
            _POW[mult] = have
    return have[:n]


def inverse(mult: int) -> int:
    return pow(mult, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def xxhash64(v: np.ndarray) -> np.ndarray:
    """Spark's xxhash64() of a long column, as signed integers."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    k = v.astype(np.int64).view(U64) * p2
    k = ((k << U64(31)) | (k >> U64(33))) * p1
    h = (U64(42) + p5 + U64(8)) ^ k
    h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    return (h ^ (h >> U64(32))).view(np.int64)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int, add: int = 0) -> np.ndarray:
    """Hash of values[s:e] + add for each s, e (both ascending), by differences of a running polynomial sum over blocks of values."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        n = int(ends[j - 1]) - lo
        v = values[lo : lo + n].astype(U64)
        if add:
            v += U64(add)
        v *= powers(mult, n)
        run = np.zeros(n + 1, U64)
        np.cumsum(v, out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (run[e] - run[s]) * powers(inverse(mult), n + 1)[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of a chunk of documents: byte ranges, and first[i]:first[i+1] are those of document i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, k: int = 0) -> np.ndarray:
        return range_hash(self.data, self.starts, self.ends, MULT[k], add=1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes for which is_word holds; a document's end ends a word."""
    n = len(data)
    on = is_word[data]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = on[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        before[heads] = False
    starts = np.flatnonzero(on & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = on[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
    ends = np.flatnonzero(on & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size consecutive words of one document, and the index of each one's first word."""
    n = len(hashes)
    if n < size:
        return np.empty(0, U64), np.empty(0, np.int64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(room >= size)
    return range_hash(hashes, at, at + size, mult), at


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    lo = int(offsets[0]) if n else 0
    hi = int(offsets[-1]) if n else 0
    body = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.empty(0, np.uint8)
    return body, offsets - lo


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts documents into chunks of about limit bytes: (first row, end row, bytes, offsets). A longer text is a chunk of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as int64; a null id is the largest integer, so it comes last in every order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def is_null(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, or with underscores before it the first name that no column has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


_Z: dict[str, object] = {}


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: high planes of small numbers cost nothing."""
    z = _Z.setdefault("c", zstandard.ZstdCompressor(level=1, write_content_size=True))
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return z.compress(np.ascontiguousarray(planes).tobytes()) if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.empty(0, dtype)
    z = _Z.setdefault("d", zstandard.ZstdDecompressor())
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(z.decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """For ascending unsigned integers: differences, packed."""
    return pack(np.diff(a, prepend=a.dtype.type(0))) if len(a) else b""


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, .. for counts[i] places, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """For ascending keys in 0..n-1: the n+1 bounds of each key's run."""
    return np.searchsorted(keys, np.arange(n + 1))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), in one that is this application's own.

    Only on one machine, where that is unset as in tests, a folder beside the warehouse serves.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{top.rstrip('/')}/stanchion/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that keep() has made in this application: call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by keep() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if files and "/stanchion/" in files[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is handed at once, and what a scan holds of whole texts; for the rest of the session. Texts of
    a thousand rows suffice to work in arrays, and arrays of many megabytes in the JVM make its heap grow to the limit."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def release() -> None:
    """Gives freed memory back to the system; workers and the driver live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """run over batches, and then release()."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
