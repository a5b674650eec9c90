"""Exact counts of 64-bit keys over a table: summed per flush of a task, packed by hash bucket, merged by streaming tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import U64, cuts, keep, pack, pack_sorted, parts, trimmed, unpack, unpack_sorted

FLUSH = 1_500_000
KIND = "bucket int, n long, keys binary, counts binary"
_NAMES = ["bucket", "n", "keys", "counts"]
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
#: Keys are spread over 64 bits by this before they are cut into buckets; the inverse gives them back.
_SPREAD = 0x9E6C63D0876A9A47
_BACK = pow(_SPREAD, -1, 1 << 64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys, and the sums of their rows of counts."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(counts[order], heads, axis=0)


def _rows(keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    c = cuts((keys >> U64(32)) * U64(n_buckets) >> U64(32), n_buckets)
    rows = [(b, int(e - s), pack_sorted(keys[s:e]), b"".join(_sized(counts[s:e, k]) for k in range(counts.shape[1]))) for b, s, e in zip(range(n_buckets), c, c[1:]) if e > s]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)


def _sized(a: np.ndarray) -> bytes:
    body = pack(a.astype(np.uint64))
    return len(body).to_bytes(4, "little") + body


def read(keys: bytes, counts: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A packed row's keys (as given by the counting function) and counts."""
    return unpack_sorted(keys, U64) * U64(_BACK), _columns(counts, width)


def _columns(counts: bytes, width: int) -> np.ndarray:
    out, at = [], 0
    for _ in range(width):
        size = int.from_bytes(counts[at : at + 4], "little")
        out.append(unpack(counts[at + 4 : at + 4 + size], np.uint64).astype(np.int64))
        at += 4 + size
    return np.stack(out, 1)


def count_keys(df: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], width: int = 1) -> DataFrame:
    """A kept table of packed rows. keys turns batches into (keys, rows of `width` counts)."""
    n_buckets = parts(df.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for k, c in keys(batches):
            if len(k):
                held.append(_summed(k * U64(_SPREAD), c))
                n += len(held[-1][0])
            if n >= FLUSH:
                yield _rows(*_summed(*(np.concatenate(x) for x in zip(*held))), n_buckets)
                held, n = [], 0
        if n:
            yield _rows(*_summed(*(np.concatenate(x) for x in zip(*held))), n_buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket. What is held is summed whenever it has doubled."""
        now, held, n, least = None, [], 0, FLUSH

        def whole():
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            for bucket, _, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if bucket != now:
                    if held:
                        yield _rows(*whole(), n_buckets)
                    now, held, n, least = bucket, [], 0, FLUSH
                held.append((unpack_sorted(k, U64), _columns(c, width)))
                n += len(held[-1][0])
                if n > least:
                    held = [whole()]
                    n = len(held[0][0])
                    least = 2 * n + FLUSH
        if held:
            yield _rows(*whole(), n_buckets)

    made = df.mapInArrow(trimmed(local), KIND).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return keep(made.mapInArrow(trimmed(merge), KIND), "counts")
