"""Values of 64-bit keys over a whole table, brought back to the places that hold them, in one round trip.

Tasks cut their rows into pieces. A piece sends its distinct keys, with one value of each in
every column, to hash buckets, which combine the values of all pieces and answer each piece by
position: a key that stands everywhere is sent once by each piece, so no key is hot. What else
a piece needs (its body) travels along. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._base import U64, cuts, pack, pack_sorted, parts, trimmed, unpack, unpack_sorted

#: Buckets for each partition of the shuffle; a task holds one at a time.
SPLIT = 2
KIND = "at int, piece long, keys binary, cols binary, body binary"
_FIELDS = pa.schema([("at", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("cols", pa.binary()), ("body", pa.binary())])


def sized(*arrays: np.ndarray) -> bytes:
    """Arrays packed one after another."""
    bodies = [pack(x) for x in arrays]
    return b"".join(len(x).to_bytes(4, "little") + x for x in bodies)


def opened(body: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(body[at : at + 4], "little")
        out.append(unpack(body[at + 4 : at + 4 + size], kind))
        at += 4 + size
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that arrive sorted by a column, one value's at a time."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[column] != now:
                yield now, held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield now, held


Piece = tuple[np.ndarray, list[np.ndarray], bytes]


def ask(
    df: DataFrame,
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[Piece]],
    combine: list[np.ufunc],
    answer: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]],
    tell: Callable[[np.ndarray, list[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """Rows of KIND for hear(). cut turns batches into pieces: distinct ascending keys, evenly spread over 64 bits, their
    integer columns, and a body. combine: how each column's values of one key combine. answer: the columns that go back
    (of integers, best small or zero). tell: integers that a bucket says of its keys; every piece hears their sums over all buckets."""
    n = parts(df.sparkSession)
    n_buckets = n * SPLIT

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for keys, cols, body in cut(batches):
            c = cuts((keys >> U64(32)) * U64(n_buckets) >> U64(32), n_buckets)
            rows = [(piece % n_buckets, piece, None, None, body)]
            rows += [(b, piece, pack_sorted(keys[s:e]), sized(*(np.ascontiguousarray(x[s:e], np.int64) for x in cols)), None) for b, s, e in zip(range(n_buckets), c, c[1:]) if e > s or tell]
            yield _batch(rows)
            piece += 1

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, 0):
            own = [r for r in rows if r[2] is not None]
            out = [(-1, r[1], None, None, r[4]) for r in rows if r[2] is None]
            if own:
                keys = [unpack_sorted(r[2], U64) for r in own]
                cols = [opened(r[3], *[np.int64] * len(combine)) for r in own]
                ends = np.cumsum([len(k) for k in keys])
                every, place = np.unique(np.concatenate(keys), return_inverse=True)
                order = np.argsort(place, kind="stable")
                heads = np.searchsorted(place[order], np.arange(len(every)))
                whole = [np.empty(0, np.int64)] * len(combine) if not len(every) else [f.reduceat(np.concatenate([c[i] for c in cols])[order], heads) for i, f in enumerate(combine)]
                told = tell(every, whole).astype(np.int64).tobytes() if tell else None
                back = answer(every, whole)
                out += [(bucket, r[1], None, sized(*(x[place[e - len(k) : e]] for x in back)), told) for r, k, e in zip(own, keys, ends)]
            yield _batch(out)

    sent = df.mapInArrow(trimmed(send), KIND).repartition(n, "at").sortWithinPartitions("at")
    return sent.mapInArrow(trimmed(combined), KIND)


def hear(answered: DataFrame, finish: Callable[[int, bytes, list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], kinds: list, schema: str) -> DataFrame:
    """finish gets each piece's number, its body, its columns (of these kinds) in the order of its keys, and what all buckets told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in grouped(batches, 1):
            body = next(r[4] for r in rows if r[0] < 0)
            own = [r for r in rows if r[0] >= 0]
            cols = [opened(r[3], *kinds) for r in own]
            told = sum((np.frombuffer(r[4], np.int64) for r in own if r[4]), np.zeros(1, np.int64))
            yield from finish(piece, body, [np.concatenate([c[i] for c in cols]) if cols else np.empty(0, k) for i, k in enumerate(kinds)], told)

    n = parts(answered.sparkSession)
    return answered.repartition(n, "piece").sortWithinPartitions("piece", "at").mapInArrow(trimmed(run), schema)
