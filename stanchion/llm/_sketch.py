"""Count-min sketches with counters that stop at two, built per partition and merged exactly.

Each of DEPTH rows has 2**ROW_BITS counters. A flush of a partition sends the counters it
touched, per block of counters, as packed differences; the blocks are merged by streaming
tasks. A merged counter of two or more becomes one bit, so the merged sketch has a fixed
size of DEPTH * 2**ROW_BITS / 8 bytes (64 MB), whatever the input: this is what is
broadcast. With more keys it only lets more single keys pass; it never loses a repeated one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ._base import U64, pack_sorted, parts, release, trimmed, unpack, unpack_sorted
from ._base import pack as _pack

DEPTH, ROW_BITS, BLOCK_BITS = 2, 28, 22
FLUSH = 2_000_000
_MULT = (0x8CB92BA72F3D8DD7, 0xD2B74407B1CE6E93)
SCHEMA = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


class Marks:
    """The bits of a merged sketch, compressed by block; a process opens them once, where they are used."""

    def __init__(self, blocks: dict[int, bytes], depth: int):
        self.blocks, self.depth = blocks, depth
        self._bits: np.ndarray | None = None

    def __getstate__(self):
        if self._bits is not None:
            raise ValueError("marks are sent before they are opened")
        return self.blocks, self.depth

    def __setstate__(self, state):
        self.__init__(*state)

    def bits(self) -> np.ndarray:
        if self._bits is None:
            n = 1 << (BLOCK_BITS - 3)
            self._bits = np.zeros(self.depth << (ROW_BITS - 3), np.uint8)
            for block, packed in self.blocks.items():
                self._bits[block * n : (block + 1) * n] = unpack(packed, np.uint8)
            self.blocks = {}
        return self._bits


def counters(h: np.ndarray, row: int) -> np.ndarray:
    return ((h * U64(_MULT[row])) >> U64(64 - ROW_BITS)).astype(np.uint32)


def _emit(hashes: list[np.ndarray], depth: int) -> pa.RecordBatch:
    h = np.concatenate(hashes) if hashes else np.empty(0, U64)
    out: tuple[list, list, list] = ([], [], [])
    n = 1 << (ROW_BITS - BLOCK_BITS)
    edges = (np.arange(1, n, dtype=np.uint64) << U64(BLOCK_BITS)).astype(np.uint32)
    for row in range(depth):
        at = np.sort(counters(h, row))
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        once, more = at[fresh], np.unique(at[~fresh])
        a, b = (np.concatenate(([0], np.searchsorted(x, edges), [len(x)])) for x in (once, more))
        for k in range(n):
            if a[k + 1] > a[k]:
                out[0].append(row * n + k)
                out[1].append(pack_sorted(once[a[k] : a[k + 1]] & np.uint32((1 << BLOCK_BITS) - 1)))
                out[2].append(pack_sorted(more[b[k] : b[k + 1]] & np.uint32((1 << BLOCK_BITS) - 1)))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by block; one block's counters are held at a time."""
    now, seen, more = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(np.packbits(more))], pa.binary()), pa.array([b""], pa.binary())], schema=SCHEMA)

    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                if now is not None:
                    yield done()
                now, seen, more = block, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            at = unpack_sorted(once, np.uint32)
            more[at[seen[at]]] = True
            seen[at] = True
            more[unpack_sorted(twice, np.uint32)] = True
    if now is not None:
        yield done()


def repeated(df: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], depth: int = DEPTH) -> Broadcast:
    """Broadcasts the bits of counters that two or more keys of df share; keys turns batches into arrays of 64-bit hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for h in keys(batches):
            held.append(h)
            n += len(h)
            if n >= FLUSH:
                yield _emit(held, depth)
                held, n = [], 0
        if n:
            yield _emit(held, depth)

    kind = "block int, once binary, more binary"
    made = df.mapInArrow(trimmed(sketch), kind)
    merged = made.repartition(parts(df.sparkSession), "block").sortWithinPartitions("block").mapInArrow(trimmed(_merge), kind)
    blocks = {r.block: bytes(r.once) for r in merged.select("block", "once").collect()}
    held = df.sparkSession.sparkContext.broadcast(Marks(blocks, depth))
    release()
    return held


def maybe_repeated(marks: Marks, h: np.ndarray) -> np.ndarray:
    """Whether each key may occur twice or more: never false for one that does."""
    bits = marks.bits()
    out = np.ones(len(h), bool)
    for row in range(len(bits) >> (ROW_BITS - 3)):
        at = counters(h, row)
        at_byte = (at >> np.uint32(3)).astype(np.int64) + (row << (ROW_BITS - 3))
        out &= (bits[at_byte] >> (7 - (at & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
    return out
