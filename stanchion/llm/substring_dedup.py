"""Substring dedup: removes words of passages that stand earlier in the corpus.

A window is `window` consecutive words of one document. A count-min sketch of all windows
(merged from partition sketches) overestimates how often each occurs; only windows that it
takes for repeated travel on, and are then grouped exactly, by a 128-bit hash. Singles that
slip through are grouped too and found single, and no repeated window is ever missed.

Data flow, for text of size D:
 1. read texts -> partition sketches -> merged bits of fixed size, broadcast;
 2. read texts -> candidate windows, each once per flush of a task (later places inside the
    flush are known to be repeats already), packed by hash bucket -> shuffle;
 3. buckets, streamed: a place is flagged if its window starts earlier elsewhere; flags are
    packed by group of documents -> shuffle;
 4. texts and flags meet by group of documents; covered words go.
A key of any frequency reaches a bucket at most once per flush, so hot passages do not pile up.

Defined results: null or blank text has no words and an empty result; rows that share an id
count as one document (equal starts are one place), those of a null id too, which comes after
all others, 2^63 - 1 included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _sketch
from ._base import MULT, U64, WHITE, chunks, cuts, ids_of, is_null, pack, pack_sorted, parts, small_batches, strings, trimmed, unpack, unpack_sorted, windows, words_of, xxhash64

WINDOW = 20
FLUSH = 500_000
_WORD = ~WHITE
#: Set in the starts of a null id, whose number is the largest integer; no text has so many words.
_NULL = np.uint32(1 << 31)
_HASHED = "bucket int, kind int, h1 binary, h2 binary, doc binary, start binary"


def _windows(column: pa.Array, size: int, second: bool):
    """Per chunk: first row, words, window hashes, their first words, and (if second) independent hashes."""
    data, offsets = strings(column)
    for lo, _, body, offs in chunks(data, offsets):
        w = words_of(body, offs, _WORD)
        h, at = windows(w.hashes(0), w.first, size, MULT[1])
        h2 = windows(w.hashes(1), w.first, size, MULT[0])[0] if second else None
        yield lo, w, h, at, h2


def doc_group(doc: np.ndarray, n: int) -> np.ndarray:
    return xxhash64(doc) % n


def _candidates(size: int, n_buckets: int, n_groups: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids, null = ids_of(batch.column(0)), is_null(batch.column(0))
            for lo, w, h, at, h2 in _windows(batch.column(1), size, True):
                on = _sketch.maybe_repeated(bits.value, h)
                if on.any():
                    at = at[on]
                    doc = np.searchsorted(w.first, at, "right") - 1
                    held.append((h[on], h2[on], ids[lo + doc], (at - w.first[doc]).astype(np.uint32) | np.where(null[lo + doc], _NULL, np.uint32(0))))
                    n += len(at)
                if n >= FLUSH:
                    yield _flush(held, n_buckets, n_groups)
                    held, n = [], 0
        if n:
            yield _flush(held, n_buckets, n_groups)

    return run


def _flush(held: list[tuple], n_buckets: int, n_groups: int) -> pa.RecordBatch:
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    fresh = np.ones(len(h1), bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    rows: list[tuple] = []
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0))
    later = ~fresh & ((doc != doc[lead]) | (start != start[lead]))
    rows += [(g % n_buckets, 1, d, s, None, None) for g, d, s in pack_flags(doc[later], start[later], n_groups)]
    h1, h2, doc, start = h1[fresh], h2[fresh], doc[fresh], start[fresh]
    # h1 is ascending: buckets are its top part
    bucket = (h1 >> U64(32)) * U64(n_buckets) >> U64(32)
    c = cuts(bucket, n_buckets)
    for b in range(n_buckets):
        s = slice(c[b], c[b + 1])
        if c[b + 1] > c[b]:
            rows.append((b, 0, pack_sorted(h1[s]), pack(h2[s]), pack(doc[s]), pack(start[s])))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int32(), pa.int32()] + [pa.binary()] * 4)], ["bucket", "kind", "h1", "h2", "doc", "start"])


def pack_flags(doc: np.ndarray, start: np.ndarray, n_groups: int) -> list[tuple[int, bytes, bytes]]:
    """(group, docs, starts) with each group's flags sorted by document and start."""
    if not len(doc):
        return []
    g = doc_group(doc, n_groups)
    order = np.lexsort((start, doc, g))
    g, doc, start = g[order], doc[order], start[order]
    heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return [(int(g[a]), pack(doc[a:b]), pack(start[a:b])) for a, b in zip(heads, [*heads[1:], len(g)])]


def _flags(n_groups: int):
    """Rows arrive sorted by bucket. Flags of one bucket's later places, and those found before the shuffle."""

    def judged(held: list[tuple]) -> list[tuple]:
        h1, h2, doc, start = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h1)
        h1 = h1[order]
        same = np.zeros(len(h1), bool)
        same[1:] = h1[1:] == h1[:-1]
        same[:-1] |= same[1:]
        order = order[same]
        h1, h2, doc, start = h1[same], h2[order], doc[order], start[order]
        order = np.lexsort((start, doc, h2, h1))
        h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0))
        later = ~fresh & ((doc != doc[lead]) | (start != start[lead]))
        return pack_flags(doc[later], start[later], n_groups)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        g, d, s = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(d, pa.binary()), pa.array(s, pa.binary())], ["grp", "docs", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            rows, local = [], []
            for bucket, kind, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                if bucket != now:
                    if held:
                        rows += judged(held)
                    now, held = bucket, []
                if kind:
                    docs = unpack(a, np.int64)
                    local.append((int(doc_group(docs[:1], n_groups)[0]), a, b))
                else:
                    held.append((unpack_sorted(a, U64), unpack(b, U64), unpack(c, np.int64), unpack(d, np.uint32)))
            if rows or local:
                yield out(rows + local)
        if held and (rows := judged(held)):
            yield out(rows)

    return run


def _applied(size: int):
    """Rows arrive sorted by group, flags first. Gives each document's words that no flagged window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, starts, ready = None, [], [], None
        for batch in batches:
            out: list[list] = [[], [], []]
            g_, kind, flagged_, at_ = (batch.column(k).to_pylist() for k in (0, 1, 4, 5))
            keys, null = ids_of(batch.column(2)), is_null(batch.column(2))
            texts = batch.column(3).cast(pa.large_binary())
            for k, (g, row, flagged, at) in enumerate(zip(g_, kind, flagged_, at_)):
                if g != now:
                    now, docs, starts, ready = g, [], [], None
                if not row:
                    docs.append(unpack(flagged, np.int64))
                    starts.append(unpack(at, np.uint32))
                    continue
                if ready is None:
                    d = np.concatenate(docs) if docs else np.empty(0, np.int64)
                    s = np.concatenate(starts) if docs else np.empty(0, np.uint32)
                    order = np.argsort(d, kind="stable")
                    ready = d[order], s[order]
                words = (texts[k].as_py() or b"").split()
                lo, hi = np.searchsorted(ready[0], keys[k]), np.searchsorted(ready[0], keys[k], "right")
                n = len(words)
                if hi > lo:
                    at = ready[1][lo:hi]
                    at = (at[(at >= _NULL) == null[k]] & ~_NULL).astype(np.int64)
                    at = at[at + size <= n]  # rows that share an id can be of other lengths
                    cover = np.zeros(n + size + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    kept = np.flatnonzero(np.cumsum(cover[:n]) == 0)
                    words = [words[i] for i in kept]
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(b" ".join(words))
            if out[0]:
                on = pa.array([bool(k) for k in kind])
                cols = [batch.column(6).filter(on), batch.column(2).filter(on), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.large_binary()).cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each row's words outside windows that also start earlier, joined by one space.

    Columns named in carry come along as they are, in a struct `row`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(*(F.col(f"`{c}`") for c in carry or []), F.lit(None).cast("int").alias("_none")).alias("row")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row)
    text = base.select("doc_id", "text")
    n = parts(spark)
    n_groups = n

    def keys(batches):
        for batch in batches:
            for _, _, h, _, _ in _windows(batch.column(1), window, False):
                yield h

    bits = _sketch.repeated(text, keys)
    row_type = base.schema["row"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    flags = (
        text.mapInArrow(trimmed(_candidates(window, n, n_groups, bits)), _HASHED)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(trimmed(_flags(n_groups)), "grp int, docs binary, starts binary")
        .select("grp", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("string").alias("text"), "docs", "starts", none(row_type).alias("row"))
    )
    grp = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(2**63 - 1))), F.lit(n_groups)).cast("int").alias("grp")
    rows = base.select(grp, F.lit(1).alias("kind"), "doc_id", "text", none("binary").alias("docs"), none("binary").alias("starts"), "row")
    met = flags.unionByName(rows).repartition(n, "grp").sortWithinPartitions("grp", "kind")
    kind = StructType([StructField("row", row_type), *(StructField(c, LongType()) for c in ("doc_id", "n_words", "n_removed")), StructField("kept_text", StringType())])
    out = met.mapInArrow(trimmed(_applied(window)), kind)
    return out.withColumn("row", F.col("row").dropFields("_none")) if carry else out.drop("row")
