"""Resampling towards a target distribution by importance weights over hashed n-grams.

Features are all runs of 1 to `grams` consecutive words, joined by one space, repeats counted; a feature's
bucket is its bytes' crc32 modulo `buckets`. The matrix of documents by buckets is made once and kept, as
compressed sparse rows in blocks of documents. Its column sums (s of each bucket, S in all) and those of the
target texts (t, T) give each bucket's gain, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); the matrix
times the gains, over a document's number of features and floored, is its weight. With Gumbel noise that
depends on the id alone, the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Every text is read once, whole; a task holds one block. Only one number for each bucket meets on the driver.
Ranks are places in a global order that no single task sees.

Defined results: a null text has no words, a document without words has weight 0; a null id is written as an
empty text in the noise and comes last among ties; rows that repeat an id are drawn each by itself, and rows
alike in id and score are ordered by their number of features. Without target texts every gain follows from the
documents alone; without documents nothing is returned. Columns beside those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import LOWER, chunks, cuts, drop, keep, pack, small_batches, strings, trimmed, unpack, words_of
from ._order import numbered

#: Documents with at least so many words can be drawn, and of these so many in a hundred are.
WORDS, PERCENT = 20, 10

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, np.uint32(0xEDB88320) ^ (_TABLE >> np.uint32(1)), _TABLE >> np.uint32(1))
#: Runs of up to so many bytes go through the table side by side, longer ones one by one.
_SIDE = 64


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[s:e] for each s, e."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_SIDE) :]
    at, crc, left = starts[order], out[order], size[order]
    n = len(order)
    for k in range(_SIDE):
        n = int(np.searchsorted(-left[:n], -k, "left"))  # those longer than k
        if not n:
            break
        head = crc[:n]
        crc[:n] = _TABLE[(head ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
    out[order] = crc
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SIDE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features_of(data: np.ndarray, offsets: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its crc32, words of each document) of a chunk."""
    lower = LOWER[data]
    words = words_of(lower, offsets, _IS_WORD)
    docs, counts = words.doc_of(), words.counts()
    if grams == 1:
        return docs, crc32s(lower, words.starts, words.ends), counts
    # the words written one after another with a space behind each: a run of words is then a run of bytes
    size = words.ends - words.starts + 1
    ends = np.cumsum(size)
    starts = ends - size
    text = lower[np.minimum(np.repeat(words.starts - starts, size) + np.arange(int(size.sum())), max(len(lower) - 1, 0))]
    text[ends - 1] = 0x20
    room = np.repeat(words.first[1:], counts) - np.arange(len(docs))
    of, crc = [], []
    for g in range(1, grams + 1):
        i = np.flatnonzero(room >= g)
        of.append(docs[i])
        crc.append(crc32s(text, starts[i], ends[i + g - 1] - 1))
    return np.concatenate(of), np.concatenate(crc), counts


def matrix(texts: DataFrame, id_col: str, text_col: str, grams: int, buckets: int) -> DataFrame:
    """Blocks of (doc_id array, n_words array, indptr, indices, counts): documents by buckets in compressed sparse rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in chunks(*strings(batch.column(1))):
                docs, crc, words = features_of(data, offsets, grams)
                cell, count = np.unique(docs * buckets + crc % np.uint32(buckets), return_counts=True)
                indptr = cuts(cell // buckets, b - a)
                packed = [pack(np.diff(indptr).astype(np.int32)), pack((cell % buckets).astype(np.int32)), pack(count.astype(np.int32))]
                part = [pa.ListArray.from_arrays([0, b - a], x) for x in (ids.slice(a, b - a), pa.array(words, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part, *(pa.array([x], pa.binary()) for x in packed)], ["ids", "words", "sizes", "indices", "counts"])

    small_batches(texts.sparkSession)
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "ids array<long>, words array<long>, sizes binary, indices binary, counts binary")


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; the tasks' sums are added by Spark, `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i, c in zip(batch.column(0), batch.column(1)):
                total += np.bincount(unpack(i.as_py(), np.int32), unpack(c.as_py(), np.int32), buckets).astype(np.int64)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("indices", "counts").mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gains of the buckets in thousandths of a nat, floored."""
    n, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    up = (target + 1).astype(np.float64) * (big_s + n)
    return np.floor(1000 * np.log(up / ((source + 1).astype(np.float64) * (big_t + n)))).astype(np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, over each row's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, words = batch.column(0)[r].values, batch.column(1)[r].values
                size = unpack(batch.column(2)[r].as_py(), np.int32)
                indices, counts = (unpack(batch.column(k)[r].as_py(), np.int32) for k in (3, 4))
                ends = np.cumsum(size)
                sums = []
                for values in (counts.astype(np.int64), counts * gains[indices]):
                    run_ = np.concatenate(([0], np.cumsum(values)))
                    sums.append(run_[ends] - run_[ends - size])
                n, total = sums
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(trimmed(run), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of sha256 of `seed:id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, percent: int = PERCENT, least_words: int = WORDS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document; rank is null where it is not drawn."""
    blocks = keep(matrix(docs, id_col, text_col, grams, buckets), "matrix")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = gains_of(column_sums(blocks, buckets), column_sums(matrix(aim, "doc_id", "text", grams, buckets), buckets))
    scored = weights(blocks, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    order = [F.when(fit, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")]
    ranked = numbered(scored, order)
    drawn = percent * ranked.filter(fit).count() // 100
    drop(blocks)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.select("doc_id", "n_features", "weight", F.col("score").cast("long").alias("score"), rank.alias("rank"))
