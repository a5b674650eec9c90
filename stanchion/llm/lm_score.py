"""LM scoring by cross-entropy difference: a document's loss under a target model less that under a background model.

Both are bigram models over one vocabulary, all words of the whole corpus and one place for
any other, and over all its bigrams: nothing is cut off, so the tables grow with the input. For either,

    P(w | h) = (c(h, w) + MU * P1(w)) / (c(h) + MU),    P1(w) = (c(w) + 1) / (N + size of the vocabulary)

with c(h, w) the count of a bigram, c(h) the sum of these, so that P sums to one. The
background counts all rows, the target the rows of target ids.

Words (also as contexts) and bigrams are counted exactly over all documents, as 63-bit hashes with
one bit for which of these they are. Documents are cut into pieces; a piece's distinct keys and
their counts go to hash buckets, which add up all pieces and give the sums back, so counting
and looking up are one round trip, and neither table is written, broadcast or collected.

A word is a run of characters other than ASCII white space, with A-Z lower-cased; a document
begins with a start mark that is predicted by nothing and predicts its first word.

Defined results: null or blank text has no tokens and null losses and score; without target rows
the target model is that of no counts (uniform); every row gives a row; repeated target ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._ask import ask, hear, opened, sized
from ._base import LOWER, U64, WHITE, chunks, drop, ids_of, keep, mix, small_batches, strings, trimmed, words_of

MU = 20.0
#: Words of a piece of documents.
PIECE = 1_500_000
#: Up to so many target ids are broadcast (32 MB); of more, the rows are found by a join.
IDS = 4_000_000
#: Kinds of keys, in their last bit; then keys are spread by an odd factor.
_ONE, _PAIR = U64(0), U64(1)
_SPREAD = 0x9E6C63D0876A9A47
_BACK = pow(_SPREAD, -1, 1 << 64)
_HEAD = U64(0x5851F42D4C957F2D)  # stands for the start mark's hash
_WORD = ~WHITE
#: What is done with a row: it is counted for the background, counted for the target, scored.
_COUNTED, _TARGET, _SCORED = 1, 2, 4


@dataclass
class Models:
    """The rows that both models count: the corpus (id, text), and the ids of the target's rows."""

    docs: DataFrame
    corpus: DataFrame
    ids: DataFrame


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """target_ids: one column, the ids of the target's rows. Counting is done when documents are scored."""
    return Models(docs, _plain(docs, id_col, text_col), target_ids.toDF("id").select(F.col("id").cast("long")).filter("id is not null").distinct())


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _pairs(own: np.ndarray, n: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For numbers of words, n[i] of them in document i: the number of the word before each place (n_words at a start),
    the distinct pairs (before, own), and which of them each place has."""
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = n_words
    pairs, place = np.unique(before * (n_words + 1) + own, return_inverse=True)
    return before, pairs // (n_words + 1), pairs % (n_words + 1), place


def _keys(words: np.ndarray, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words (the start mark is the last) and of pairs of numbers, in one order; and where each has gone."""
    words = np.append(words, _HEAD)
    pair = mix(words[before] * U64(_SPREAD) + U64(1)) + words[own]
    keys = np.concatenate([mix(x) & ~U64(1) | kind for x, kind in ((words, _ONE), (pair, _PAIR))]) * U64(_SPREAD)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return keys[order], rank


def _piece(ids: pa.Array, role: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], bytes]:
    """Counts of words and pairs for the background and the target, then of words as contexts for either."""
    words, number = np.unique(h, return_inverse=True)
    before, pair_before, pair_own, place = _pairs(number, n, len(words))
    keys, rank = _keys(words, pair_before, pair_own)
    at, context = (rank[number], rank[len(words) + 1 + place]), rank[before]
    doc = np.repeat(role, n)
    on = [(doc & flag) > 0 for flag in (_COUNTED, _TARGET)]
    cols = [sum(np.bincount(x[f], minlength=len(keys)) for x in at) for f in on]
    cols += [np.bincount(context[f], minlength=len(keys)) for f in on]
    if not role[0] & _SCORED:  # as no other row of the piece is
        return keys, cols, b""
    valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    # frequent words have small numbers, which pack well
    order = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return keys, cols, sized(ids.fill_null(0).to_numpy(), valid, n.astype(np.uint32), np.diff(words, prepend=U64(0)), order.astype(np.uint32), rank[number])


def _cut(few):
    """few: the target's ids, ascending, where they are broadcast."""

    def piece(held: list):
        ids, *rest = zip(*held)
        return _piece(pa.concat_arrays(ids), *(np.concatenate(x) for x in rest))

    def cut(batches: Iterator[pa.RecordBatch]):
        held, size = {0: [], _SCORED: []}, {0: 0, _SCORED: 0}  # a piece is scored or only counted as a whole
        for batch in batches:
            role, ids = batch.column(0).to_numpy().copy(), batch.column(1)
            if few is not None and len(few.value):
                known = ids.fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(few.value, known), len(few.value) - 1)
                role[(few.value[at] == known) & ids.is_valid().to_numpy(zero_copy_only=False) & ((role & _COUNTED) > 0)] |= _TARGET
            for kind in held:
                on = (role & _SCORED) == kind
                if not on.any():
                    continue
                own, roles, (data, offsets) = ids.filter(pa.array(on)), role[on], strings(batch.column(2).filter(pa.array(on)))
                for lo, hi, body, offs in chunks(data, offsets):
                    w = words_of(LOWER[body], offs, _WORD)
                    held[kind].append((own.slice(lo, hi - lo), roles[lo:hi], w.counts(), w.hashes()))
                    size[kind] += len(w.starts) + hi - lo
                    if size[kind] >= PIECE:
                        yield piece(held[kind])
                        held[kind], size[kind] = [], 0
        for rows in held.values():
            if rows:
                yield piece(rows)

    return cut


def _told(keys: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """Of the words of a bucket: how many the corpus holds, and their counts."""
    on = (keys * U64(_BACK)) & U64(1) == _ONE
    b, t = (c[on] for c in cols[:2])
    return np.array([(b > 0).sum(), b.sum(), t.sum()])


def _losses(_: int, body: bytes, cols: list[np.ndarray], told: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not body:
        return
    ids, valid, n, words, order, number = opened(body, np.int64, np.uint8, np.uint32, U64, np.uint32, np.uint32)
    n, number, words = n.astype(np.int64), order[number].astype(np.int64), np.cumsum(words, dtype=U64)
    size, *total = np.resize(told, 3) + np.array([2, 0, 0])  # with places for the start mark and for other words
    _, before, own, place = _pairs(number, n, len(words))
    rank = _keys(words, before, own)[1]
    one, context, pair = rank[own], rank[before], rank[len(words) + 1 :]
    out = []
    for c, follows, whole in zip(cols[:2], cols[2:], total):
        loss = np.log(follows[context] + MU) - np.log(c[pair] + MU * (c[one] + 1) / (whole + size))
        sums = np.zeros(len(n))
        if len(place):
            sums[n > 0] = np.add.reduceat(loss[place], (np.cumsum(n) - n)[n > 0])
        out.append(sums / np.maximum(n, 1))
    b, t = out
    losses = [pa.array(x, pa.float64(), mask=n == 0) for x in (t, b, t - b)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(n), *losses], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])


def _target_rows(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of base with these ids, kept. A filter of fixed size, that misses no id, lets few other texts reach the join."""

    def keys(batches):
        for batch in batches:
            h = mix(ids_of(batch.column(0)).astype(U64))
            yield np.concatenate((h, h))  # seen twice: what the sketch marks

    bits = _sketch.repeated(ids, keys, depth=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = _sketch.maybe_repeated(bits.value, mix(ids_of(batch.column(0)).astype(U64)))
            if on.any():
                yield batch.filter(pa.array(on))

    near = base.mapInArrow(trimmed(run), "id long, text string")
    out = keep(near.join(ids, "id", "left_semi"), "target")
    bits.destroy()
    return out


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (loss per token under the target less under the background)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.sameSemantics(models.docs)
    rows = models.corpus.select(F.lit(_COUNTED | _SCORED * own).alias("role"), "id", "text")
    ids, few = keep(models.ids, "ids"), None
    if ids.count() <= IDS:
        few = spark.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
        drop(ids)
    else:
        rows = rows.unionByName(_target_rows(models.corpus, ids).select(F.lit(_TARGET).alias("role"), "id", "text"))
    if not own:
        rows = rows.unionByName(_plain(docs, id_col, text_col).select(F.lit(_SCORED).alias("role"), "id", "text"))
    answered = ask(rows, _cut(few), [np.add] * 4, lambda keys, cols: cols, _told)
    return hear(answered, _losses, [np.int64] * 4, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
