"""Exact top-k search: BM25 over an inverted index in shards, with block-max dynamic pruning.

Statistics are global: the number of rows, their mean length, and each term's document count are
taken over the whole corpus, exactly. Documents are dealt into shards of about SHARD_TERMS
postings; a shard is an inverted index of its own, packed into one row of a table: terms (64-bit
hashes) with their postings in document order. A query is a bag of distinct terms.

In a shard, documents of like words and length stand together and are cut into blocks of BLOCK
documents; each list has its largest part of a score in each block (taken when the shard is
opened, as it rests on the corpus's mean length and the terms' weights). The sum of these bounds
what a query can find in a block; where it reaches the query's threshold (the k-th best so far, of
all shards of the task), the block is live, and the others hold no answer. Queries are whole texts, which
share most of their terms, so lists are of two kinds. Long lists, whose terms many queries and many documents hold,
are columns of a matrix: their cursors go through the live blocks only, in each together and for all queries in which it is live, by
one product of matrices. A document whose sum of these, with the most that the other lists add in its block, reaches the threshold is
a pivot, and a block without one is live no more. The cursors of the short lists then
go posting by posting from the query's first live block to its last. All these sums are in single precision,
and documents that may reach the threshold by them are scored whole, in double precision and in the order of their terms.

Queries go round in blocks of about QUERY_TERMS terms, the bound of what is broadcast; for each block every shard is opened once. A block first
asks about the square root of the number of shards; the k-th best found there is the floor that all
others must reach, so that they return few rows. Merging by score is exact, as all use the same
statistics.

Defined results: null or blank text matches nothing and, as a query, returns nothing; only
documents with a positive score are returned; a query's own id is no answer to it; scores that are equal to 9 places tie, and ties go to the
smaller id; rows that share an id are separate documents, and as queries the least text of an id
asks; null ids are not returned and do not ask.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import LOWER, U64, chunks, drop, keep, pack, pack_sorted, ragged, small_batches, strings, trimmed, unpack, unpack_sorted, words_of
from ._counts import count_keys, read

K1, B, BLOCK, SHARD_TERMS, QUERY_TERMS = 1.2, 0.75, 256, 2_500_000, 10_000_000
#: Most blocks of a shard; cells of the long lists' matrix, and of a tile of queries; postings that are taken by position, not as a slice.
BLOCKS, MATRIX, TILE, FEW, PIECE = 32, 1 << 24, 1 << 21, 8, 16
#: A list is long where the share of documents that hold its term, times that of queries, is above this.
DENSE = 0.004
#: Shares of the long lists after which the blocks are looked at again.
STEPS = (1.0,)
#: Most groups of a shard's documents.
GROUPS = 8
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


INDEX = ["ids", "known", "lengths", "terms", "df", "docs", "tfs"]


def bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first row, distinct terms of each document (ascending), their counts, the bounds of each document's, and lengths in words."""
    data, offsets = strings(column)
    for lo, _, body, offs in chunks(data, offsets):
        w = words_of(LOWER[body], offs, IS_WORD)
        h = w.hashes()
        for i in range(len(w.first) - 1):
            h[w.first[i] : w.first[i + 1]].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        heads = w.first[:-1]
        fresh[heads[heads < len(h)]] = True
        at = np.flatnonzero(fresh)
        yield lo, h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, w.first), w.counts()


def _groups(term: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each document, which is the first that it holds of these terms: the commonest, the commonest of the documents without it, and so on.
    Terms are told apart by some bits only: groups bring like documents together, and no result rests on them."""
    bits = (term >> U64(46)).astype(np.int64)
    doc, out, left = np.repeat(np.arange(len(n)), n), np.full(len(n), GROUPS), np.ones(len(n), bool)
    for g in range(GROUPS):
        df = np.bincount(bits[left[doc]])
        if not len(df) or df.max() < len(n) / 64:
            break
        has = np.zeros(len(n), bool)
        has[doc[bits == df.argmax()]] = True
        out[has & left] = g
        left &= ~has
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: ids, lengths, terms, postings per term, and postings (document, count) in term order."""

    def shard(held):
        ids, known, lengths, term, tf, n = (np.concatenate([x[i] for x in held]) for i in range(6))
        at = np.lexsort((lengths, _groups(term, n)))  # documents of like words and length share a block: its bounds are tighter
        p = ragged((np.cumsum(n) - n)[at], n[at])
        term, tf, doc = term[p], tf[p], np.repeat(np.arange(len(ids), dtype=np.uint32), n[at])
        order = np.argsort(term, kind="stable")  # documents stay in order inside a term
        term, tf, doc = term[order], tf[order], doc[order]
        heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        df = np.diff(np.append(heads, len(term)))
        row = [pack(ids[at]), pack(known[at].astype(np.uint8)), pack(lengths[at].astype(np.uint32)), pack_sorted(term[heads]), pack(df.astype(np.uint32)), pack(doc), pack(tf.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], INDEX)

    held, n = [], 0
    for batch in batches:
        ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for lo, term, tf, bounds, lengths in bags(batch.column(1)):
            hi = lo + len(lengths)
            held.append((ids[lo:hi], known[lo:hi], lengths, term, tf, np.diff(bounds)))
            n += len(term)
            if n >= SHARD_TERMS:
                yield shard(held)
                held, n = [], 0
    if held:
        yield shard(held)


class Asked:
    """A block of queries: own ids (ascending), and of each the numbers of its terms among all asked for (ascending, with their weights)."""

    def __init__(self, queries: list[tuple[int, np.ndarray]]):
        queries = sorted(queries, key=lambda x: x[0])
        self.own = np.array([q for q, _ in queries], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for _, t in queries])))
        self.terms = np.unique(np.concatenate([t for _, t in queries]))
        self.at = np.concatenate([np.searchsorted(self.terms, t).astype(np.int32) for _, t in queries])
        self.share = (np.bincount(self.at, minlength=len(self.terms)) / len(queries)).astype(np.float32)  # of the queries, that hold a term
        self.idf = np.zeros(len(self.terms))


class Shard:
    """One shard, opened for a block of queries."""

    def __init__(self, ids, known, lengths, terms, df, docs, tfs, mean_length: float, asked: Asked):
        self.asked, self.ids, self.known = asked, unpack(ids, np.int64), unpack(known, np.uint8).astype(bool)
        self.met = self.live = self.opened = self.postings = self.single = self.whole = 0  # blocks met, with a bound that reaches, with a pivot; postings met and added one by one; documents scored whole
        n = len(self.ids)
        length = unpack(lengths, np.uint32).astype(np.float64)
        scale = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        terms, df = unpack_sorted(terms, U64), unpack(df, np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(asked.terms, terms), max(len(asked.terms) - 1, 0))
        on = asked.terms[at] == terms if len(asked.terms) else np.zeros(len(terms), bool)
        p = np.repeat(on, df)  # lists that nobody asks for go
        self.df, at = df[on], at[on]
        m = len(at)
        self.term = np.full(len(asked.terms), -1, np.int32)  # of each term asked for
        self.term[at] = np.arange(m)
        docs = unpack(docs, np.uint32)[p].astype(np.int64)
        tf = unpack(tfs, np.uint32)[p].astype(np.float64)
        part = np.repeat(asked.idf[at], self.df) * (tf * (K1 + 1) / (tf + scale[docs]))  # what a posting adds to a score
        term = np.repeat(np.arange(m, dtype=np.int32), self.df)
        del tf, p
        # the same by document, terms in order
        order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
        self.term_of, self.part_of = term[order], part[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n))))
        self.wanted = np.zeros(m)
        del order
        # blocks of documents: of each list its largest part in each
        self.size = max(BLOCK, -(-n // BLOCKS))
        self.edges = np.append(np.arange(0, n, self.size), n)
        blocks = len(self.edges) - 1
        cell = term.astype(np.int64) * blocks + docs // self.size
        heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if m else np.empty(0, np.int64)
        self.peak = np.zeros(m * blocks, np.float32)
        if m:
            self.peak[cell[heads]] = np.maximum.reduceat(part, heads)
        # long lists: those that cost less as columns of a matrix, for all queries at once, than posting by posting
        gain = asked.share[at] * self.df / max(n, 1)
        long = np.argsort(-gain, kind="stable")[: max(1, MATRIX // max(n, 1))]
        long = np.sort(long[gain[long] > DENSE])
        self.column = np.full(m, -1, np.int32)
        self.column[long] = np.arange(len(long))
        column = self.column[term]
        held = column >= 0
        self.parts = np.zeros((len(long), n), np.float32)
        self.parts[column[held], docs[held]] = part[held]
        # short lists: few postings are taken by position, more as rows of PIECE; what a last row lacks are parts of 0 at a document that is none
        self.few = (self.df <= FEW) & (self.column < 0)
        held = self.few[term]
        self.few_docs, self.few_part = docs[held], part[held].astype(np.float32)
        self.few_at = np.cumsum(np.where(self.few, self.df, 0)) - np.where(self.few, self.df, 0)
        short = ~self.few & (self.column < 0)
        size = np.where(short, -(-self.df // PIECE), 0)
        self.row_at = np.cumsum(size) - size
        held = short[term]
        to = np.repeat(self.row_at[short] * PIECE, self.df[short]) + ragged(np.zeros(int(short.sum()), np.int64), self.df[short])
        self.docs, self.part = np.full((int(size.sum()), PIECE), n, np.uint16 if n < 1 << 16 else np.uint32), np.zeros((int(size.sum()), PIECE), np.float32)
        self.docs.ravel()[to], self.part.ravel()[to] = docs[held], part[held]
        self.peak, self.blocks = self.peak.reshape(m, blocks), blocks
        count = np.zeros((m, blocks + 1), np.int32)  # postings before each block
        np.cumsum(np.bincount(cell, minlength=m * blocks).reshape(m, blocks), axis=1, out=count[:, 1:])
        self.count = count
        self.by_id = np.argsort(self.ids, kind="stable")

    def best(self, floors: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Puts into best, for each query, the k best of those held there and of this shard that reach its floor (ids, scores)."""
        bounds, lo = self.asked.bounds, 0
        while lo < len(self.asked.own):
            hi = max(lo + 1, min(lo + 256, lo + TILE // max(len(self.ids), 1), int(np.searchsorted(bounds, bounds[lo] + TILE // 16, "right")) - 1))
            self._tile(lo, hi, floors, best, k)
            lo = hi

    def _tile(self, lo: int, hi: int, floors: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        n, asked, count = len(self.ids), self.asked, hi - lo
        t = self.term[asked.at[asked.bounds[lo] : asked.bounds[hi]]]
        row = np.repeat(np.arange(count), np.diff(asked.bounds[lo : hi + 1]))[t >= 0]
        t = t[t >= 0]
        if not len(t):
            return
        first = np.searchsorted(row, np.arange(count + 1))
        threshold = np.array([max(f, s[k - 1] if len(s) >= k else 0.0) for f, (_, s) in zip(floors[lo:hi], best[lo:hi])])
        near = 1 - 1.2e-7 * (np.diff(first) + 8)  # all parts are positive: sums in single precision are never further below
        least = threshold * near - 1e-8  # and scores that tie when rounded
        column = self.column[t]
        long = column >= 0
        bound = np.zeros((count, self.blocks), np.float32)
        have, heads = np.unique(row, return_index=True)
        bound[have] = np.add.reduceat(self.peak[t], heads, axis=0)
        live = (bound >= least[:, None]) & (bound > 0)
        self.met += bound.size
        self.live += int(live.sum())
        # in each block the cursors of all long lists go on together, for all queries in which it is live
        q, sums = np.zeros((count, len(self.parts)), np.float32), np.zeros((count, n + 1), np.float32)
        q[row[long], column[long]] = 1
        steps = [math.ceil(x * len(self.parts)) for x in STEPS]
        most = self.peak[self.column >= 0]
        rest = [bound * (2 - near[:, None]) - q[:, :c] @ most[:c] * near[:, None] for c in steps]  # the most that the other lists add
        for b, (s, e) in enumerate(zip(self.edges, self.edges[1:])):
            on, part, done = np.flatnonzero(live[:, b]), 0, 0
            for c, more in zip(steps, rest):
                if not len(on):
                    break
                part = part + q[on, done:c] @ self.parts[done:c, s:e]
                pivot, done = part.max(axis=1) + more[on, b] >= least[on], c
                if not pivot.all():
                    on, part = on[pivot], part[pivot]
            live[:, b] = False
            live[on, b] = True
            sums[on, s:e] = part
        self.opened += int(live.sum())
        sums[:, np.flatnonzero(~self.known)] = -np.inf
        own = [np.searchsorted(self.ids, asked.own[lo:hi], side, sorter=self.by_id) for side in ("left", "right")]
        sums[np.repeat(np.arange(count), own[1] - own[0]), self.by_id[ragged(own[0], own[1] - own[0])]] = -np.inf
        # short lists: from a query's first live block to its last
        go = live.any(axis=1)
        begin, end = live.argmax(axis=1), self.blocks - live[:, ::-1].argmax(axis=1)
        on = self.few[t] & go[row]
        p = ragged(self.few_at[t[on]], self.df[t[on]])
        np.add.at(sums.reshape(-1), np.repeat(row[on] * (n + 1), self.df[t[on]]) + self.few_docs[p], self.few_part[p])
        on = ~self.few[t] & ~long & go[row]
        s, e = (x[t[on], y[row[on]]] for x, y in ((self.count, begin), (self.count, end)))
        s, size = s // PIECE, -(-e // PIECE) - s // PIECE
        rows = ragged(self.row_at[t[on]] + s, size)
        cut = np.concatenate(([0], np.cumsum(np.bincount(row[on], size, count).astype(np.int64))))
        self.single += len(p) + len(rows) * PIECE
        enough = least.copy()
        for i in np.flatnonzero(go):
            r = rows[cut[i] : cut[i + 1]]
            np.add.at(sums[i], self.docs.take(r, axis=0).ravel().astype(np.int64), self.part.take(r, axis=0).ravel())
            if not threshold[i] > 0 and k <= n:
                enough[i] = np.partition(sums[i, :n], -k)[-k] * near[i] - 1e-8
        sums[:, n] = -np.inf
        found = np.flatnonzero(sums >= np.maximum(enough, 1e-40).astype(np.float32)[:, None])
        self.whole += len(found)
        rows, heads = np.unique(found // (n + 1), return_index=True)
        for i, some in zip(rows.tolist(), np.split(found % (n + 1), heads[1:])):
            best[lo + i] = self._scored(some, t[first[i] : first[i + 1]], k, threshold[i], *best[lo + i])

    def _scored(self, found: np.ndarray, terms: np.ndarray, k: int, least: float, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those held and of the documents found, whose parts are summed in the order of their terms."""
        n = self.first[found + 1] - self.first[found]
        p = ragged(self.first[found], n)
        self.wanted[terms] = 1
        s = np.add.reduceat(self.wanted[self.term_of[p]] * self.part_of[p], np.cumsum(n) - n)
        self.wanted[terms] = 0
        on = (s > 0) & (s >= least - 1e-8)
        if not on.any():
            return ids, scores
        ids, scores = np.concatenate((ids, self.ids[found[on]])), np.concatenate((scores, s[on]))
        top = np.lexsort((ids, -np.round(scores, 9)))[:k]
        return ids[top], scores[top]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows of docs for each row of queries, best first."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"  # of workers: each task has a core, and more threads of its products would crowd out other tasks
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    index = keep(pick(docs).mapInArrow(trimmed(_indexed), ", ".join(f"{c} binary" for c in INDEX)), "index")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = shards = 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                length = unpack(x, np.uint32)
                n, total, shards = n + len(length), total + int(length.sum()), shards + 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([shards])], ["n", "total", "shards"])

    size = index.select("lengths").mapInArrow(trimmed(told), "n long, total long, shards long").agg(*(F.sum(c).alias(c) for c in ("n", "total", "shards"))).first()
    n, mean = size.n or 0, (size.total or 0) / max(size.n or 0, 1)
    leads = F.pmod(F.xxhash64("ids"), F.lit(math.isqrt(size.shards or 1))) == 0
    rounds = [index.filter(leads).select(INDEX), index.filter(~leads).select(INDEX)]

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for terms, df in zip(*(c.to_pylist() for c in batch.columns)):
                yield unpack_sorted(terms, U64), unpack(df, np.uint32).astype(np.int64)[:, None]

    frequency = count_keys(index.select("terms", "df"), counted)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, term, _, bounds, lengths in bags(batch.column(1)):
                rows = [pack_sorted(term[s:e]) for s, e in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(lengths)), pa.array(rows, pa.binary())], ["id", "terms"])

    # of several rows with one id, the least text asks
    least = pick(queries).filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    asking = keep(least.mapInArrow(trimmed(bagged), "id long, terms binary"), "asking")
    found, held, terms = [], [], 0

    def ask(queries: list[tuple[int, np.ndarray]]) -> None:
        asked = Asked(queries)
        asked.idf, floors = _idf(frequency, asked.terms, n), np.zeros(len(asked.own))
        for shards in rounds:
            found.append(_round(shards, asked, floors, mean, k))
            if shards is not rounds[-1]:
                floors = _floors(found[-1], asked.own, k)

    for r in asking.toLocalIterator():
        held.append((r.id, unpack_sorted(bytes(r.terms), U64)))
        terms += len(held[-1][1])
        if terms >= QUERY_TERMS:
            ask(held)
            held, terms = [], 0
    if held:
        ask(held)
    drop(frequency, asking, index)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _idf(frequency: DataFrame, asked: np.ndarray, n: int) -> np.ndarray:
    """Weights of the terms asked for, from the whole corpus's document counts."""
    held = frequency.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                keys, counts = read(k, c, 1)
                at = np.minimum(np.searchsorted(held.value, keys), max(len(held.value) - 1, 0))
                on = held.value[at] == keys if len(held.value) else np.zeros(len(keys), bool)
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array([pack(at[on])]), pa.array([pack(counts[on, 0])])], ["at", "df"])

    df = np.zeros(len(asked))
    for r in frequency.select("keys", "counts").mapInArrow(trimmed(run), "at binary, df binary").collect():
        df[unpack(r.at, np.int64)] = unpack(r.df, np.int64)
    held.unpersist()
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def _floors(found: DataFrame, own: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score so far, where it has so many: all better answers reach it."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"))
    least = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", "score")
    have = {r.query_id: r.score for r in least.collect()}  # a row for each query of the block at most
    return np.array([have.get(q, 0.0) for q in own.tolist()])


def _round(index: DataFrame, asked: Asked, floors: np.ndarray, mean: float, k: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast((asked, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floors = held.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(floors)  # of all the task's shards: each begins with the threshold of those before it
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                Shard(*row, mean, asked).best(floors, best, k)
        q = np.repeat(asked.own, [len(i) for i, _ in best])
        cols = [q, np.concatenate([i for i, _ in best]), np.concatenate([x for _, x in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    out = keep(index.mapInArrow(trimmed(run), "query_id long, doc_id long, score double"), "found")
    held.unpersist()
    return out
