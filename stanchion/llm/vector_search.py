"""Approximate nearest neighbours by collision counting (single-projection hashing with virtual rehashing).

Each shard of up to SHARD vectors keeps, for each of PROJECTIONS random lines, its vectors' places
on the line in order. A query looks at the window of half-width R around its own place on every
line and counts, for each vector, the windows that it is in. Vectors counted at least `threshold`
times are verified by true distance. If fewer than k verified ones are within R, R grows by GROWTH, but not beyond the k-th
best distance found (virtual rehashing: the same arrays, only the windows widen) until k are, or the windows hold all.
A vector within R is in a window with probability erf(1/sqrt 2) = 0.683, and the threshold is
MARGIN standard deviations below the count expected of it, so each true neighbour is missed with
a probability of at most five percent (that of one at distance R itself). Every row is in a shard; nothing is sampled or capped.

Shards answer for their own rows, k each, and the answers are merged exactly. Queries go round in
blocks of QUERY_BLOCK, the bound of what is broadcast.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most, and null ids, take no part; rows with the query's id are its own; ties go to the
smaller id; with fewer candidates than k, all of them; of several query rows with one id the least
vector asks. A distance beyond the largest double is infinite, and such a row is still an answer.
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

from ._base import keep, trimmed

PROJECTIONS, SHARD, QUERY_BLOCK, GROWTH, MARGIN, SEED = 192, 16_384, 4_096, 1.3, 1.7, 7
_NEAR = math.erf(1 / math.sqrt(2))


def usable(col: str, dims: int | None = None):
    """Whether a vector takes part."""
    c = F.col(col)
    ok = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok if dims is None else ok & (F.size(c) == dims), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q; where squares would overflow or vanish, differences are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - q
        s = (d * d).sum(1)
        out = np.sqrt(s)
        odd = np.flatnonzero(~((s > 1e-280) & (s < np.inf)))
        if len(odd):
            top = np.abs(d[odd]).max(1)
            scaled = d[odd] / np.where((top > 0) & (top < np.inf), top, 1)[:, None]
            out[odd] = np.where(top < np.inf, top * np.sqrt((scaled * scaled).sum(1)), np.inf)
    return out


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray):
        self.ids, self.x, self.unit = ids, x, unit_of(x.shape[1])
        at = x @ lines
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.place = np.take_along_axis(at, self.order.T, 0).T.copy()

    def nearest(self, qid: int, q: np.ndarray, where: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.ids), len(where)
        threshold = max(1, int(m * _NEAR - MARGIN * math.sqrt(m * _NEAR * (1 - _NEAR))))
        few = self.x[:: max(1, n // 256)]
        near = np.sort(distances(few, q))
        r = max(float(near[min(len(near) - 1, k)]) * 0.5, 1e-12)
        lo = hi = None
        count = np.zeros(n, np.int32)
        known = np.zeros(n, bool)
        dist = np.full(n, np.inf)
        own = self.ids == qid
        while True:
            half = r * self.unit
            a = np.array([np.searchsorted(p, w - half, "left") for p, w in zip(self.place, where)])
            b = np.array([np.searchsorted(p, w + half, "right") for p, w in zip(self.place, where)])
            if lo is None:
                fresh = [o[i:j] for o, i, j in zip(self.order, a, b)]
            else:
                fresh = [o[i:j] for o, i, j in zip(self.order, a, lo)] + [o[i:j] for o, i, j in zip(self.order, hi, b)]
            lo, hi = a, b
            count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            new = np.flatnonzero((count >= threshold) & ~known)
            known[new] = True
            dist[new] = distances(self.x[new], q)
            best = dist[known & ~own]
            edge = np.partition(best, k - 1)[k - 1] if len(best) >= k else np.inf
            if known.all() or edge <= r:
                break
            r = min(r * GROWTH, float(edge))  # no neighbour that is still sought is farther than the k-th found
        got = np.flatnonzero(known & ~own)
        if len(got) > k:
            edge = np.partition(dist[got], k - 1)[k - 1]
            got = got[dist[got] <= edge]
        got = got[np.lexsort((self.ids[got], dist[got]))][:k]
        return self.ids[got], dist[got]


def unit_of(dims: int) -> float:
    """What lines are scaled by, so that no finite vector's place on one overflows."""
    return 2.0 ** -(4 + math.ceil(math.log2(dims)))


def lines_for(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTIONS)) * unit_of(dims)


def _answers(queries: tuple[np.ndarray, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = queries.value
        lines = lines_for(q.shape[1])
        where = q @ lines

        def answer(held):
            shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), lines)
            out = [(qid, *shard.nearest(qid, v, w, k)) for qid, v, w in zip(qids.tolist(), q, where)]
            n = [len(i) for _, i, _ in out]
            cols = [np.repeat(qids, n), np.concatenate([i for _, i, _ in out]), np.concatenate([d for _, _, d in out])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        held, n = [], 0
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for a in range(0, len(ids), SHARD):
                held.append((ids[a : a + SHARD], x[a : a + SHARD]))
                n += len(held[-1][0])
                if n >= SHARD:
                    yield answer(held)
                    held, n = [], 0
        if n:
            yield answer(held)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors for each row of queries, nearest first."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable("v"))
    base, asked = pick(vectors), pick(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes.d if sizes else 0
    base = base.filter(F.size("v") == dims)
    asked = asked.filter(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = asked.toLocalIterator()
    found = []
    while True:
        block = [r for _, r in zip(range(QUERY_BLOCK), rows)]
        if not block:
            break
        block.sort()
        held = spark.sparkContext.broadcast((np.array([r.vec_id for r in block], np.int64), np.array([r.v for r in block])))
        found.append(keep(base.mapInArrow(trimmed(_answers(held, k)), "query_id long, vec_id long, score double"), "near"))
        held.unpersist()
        if len(block) < QUERY_BLOCK:
            break
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
