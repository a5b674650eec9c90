"""Connected components; nothing is collected to the driver.

Edges are contracted inside tasks of at most EDGES edges first (a forest of stars remains), which
settles any graph that fits in one task. Beyond, large-star and small-star rounds alternate until
nothing changes, with a contraction before each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop, keep, trimmed

EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node that is not the least of its component, the least."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[a], low[b])
        now = low.copy()
        np.minimum.at(now, a, m)
        np.minimum.at(now, b, m)
        np.minimum.at(now, low[a], m)
        np.minimum.at(now, low[b], m)
        now = now[now]
        if (now == low).all():
            break
        low = now
    on = low != np.arange(len(ids))
    return ids[on], ids[low[on]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            u, v = contract(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += len(held[-1][0])
            if n >= most:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(trimmed(run), "u long, v long")


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges: distinct (u, v) with u > v. Each node links its larger (or smaller) neighbours to the least node it knows."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # written out so that both sides of the join are plain exchanges, which a hub's rows can be split in
    least = keep(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
    met = ends.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    made = keep(out.filter("u <> v").distinct().coalesce(tasks), "edges")
    drop(least)
    return made


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """links: a kept table (a long, b long). Gives (id, comp) for each id that is not the least of its component; comp is the least."""
    most = most or EDGES
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = -(-links.count() // most) or 1
    edges = keep(_contracted(edges.coalesce(tasks), most), "edges")
    before = None
    while tasks > 1:
        wide = _star(edges, True, tasks)
        drop(edges)
        narrow = _star(wide, False, tasks)
        drop(wide)
        now = _mark(narrow)
        edges = narrow
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
