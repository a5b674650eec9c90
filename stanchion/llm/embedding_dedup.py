"""Near-duplicate embeddings by sorted projection passes.

Rows of equal vectors form one class, so copies never meet each other. In each pass every class gets a
key of BITS random hashes, the signs of its vector on as many random directions, concatenated; classes
are put in the lexicographic order of their keys, and each is compared with the WINDOW - 1 that follow
it. Pairs of cosine >= threshold are links. Pairs that several passes find are counted once: a class
carries its places in all passes, and a pass leaves out those that stood together in an earlier one. So
what leaves a task is one count for each class and a forest of its links, never the list of pairs.

Two vectors at an angle t agree on a bit with probability 1 - t/pi and stand within a window if they
agree on the first log2(classes / WINDOW) bits. As many passes are made as find a pair at the threshold
with probability RECALL; closer pairs are found more surely. Tables of up to WINDOW classes are compared
whole. The number of passes grows slowly with the table (8 at 50,000 vectors, about 110 at 10^9).

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with
nothing, and vectors of different lengths never link. Rows that repeat an id are rows of their own; a
null id is linked like others, but never is the least. A component without any id has a null
component_id, and its rows are kept. Columns of the table beside the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop, keep, trimmed
from ._order import numbered
from .components import components, contract
from .vector_search import usable

BITS, WINDOW, RECALL, SEED = 63, 512, 0.98, 11
#: Places of a pass that a task compares at once, with WINDOW more that belong to the next such block.
BLOCK, TILE = 2048, 256


def passes_for(classes: int, threshold: float, window: int = WINDOW) -> int:
    """Passes that find a pair at the threshold with probability RECALL."""
    depth = max(0.0, math.log2(max(classes, 1) / window))
    one = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth
    return 1 if one >= 1 else max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-one)))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square overflows or vanishes."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length in an array column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, unit(flat[(ends[rows] - d)[:, None] + np.arange(d)])


def _keys(passes: int):
    """(cls, v) -> a row for each pass: (pass, dims, key, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            cls = batch.column(0).to_numpy()
            for rows, x in by_length(batch.column(1)):
                d = x.shape[1]
                if d not in directions:
                    directions[d] = np.random.default_rng(SEED).standard_normal((passes, d, BITS))
                for p in range(passes):
                    key = ((x @ directions[d][p]) > 0) @ weights
                    n = len(rows)
                    cols = [np.full(n, p, np.int32), np.full(n, d, np.int32), key, cls[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["pass", "dims", "key", "cls"])

    return run


def _block_links(p: int, place: np.ndarray, before: np.ndarray, x: np.ndarray, end_own: int, threshold: float, window: int):
    """Links of the places before end_own with those up to window - 1 after each: (rows, rows) of the block.

    place: ascending places in pass p; before: places in passes 0 .. p-1, by row.
    """
    own = int(np.searchsorted(place, end_own))
    found = []
    for a in range(0, own, TILE):
        b = min(a + TILE, own)
        end = int(np.searchsorted(place, place[b - 1] + window))
        near = x[a:b] @ x[a:end].T >= threshold
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        gap = place[j] - place[i]
        on = (gap > 0) & (gap < window)
        i, j = i[on], j[on]
        if p:
            new = (np.abs(before[i] - before[j]) >= window).all(1)
            i, j = i[new], j[new]
        found.append((i, j))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def _compared(threshold: float, window: int, size: int):
    """Rows sorted by (pass, dims, block, place) -> (cls, links, other): counts, and edges of a forest where other is not null."""

    def answer(rows: pa.Table) -> pa.RecordBatch:
        p, end_own = rows["pass"][0].as_py(), (rows["block"][0].as_py() + 1) * size
        cls, n = rows["cls"].to_numpy(), rows["n"].to_numpy()
        places = rows["places"].combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        x = unit(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cls), -1))
        i, j = _block_links(p, places[:, p], places[:, :p], x, end_own, threshold, window)
        links = np.bincount(i, n[j], len(cls)) + np.bincount(j, n[i], len(cls))
        on = np.flatnonzero(links)
        u, v = contract(cls[i], cls[j]) if len(i) else (np.empty(0, np.int64),) * 2
        out = [np.concatenate((cls[on], u)), np.concatenate((links[on].astype(np.int64), np.zeros(len(u), np.int64)))]
        other = pa.array(np.concatenate((np.zeros(len(on), np.int64), v)), mask=np.arange(len(on) + len(u)) < len(on))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out] + [other], ["cls", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            group = np.stack([t[c].to_numpy() for c in ("pass", "dims", "block")])
            cut = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            bounds = [0, *cut.tolist(), t.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                piece = t.slice(a, b - a)
                if held and any(held[0][c][0] != piece[c][0] for c in ("pass", "dims", "block")):
                    yield answer(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield answer(pa.concat_tables(held))

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", window: int = WINDOW, block_size: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    if window > block_size:
        raise ValueError("a window is at most a block")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    # zeros of either sign are equal
    rows = rows.withColumn("v", F.when(usable("v"), F.transform(v, lambda c: c + F.lit(0).cast("float"))))
    two = (F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v, F.size(v)).alias("h2"))
    ids = rows.select("vec_id", *(F.when(v.isNotNull(), h).alias(n) for h, n in zip(two, ("h1", "h2"))))
    grouped = rows.filter(v.isNotNull()).select("vec_id", "v", *two).groupBy("h1", "h2")
    classes = keep(grouped.agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("v").alias("v")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    passes = passes_for(count, threshold, window)

    keys = classes.select("cls", "v").mapInArrow(trimmed(_keys(passes)), "pass int, dims int, key long, cls long")
    placed = numbered(keys, [F.col(c) for c in ("pass", "dims", "key", "cls")])
    # a pass holds every class once, so a place in the order of all passes, less what came before, is one in its own
    own = placed.select("cls", "pass", (F.col("place") - F.col("pass") * count).alias("place"))
    places = own.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("pass", "place"))).alias("p"))
    placed_classes = keep(classes.join(places.select("cls", F.col("p.place").alias("places")), "cls").select("cls", "n", "v", "places"), "placed")
    drop(placed)

    spread = placed_classes.select("*", F.size("v").alias("dims"), F.posexplode("places").alias("pass", "place"))
    block = F.floor(F.col("place") / block_size).cast("long")
    # the first rows of a block are the last that those of the block before are compared with
    also = F.when((F.col("place") % block_size < window - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = spread.withColumn("block", F.explode(also)).select("pass", "dims", "block", "place", "cls", "n", "v", "places")
    sorted_ = spread.repartition("pass", "dims", "block").sortWithinPartitions("pass", "dims", "block", "place")
    found = keep(sorted_.mapInArrow(trimmed(_compared(threshold, window, block_size)), "cls long, links long, other long"), "found")

    edges = keep(found.filter("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")), "edges")
    comps = components(edges)
    links = found.filter("other IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    told = classes.select("cls", "h1", "h2", "n", "least").join(links, "cls", "left").join(comps.withColumnRenamed("id", "cls"), "cls", "left")
    told = keep(told.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "cls").alias("comp"), "least"), "told")
    drop(placed_classes, found, edges)
    least = keep(told.groupBy("comp").agg(F.min("least").alias("component")), "least")
    named = keep(told.join(least, "comp").select("h1", "h2", "n_links", "component"), "named")
    drop(classes, told, least)

    # both sides are plain exchanges, so that the rows of one frequent vector can be split
    out = ids.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) | F.col("component_id").isNull())
