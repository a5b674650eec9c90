"""N-gram Jaccard join by parity sketches; documents linked at a similarity of num/den or more.

A document is the set of its distinct shingles of `shingle` words (fewer words: one shingle).
Its parity sketch under K blocks is, for each block, the XOR of the hashes of its shingles
there: two documents' sketches differ in no more blocks than their sets differ in shingles.
A link with threshold t leaves at most T = (1-t)/(1+t) * (|A|+|B|) different shingles, so of
A's non-empty blocks at most T differ and the others agree: the pigeonhole join on agreeing
blocks finds every link. K belongs to a size band; bands grow by 1/t, so partners are at most
one band apart and each document takes part in its own band and the next.

Agreeing blocks are joined with a prefix filter: every document may leave out the most
frequent of its blocks as long as T+1 remain, in one global order (frequency, then value).

Data flow:
 1. a count-min sketch of all shingles; a document with too few repeated shingles to reach t
    with anything is done (nothing is lost: estimates are never too low);
 2. the others: sets, equal sets collapse into a class that its smallest id stands for (a task
    sends each set once, unless it meets it under a smaller id);
 3. block signatures go in pieces to hash buckets and bring back each token's count and smallest id; each document
    chooses its tokens, and is compared with the smallest ids of these (stars);
 4. pairs pass 1024-bit parity sketches (Hamming bound), then exact intersection;
 5. components by star contraction;
 6. a token whose documents, without its star, are all in one component is done, and so goes without any of its pairs
    being listed. Documents of the other tokens are compared across components, in cells of a bounded size, by sketch
    and then exactly; a cell gives only links that connect components. Then components are formed again.

jaccard_join() computes components only, which these steps keep exact: a pair whose ends are connected by
then is not verified. links() gives every link between different sets, and the number of each document's.

Defined results: null or blank text has an empty set and is linked with nothing; rows that
share an id count as one document; a null id has no component (null) and links to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._ask import ask, grouped, hear, opened, sized
from ._base import LOWER, MULT, U64, WHITE, chunks, drop, keep, mix, parts, ragged, range_hash, small_batches, strings, trimmed, windows, words_of, xxhash64
from .components import components

SHINGLE, NUM, DEN = 5, 75, 100
#: Tokens of a piece of sets; sets and shingles on either side of a cell of comparisons.
PIECE, CELL, ITEMS = 500_000, 4096, 2_000_000
#: Bits of the dense sketches, and the columns that hold them.
BITS = 1024
SKETCH = [f"s{i}" for i in range(BITS // 64)]
_WORD = ~WHITE


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk: first row, distinct shingle hashes (ascending in each document), and the bounds of each document's."""
    data, offsets = strings(column)
    for lo, _, body, offs in chunks(data, offsets):
        w = words_of(LOWER[body], offs, _WORD)
        wh = w.hashes(0)
        h, at = windows(wh, w.first, shingle, MULT[1])
        n = w.counts()
        few = np.flatnonzero((n > 0) & (n < shingle))
        if len(few):
            whole = range_hash(wh, w.first[few], w.first[few + 1], MULT[1])
            h, at = np.concatenate((h, whole)), np.concatenate((at, w.first[few]))
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        bounds = np.searchsorted(at, w.first)
        for i in range(len(n)):
            h[bounds[i] : bounds[i + 1]].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        heads = bounds[:-1]
        fresh[heads[heads < len(h)]] = True
        yield lo, h[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def dense(h: np.ndarray) -> np.ndarray:
    """The dense parity sketch: shingle x flips bit x mod BITS; as signed integers."""
    odd = np.bincount((h >> U64(7)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_KIND = "kind int, part long, doc long, n long, k1 long, k2 long, items binary"
_REMEMBERED = 200_000


def _sets(shingle: int, num: int, den: int, bits):
    """Kind 0: every row's id, size and set key. Kind 1: sets that may have a link, once per task unless a smaller id has the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[int, int], int] = {}
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for lo, h, bounds in shingle_sets(batch.column(1), shingle):
                n = np.diff(bounds)
                doc, valid = ids[lo : lo + len(n)], known[lo : lo + len(n)]
                again = _sums(_sketch.maybe_repeated(bits.value, h).astype(np.int64), bounds)
                lives = (n > 0) & (den * again >= num * n) & valid
                k1 = _sums(mix(h ^ U64(0x1B873593)), bounds).view(np.int64)
                k2 = _sums(mix(h ^ U64(0x85EBCA6B00000001)), bounds).view(np.int64)
                at = []
                for i in np.flatnonzero(lives):
                    key = int(k1[i]), int(k2[i])
                    if key not in told or told[key] > doc[i]:
                        if len(told) >= _REMEMBERED:
                            told.clear()
                        told[key] = int(doc[i])
                        at.append(i)
                at = np.array(at, np.int64)
                items = [h[bounds[i] : bounds[i + 1]].tobytes() for i in at]
                kind = np.concatenate((np.zeros(len(n), np.int32), np.ones(len(at), np.int32)))
                every = np.concatenate((np.arange(len(n)), at))
                part = np.concatenate((xxhash64(doc ^ np.arange(len(doc))), k1[at]))
                cols = [pa.array(kind), pa.array(part), pa.array(doc[every], mask=~valid[every]), pa.array(n[every]), pa.array(k1[every]), pa.array(k2[every]), pa.array([None] * len(n) + items, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "part", "doc", "n", "k1", "k2", "items"])

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by kind, set key and id. Of rows of kind 1 the first of each key stays, and gets its dense sketch."""
    last = None
    for batch in batches:
        kind, k1, k2, items = (batch.column(c).to_pylist() for c in (0, 4, 5, 6))
        keep_, sketches = [], []
        for row in zip(kind, k1, k2, items):
            fresh = not row[0] or row[1:3] != last
            keep_.append(fresh)
            if row[0]:
                last = row[1:3]
            if fresh:
                sketches.append(dense(np.frombuffer(row[3], U64)).tolist() if row[0] else (None,) * len(SKETCH))
        cols = [c.filter(pa.array(keep_)) for c in batch.columns]
        more = [pa.array(c, pa.int64()) for c in zip(*sketches)] if sketches else [pa.array([], pa.int64())] * len(SKETCH)
        yield pa.RecordBatch.from_arrays([cols[2], cols[3], cols[4], cols[5], cols[6], *more], ["doc", "n", "k1", "k2", "items", *SKETCH])


def band_of(n: int, num: int, den: int) -> tuple[int, int, int]:
    """Band of size n, and the largest sizes of that band and the next."""
    b, low = 0, 1
    while True:
        high = max(low, -(-low * den // num) - 1)  # sizes low..high; a partner of low is at most low*den/num
        if n <= high:
            nxt = high + 1
            return b, high, max(nxt, -(-nxt * den // num) - 1)
        b, low = b + 1, high + 1


def tokens(h: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, int]]:
    """For a set's own band and the next: tokens of its non-empty blocks (lowest bit: band parity), and how many may be left out."""
    n = len(h)
    band, high, higher = band_of(n, num, den)
    for b, top in ((band, high), (band + 1, higher)):
        most = min(n * den // num, top)  # largest partner in this band
        t = (n + most) * (den - num) // (den + num)
        k = int(np.ceil(0.4 * top + 2 * np.sqrt(top) + 2))
        block = (mix(h ^ U64(b * 0x9E3779B1 + 77)) >> U64(32)) * U64(k) >> U64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        sign = np.bitwise_xor.reduceat(mix(h[order] + U64(0x5851F42D4C957F2D)), heads)
        tok = mix(sign ^ mix(block[heads] + U64(b << 40))) & ~U64(1) | U64(b & 1)
        spare = len(tok) - t - 1
        if spare < 0:  # every block may differ: such sets of a band meet in one token
            tok = np.append(tok, mix(np.array([b], U64) ^ U64(0xA5A5A5A5A5A5A5A5)) & ~U64(1) | U64(b & 1))
            spare = 0
        yield tok, spare


def _looked_up(sets: DataFrame, num: int, den: int, stars: bool = True) -> DataFrame:
    """For each piece of sets: its stars (kind 0: a, b), and what is left to compare (kind 1: packed seats; kind 2: sizes as a and
    ids as b). Without stars, every seat of a token that several sets chose is left."""

    def piece(held: list) -> tuple[np.ndarray, list[np.ndarray], bytes]:
        doc, size, toks, spare = zip(*held)
        n = np.array([len(t) for t in toks])
        keys, place = np.unique(np.concatenate(toks), return_inverse=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, place, np.repeat(np.array(doc, np.int64), n))
        body = sized(np.array(doc, np.int64), np.array(size, np.int64), n, np.array(spare, np.int64), place.astype(np.uint32))
        return keys, [np.bincount(place, minlength=len(keys)), low], body

    def cut(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            for doc, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(items, U64)
                for tok, spare in tokens(h, num, den):
                    held.append((doc, len(h), tok, spare))
                    n += len(tok)
                if n >= PIECE:
                    yield piece(held)
                    held, n = [], 0
        if held:
            yield piece(held)

    def answer(keys, cols):
        count, low = cols
        return [count.astype(np.uint32), np.where(count > 1, low, 0), np.where(count > 1 + stars, keys, U64(0))]

    def finish(number: int, body: bytes, cols: list[np.ndarray], _) -> Iterator[pa.RecordBatch]:
        doc, size, n, spare, place = opened(body, *[np.int64] * 4, np.uint32)
        segment = np.repeat(np.arange(len(n)), n)
        count = cols[0][place].astype(np.int64)
        # each may leave out its most frequent tokens as far as its allowance goes, in one order for all: by count, then by token
        order = np.lexsort((place, -count, segment))
        rank = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        order = order[(rank >= np.repeat(spare, n)) & (count[order] > 1)]
        place, segment, count = place[order], segment[order], count[order]
        own, lead = doc[segment], cols[1][place]
        star = np.unique(np.stack((lead, own), 1)[lead != own], axis=0)
        if stars and len(star):
            yield _chosen(0, number, star[:, 0], star[:, 1])
        on = count > 1 + stars
        if on.any():
            keys, at = np.unique(cols[2][place[on]], return_inverse=True)
            left, who = np.unique(own[on], return_inverse=True)
            most = np.zeros(len(left), np.int64)
            np.maximum.at(most, who, size[segment[on]])
            seat = np.unique(np.stack((who, at, (lead == own)[on] & stars), 1), axis=0)  # rows that share an id may share a token
            packed = sized(keys, *(np.ascontiguousarray(seat[:, i]).astype(np.uint32) for i in range(3)))
            yield _chosen(1, number, np.array([-1]), np.array([-1]), packed)
            yield _chosen(2, number, most, left)

    answered = ask(sets.select("doc", "items"), cut, [np.add, np.minimum], answer)
    return hear(answered, finish, [np.uint32, np.int64, U64], "kind int, piece long, a long, b long, body binary")


def _chosen(kind: int, number: int, a: np.ndarray, b: np.ndarray, body: bytes | None = None) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(np.full(len(a), number)), pa.array(a), pa.array(b), pa.array([body] * len(a), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "piece", "a", "b", "body"])


def _verified(num: int, den: int):
    """(a, b, sets, sketches): the pairs whose sketches allow a link and whose sets have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                on[i] = den * both >= num * (len(x) + len(y) - both)
            if on.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(on)), batch.column(1).filter(pa.array(on))], ["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, few: bool = False) -> DataFrame:
    """The pairs (a, b) that are links. pairs: distinct, and within what their sketches allow. few: they need a small part
    of the sets, which are filtered first."""
    if few:
        needed = keep(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "needed")
        sets = sets.join(needed, "doc", "left_semi")
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("items").alias(f"items_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return keep(met.select("a", "b", "items_a", "items_b").mapInArrow(trimmed(_verified(num, den)), "a long, b long"), "links")


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs: distinct (a, b); those whose sketches allow a link."""
    side = lambda x: sets.select(F.col("doc").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *SKETCH)))
    return keep(pairs.join(side("a"), "a").join(side("b"), "b").filter(_sketches("a", "b", num, den)).select("a", "b"), "possible")


def _spanning(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the pairs that connect all that the pairs' links connect: each document is compared with its
    least partner first; other pairs only where their ends are not connected by then."""
    first = keep(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = _links(first, sets, num, den)
    comps = components(links)
    at = lambda x: comps.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = keep(apart.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "rest")
    more = _links(rest, sets, num, den, few=True)
    drop(first, rest)
    return keep(links.unionByName(more), "links")


def _sketches(x: str, y: str, num: int, den: int):
    """Hamming distance of the dense sketches, never more than the sets' difference, within what a link allows."""
    apart = reduce(add, (F.bit_count(F.col(f"{c}_{x}").bitwiseXOR(F.col(f"{c}_{y}"))) for c in SKETCH))
    return apart * (num + den) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (den - num)


def _open(chosen: DataFrame, comps: DataFrame) -> DataFrame:
    """(tok, doc, n, comp) of the tokens whose docs, but for the star's own, are in several components. Of a token whose docs are
    all in one, a piece sends no more than that component, however many they are."""
    none = lambda kind: F.lit(None).cast(kind)
    bodies = chosen.filter("kind = 1").select("piece", none("long").alias("doc"), none("long").alias("n"), none("long").alias("comp"), "body")
    named = chosen.filter("kind = 2").select("piece", F.col("b").alias("doc"), F.col("a").alias("n")).join(comps, F.col("doc") == F.col("id"), "left")
    named = named.select("piece", "doc", "n", F.coalesce("comp", "doc").alias("comp"), none("binary").alias("body"))
    met = bodies.unionByName(named).repartition(parts(chosen.sparkSession), "piece").sortWithinPartitions("piece", F.col("body").isNull(), "doc")
    ends = np.iinfo(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]):
        for _, ((*_, body), *rows) in grouped(batches, 0):
            doc, n, comp = (np.array(x, np.int64) for x in list(zip(*rows))[1:4])
            keys, who, at, lead = opened(body, U64, *[np.uint32] * 3)
            who, at = who[lead == 0], at[lead == 0]
            low, high = np.full(len(keys), ends.max), np.full(len(keys), ends.min)
            np.minimum.at(low, at, comp[who])
            np.maximum.at(high, at, comp[who])
            yield keys, [low, high], sized(doc, n, comp, who, at)

    def answer(keys, cols):
        return [np.where(cols[0] < cols[1], keys, U64(0))]

    def finish(number: int, body: bytes, cols: list[np.ndarray], _) -> Iterator[pa.RecordBatch]:
        doc, n, comp, who, at = opened(body, *[np.int64] * 3, *[np.uint32] * 2)
        tok = cols[0][at]
        who, tok = who[tok > 0], tok[tok > 0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tok.view(np.int64), doc[who], n[who], comp[who])], ["tok", "doc", "n", "comp"])

    answered = ask(met, cut, [np.minimum, np.maximum], answer)
    return keep(hear(answered, finish, [U64], "tok long, doc long, n long, comp long"), "open")


def _cells(num: int, den: int, every: bool = False):
    """Links between the left and the right sets of each cell, as many as connect what its links connect (or every one); sets of one
    component are not compared. Sketches come first, then exact intersections of one set with all that are left."""

    def one(rows: list) -> Iterator[tuple[int, int]]:
        doc, comp, n = (np.array(x, np.int64) for x in list(zip(*rows))[1:4])
        left, right = (np.flatnonzero(x) for x in list(zip(*rows))[4:6])
        sketch = np.array([r[7:] for r in rows], np.int64).view(U64)
        starts, number, seen, done = np.cumsum(n) - n, None, None, np.zeros(len(rows), bool)
        for x in left:
            done[x] = True
            y = right[(comp[right] != comp[x]) & ~done[right]]
            y = y[den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])]
            apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            y = y[apart * (num + den) <= (n[x] + n[y]) * (den - num)]
            if not len(y):
                continue
            if number is None:
                number = np.unique(np.concatenate([np.frombuffer(r[6], U64) for r in rows]), return_inverse=True)[1]
                seen = np.zeros(len(number), np.int32)
            own = number[starts[x] : starts[x] + n[x]]
            seen[own] = 1
            both = np.add.reduceat(seen[number[ragged(starts[y], n[y])]], np.cumsum(n[y]) - n[y])
            seen[own] = 0
            y = y[den * both >= num * (n[x] + n[y] - both)]
            if every:
                yield from zip([int(doc[x])] * len(y), doc[y].tolist())
            elif len(y):
                met, first = np.unique(comp[y], return_index=True)
                yield from zip([int(doc[x])] * len(met), doc[y[first]].tolist())
                comp[np.isin(comp, met)] = comp[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 0):
            if found := list(one(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return run


def _left_over(chosen: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int, every: bool = False) -> DataFrame | None:
    """Links that the stars have left out, as many as connect (or every one); None if every token's docs are in one component.

    Tokens that hang together by their docs are a span. A span that fits in a cell is compared in one; the tokens of larger
    ones each for itself. Of each such group the docs outside its largest component (left) meet all (right), in cells of
    about CELL sets and ITEMS shingles on either side, however large the group is."""
    seats = _open(chosen, comps)
    if seats.isEmpty():
        drop(seats)
        return None
    first = seats.groupBy("tok").agg(F.min("doc").alias("first"))
    edges = keep(seats.join(first, "tok").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), "edges")
    of = components(edges)
    spans = seats.select("tok", "doc", "n", "comp").join(of.select(F.col("id").alias("doc"), F.col("comp").alias("span")), "doc", "left").withColumn("span", F.coalesce("span", "doc"))
    spans = keep(spans, "spans")
    size = spans.select("span", "doc", "n").distinct().groupBy("span").agg(F.count("*").alias("m"), F.sum("n").alias("items"))
    large = size.select("span", ((F.col("m") > CELL) | (F.col("items") > ITEMS)).alias("large"))
    key = F.when(F.col("large"), F.col("tok")).otherwise(F.col("span")).alias("key")
    members = keep(spans.join(large, "span").select("large", key, "doc", "n", "comp").distinct(), "members")
    by = members.groupBy("large", "key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("items"))
    group = by.groupBy("large", "key").agg(F.sum("m").alias("m"), F.sum("items").alias("items"), F.max_by(F.struct("comp", "m", "items"), F.struct("m", "comp")).alias("main"))
    pieces = lambda m, items: F.greatest(F.lit(1), F.ceil(m / CELL), F.ceil(items / ITEMS)).cast("int")
    group = group.select("large", "key", F.col("main.comp").alias("main"), pieces(F.col("m"), F.col("items")).alias("rights"), pieces(F.col("m") - F.col("main.m"), F.col("items") - F.col("main.items")).alias("lefts"))
    full = members.join(keep(group, "groups"), ["large", "key"]).withColumns({"l": F.pmod(F.xxhash64("doc"), "lefts").cast("int"), "r": F.pmod(F.xxhash64("doc", F.lit(1)), "rights").cast("int"), "outside": F.col("comp") != F.col("main")})
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("l"), F.col("r").alias("r")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.col("l").alias("l"), j.alias("r")))
    cell = F.explode(F.when(F.col("outside"), F.array_union(as_right, as_left)).otherwise(as_right)).alias("cell")
    put = full.select("large", "key", "doc", "comp", "outside", F.col("l").alias("own_l"), F.col("r").alias("own_r"), cell)
    put = put.select(F.concat_ws("/", "large", "key", "cell.l", "cell.r").alias("cell"), "doc", "comp", (F.col("outside") & (F.col("cell.l") == F.col("own_l"))).alias("is_left"), (F.col("cell.r") == F.col("own_r")).alias("is_right"))
    met = keep(put, "cells").join(sets, "doc").select("cell", "doc", "comp", "n", "is_left", "is_right", "items", *SKETCH)
    met = met.repartition(parts(sets.sparkSession), "cell").sortWithinPartitions("cell")
    out = keep(met.mapInArrow(trimmed(_cells(num, den, every)), "a long, b long"), "left")
    drop(seats, edges, spans, members)
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id, size and set key (items null), and the distinct sets that may have a link; in one kept table."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = parts(spark)

    def keys(batches):
        for batch in batches:
            for _, h, _ in shingle_sets(batch.column(1), shingle):
                yield h

    bits = _sketch.repeated(base, keys, depth=1)
    kind = "doc long, n long, k1 long, k2 long, items binary" + "".join(f", {c} long" for c in SKETCH)
    made = base.mapInArrow(trimmed(_sets(shingle, num, den, bits)), _KIND).repartition(n, "part").sortWithinPartitions("kind", "k1", "k2", "doc")
    info = keep(made.mapInArrow(trimmed(_classes), kind), "info")
    bits.destroy()
    sets = info.filter("items is not null").select("doc", "n", "items", *SKETCH)
    return info, sets


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs; component_id is the smallest id reachable by links."""
    info, sets = _prepared(docs, id_col, text_col, shingle, num, den)
    classes = info.filter("items is not null").select("k1", "k2", F.col("doc").alias("rep"))

    chosen = keep(_looked_up(sets, num, den), "chosen")
    possible = _possible(chosen.filter("kind = 0").select("a", "b").distinct(), sets, num, den)
    links = _spanning(possible, sets, num, den)
    comps = components(links)
    more = _left_over(chosen, comps, sets, num, den)
    if more is not None:
        comps = components(keep(links.unionByName(more), "links"))
    named = keep(classes.join(comps, classes.rep == comps.id, "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp")), "named")
    drop(chosen, possible)
    thin = info.filter("items is null").select("doc", "n", "k1", "k2")
    return thin.join(named, ["k1", "k2"], "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "doc")).otherwise(F.col("doc")).alias("component_id"),
    )


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """All links, without expanding copies. Pairs (a, b), a < b, of classes whose different sets are linked, a class being named by
    the smallest id that has its set; and one row per row of docs: doc_id, class_id (null without words or id) and n_links, the
    number of rows its own is linked with, copies included.

    Every pair within a group is compared by sketch, so unlike jaccard_join() the work grows with the square of a group of near
    copies, as its links do. Ids should be distinct: rows that share an id are one node, so a link of one is a link of all.
    """
    info, sets = _prepared(docs, id_col, text_col, shingle, num, den)
    spark = docs.sparkSession
    chosen = keep(_looked_up(sets, num, den, stars=False), "chosen")
    alone = spark.createDataFrame([], "id long, comp long")
    found = _left_over(chosen, alone, sets, num, den, every=True)
    drop(chosen)
    none = spark.createDataFrame([], "a long, b long")
    pairs = none if found is None else keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "pairs")
    thin = info.filter("items is null").select("doc", "n", "k1", "k2")
    rows = thin.filter("doc is not null and n > 0")
    named = rows.groupBy("k1", "k2").agg(F.min("doc").alias("class_id"), F.count("*").alias("own"))
    size = named.select(F.col("class_id").alias("y"), "own")
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    others = both.join(size, "y").groupBy(F.col("x").alias("class_id")).agg(F.sum("own").alias("others"))
    told = keep(named.join(others, "class_id", "left").select("k1", "k2", "class_id", (F.coalesce("others", F.lit(0)) + F.col("own") - 1).alias("n_links")), "told")
    mine = F.col("doc").isNotNull() & (F.col("n") > 0)
    met = thin.join(told, ["k1", "k2"], "left")
    return pairs, met.select(F.col("doc").alias("doc_id"), F.when(mine, F.col("class_id")).alias("class_id"), F.when(mine, F.col("n_links")).otherwise(0).alias("n_links"))
