"""Fingerprints within a Hamming radius, nearest fingerprints, and what leaks between datasets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..sources.tables import kept


def within(query: DataFrame, reference: DataFrame, radius: int, hash_: str = "hash", by: str = "stem") -> DataFrame:
    """(query, reference, distance) of all pairs within the radius, of fingerprints of 64 bits in one column."""
    return within_words(query, reference, radius, [hash_], by)


#: Pieces are at least so wide; of narrower ones nearly all would agree by chance.
LEAST_BITS = 4
#: The most neighbours of a piece that are looked up.
MOST_PROBES = 1 << 17
#: Pairs that blocks compare in the time in which one row goes through a join, and rows that setting blocks up is worth.
PAIRS_A_ROW, BLOCKS_COST = 100, 1_000_000
#: Fingerprints of a block, least and most, and pairs that are compared at once.
LEAST_SIDE, MOST_SIDE, AT_ONCE = 1024, 16384, 1 << 17


def told(a: float, b: float) -> float:
    """What agreement in a bit tells, in bits, if it is set in these shares of two datasets: 1 for an even one, 0 for one that is the same in all."""
    return min(1.0, -math.log2(max(a * b + (1 - a) * (1 - b), 0.25)))


def cut_words(weights: list[list[float]], per_word: int) -> list[tuple[int, list[int], float]]:
    """Pieces (word, its bits, what agreement in them tells): each word's bits, but those that never differ, in so many runs that tell the same.

    Fingerprints that use few of their bits, as products of small numbers do, would else have pieces in which all agree."""
    out = []
    for word, own in enumerate(weights):
        live, total, seen = [i for i, w in enumerate(own) if w > 0], sum(own), 0.0
        runs: list[list[int]] = [[] for _ in range(per_word)]
        for i in live:
            runs[min(int((seen + own[i] / 2) / total * per_word), per_word - 1)].append(i)
            seen += own[i]
        out += [(word, run, sum(own[i] for i in run)) for run in runs if run]
    return out or [(0, [], 0.0)]


def piece_radii(pieces: int, radius: int) -> list[int]:
    """How far a piece may be off: two fingerprints within the radius have a piece within its own number (-1: never looked at).

    With radius = pieces * r + a, either one of the first a + 1 pieces is within r, or one of the others is within r - 1;
    otherwise the pieces would be off by more than the radius together.
    """
    r, a = divmod(radius, pieces)
    return [r] * (a + 1) + [r - 1] * (pieces - a - 1)


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, i) for i in range(radius + 1))


def expected_rows(asking: int, asked: int, pieces: list, radii: list[int]) -> float:
    """Rows to be expected: probes of those that ask, pieces of the others, and pairs that meet."""
    each = [(ball(len(run), r), tells) for (_, run, tells), r in zip(pieces, radii) if r >= 0]
    if max(n for n, _ in each) > MOST_PROBES:
        return math.inf
    return asking * sum(n + asked * min(1.0, n / 2**tells) for n, tells in each) + asked * len(each)


def pieces_within(asking: int, asked: int, radius: int, weights: list[list[float]]) -> tuple[int, float]:
    """The number of pieces of a word with which the fewest rows are to be expected, and that number of rows."""

    def rows(per_word: int) -> float:
        pieces = cut_words(weights, per_word)
        return expected_rows(asking, asked, pieces, piece_radii(len(pieces), radius))

    return _fewest(rows, weights)


def pieces_nearest(asking: int, asked: int, weights: list[list[float]]) -> tuple[int, float]:
    """The same for nearest(), if the nearest of so many even fingerprints lies where one of them can be expected at all."""
    total = sum(w > 0 for own in weights for w in own)
    far = next(r for r in range(total + 1) if asked * ball(total, r) >= 2**total)

    def rows(per_word: int) -> float:
        pieces = cut_words(weights, per_word)
        return expected_rows(asking, asked, pieces, [min(far // len(pieces), len(run)) for _, run, _ in pieces])

    return _fewest(rows, weights)


def _fewest(rows, weights: list[list[float]]) -> tuple[int, float]:
    most = max(1, len(weights[0]) // LEAST_BITS)
    best = min(range(1, most + 1), key=rows)
    return best, rows(best)


def _by_blocks(asking: int, asked: int, rows: float) -> bool:
    return asking * asked / PAIRS_A_ROW + BLOCKS_COST < rows


def _prints(df: DataFrame, words: list[str], prefix: str) -> DataFrame:
    """Each fingerprint once: rows that share one are looked up together."""
    return df.select(*(F.col(w).alias(f"{prefix}{w}") for w in words)).dropna().distinct()


def _shares(prints: DataFrame, bits: int) -> tuple[int, list[list[float]]]:
    """How many rows there are, and in which share of them each bit of each word is set."""
    bit = lambda w, i: F.avg(F.shiftrightunsigned(w, i).bitwiseAND(F.lit(1))).alias(f"{w}_{i}")
    row = prints.agg(F.count("*").alias("n"), *(bit(w, i) for w in prints.columns for i in range(bits))).first()
    return row.n, [[row[f"{w}_{i}"] or 0.0 for i in range(bits)] for w in prints.columns]


def _weights(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[told(x, y) for x, y in zip(own, other)] for own, other in zip(a, b)]


def _signed(bits) -> int:
    value = sum(1 << i for i in bits)
    return value - (1 << 64) if value >> 63 else value


def _pieces(prints: DataFrame, words: list[str], prefix: str, pieces: list, only: list[int] | None = None) -> DataFrame:
    """prints with (piece, value), one row for each piece (or those of the given numbers)."""
    of = lambda i: F.struct(F.lit(i).alias("piece"), F.col(f"{prefix}{words[pieces[i][0]]}").bitwiseAND(F.lit(_signed(pieces[i][1])).cast("long")).alias("value"))
    return prints.select("*", F.inline(F.array(*(of(i) for i in (range(len(pieces)) if only is None else only)))))


def _masks(spark, pieces: list, least: list[int], most: list[int]) -> DataFrame:
    """(piece, mask): what a piece is changed by at distances from `least` to `most`; up to MOST_PROBES a piece."""
    rows = [(i, _signed(bits)) for i, ((_, run, _), a, b) in enumerate(zip(pieces, least, most)) for n in range(a, b + 1) for bits in itertools.combinations(run, n)]
    return spark.createDataFrame(rows, "piece int, mask long")


def _far(words: list[str]):
    far = F.lit(0)
    for w in words:
        far = far + B.hamming(F.col(f"q_{w}"), F.col(f"r_{w}"))
    return far


def _met(asking: DataFrame, asked: DataFrame, masks: DataFrame, words: list[str]) -> DataFrame:
    """Pairs of fingerprints that meet in a piece, with their distance. asking, asked: rows of _pieces()."""
    probes = asking.join(F.broadcast(masks), "piece").withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    return probes.join(asked, ["piece", "value"]).withColumn("distance", _far(words))


def _facing(q: DataFrame, r: DataFrame, words: list[str], queries: int, references: int) -> DataFrame:
    """(_q, _r): each block of queries with each block of references, as arrays of fingerprints; an equi join on the number of the block."""
    side = max(LEAST_SIDE, min(MOST_SIDE, -(-max(queries, references) // 16)))
    n, m = max(1, -(-queries // side)), max(1, -(-references // side))

    def blocks(prints: DataFrame, prefix: str, count: int) -> DataFrame:
        number = F.pmod(F.xxhash64(*prints.columns), F.lit(count)).alias(f"{prefix}block")
        # an array for each word, in the same order of rows
        return prints.groupBy(number).agg(F.collect_list(F.struct(*prints.columns)).alias("_p")).select(f"{prefix}block", *(F.col(f"_p.{prefix}{w}") for w in words))

    every = blocks(q, "q_", n).withColumn("r_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    return every.join(blocks(r, "r_", m), "r_block").repartition(min(n * m, 4096), "q_block", "r_block")


def _compared(words: list[str], pick):
    """What a task does with pairs of blocks: pick(distances) of so many queries at once tells which rows are given."""

    kind = "uint8" if len(words) < 4 else "uint16"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, r = ([np.array(row[p + w], "int64") for w in words] for p in ("q_", "r_"))
                step = max(1, AT_ONCE // len(r[0]))
                for at in range(0, len(q[0]), step):
                    far = sum(np.bitwise_count((x[at : at + step, None] ^ y[None, :]).view("uint64")).astype(kind) for x, y in zip(q, r))
                    a, b, distance = pick(far)
                    own = {f"q_{w}": x[at : at + step][a] for w, x in zip(words, q)} | ({f"r_{w}": y[b] for w, y in zip(words, r)} if b is not None else {})
                    if len(distance):
                        yield pa.RecordBatch.from_pydict({**own, "distance": distance.astype("int32")})

    return run


def _near(radius: int):
    def pick(far):
        a, b = np.nonzero(far <= radius)
        return a, b, far[a, b]

    return pick


def _least(far):
    return np.arange(len(far)), None, far.min(axis=1)


def within_words(query: DataFrame, reference: DataFrame, radius: int, words: list[str], by: str = "stem", bits: int = 64, per_word: int | None = None) -> DataFrame:
    """(query, reference, distance) of all pairs within the radius, of fingerprints in several columns of `bits` bits each.

    Multi-index: the words are cut into pieces that tell the same (cut_words); two fingerprints within the radius have a piece that
    differs in few bits (piece_radii), so the smaller side looks up all values of its pieces that are so near, by equality. How many
    pieces there are follows from the number of rows. Where so many pairs would meet that comparing all costs less (a large radius),
    blocks of fingerprints are compared (per_word 0). A fingerprint that many rows share is looked up once. Nulls match nothing.
    """
    q, r = _prints(query, words, "q_"), _prints(reference, words, "r_")
    (n, a), (m, b) = _shares(q, bits), _shares(r, bits)
    weights = _weights(a, b)
    if per_word is None:
        per_word, rows = pieces_within(min(n, m), max(n, m), radius, weights)
        if _by_blocks(n, m, rows):
            per_word = 0
    if per_word == 0:
        kind = ", ".join(f"{p}{w} long" for p in ("q_", "r_") for w in words) + ", distance int"
        pairs = _facing(q, r, words, n, m).mapInArrow(_compared(words, _near(radius)), kind)
    else:
        pieces = cut_words(weights, per_word)
        radii = [min(x, len(run)) for x, (_, run, _) in zip(piece_radii(len(pieces), radius), pieces)]
        masks, used = _masks(query.sparkSession, pieces, [0] * len(pieces), radii), [i for i, x in enumerate(radii) if x >= 0]
        cut = [_pieces(q, words, "q_", pieces, used), _pieces(r, words, "r_", pieces, used)]
        met = _met(*(cut if n <= m else cut[::-1]), masks, words)
        pairs = met.filter(F.col("distance") <= radius).select(*(f"{p}{w}" for p in ("q_", "r_") for w in words), "distance").distinct()
    named = lambda df, n: df.select(F.col(by).alias(n), *(F.col(w).alias(f"{n[0]}_{w}") for w in words))
    out = pairs.join(named(query, "query"), [f"q_{w}" for w in words]).join(named(reference, "reference"), [f"r_{w}" for w in words])
    return out.select("query", "reference", "distance").distinct()


def nearest(query: DataFrame, reference: DataFrame, words: list[str], by: str = "stem", bits: int = 64, per_word: int | None = None) -> DataFrame:
    """(query, distance): least distance to any reference row.

    The same pieces, probed at a distance of 0, 1, 2, .. bits in turn. When all pieces have been probed up to s - 1 and j of
    them at s, whatever lies within pieces * s + j - 1 has been met, so a query whose best is no further leaves. From two
    bits on a distance is probed in thirds of the pieces, as it costs more than all before it together. State goes
    through written tables from round to round. Where the probes would cost more than comparing all, blocks are compared (per_word 0).
    """
    spark = query.sparkSession
    q, r = _prints(query, words, "q_"), _prints(reference, words, "r_")
    (asking, a), (n, b) = _shares(q, bits), _shares(r, bits)
    weights = _weights(a, b)
    asked_for = query.select(F.col(by).alias("query"), *(F.col(w).alias(f"q_{w}") for w in words))
    keys = [f"q_{w}" for w in words]
    if per_word is None and n:
        per_word, rows = pieces_nearest(asking, n, weights)
        if _by_blocks(asking, n, rows):
            per_word = 0
    if per_word == 0:
        kind = ", ".join(f"q_{w} long" for w in words) + ", distance int"
        best = _facing(q, r, words, asking, n).mapInArrow(_compared(words, _least), kind).groupBy(*keys).agg(F.min("distance").alias("best"))
        return asked_for.join(best, keys).groupBy("query").agg(F.min("best").alias("distance"))
    pieces = cut_words(weights, per_word or 1)
    widths = [len(run) for _, run, _ in pieces]
    index = kept(_pieces(r, words, "r_", pieces), "index")
    open_, done = kept(q.withColumn("best", F.lit(None).cast("int")), "round"), []
    m = len(widths)
    for s, part in ((s, part) for s in range(max(widths) + 1) for part in (_thirds(m) if s > 1 else [range(m)])):
        if not n or open_.isEmpty():
            break
        probed = [i for i in part if s <= widths[i]]
        if not probed:
            continue
        masks = _masks(spark, pieces, [s] * m, [s if i in probed else -1 for i in range(m)])
        # a probe hands on only the least distance of what it met, before any shuffle of pairs
        met = _met(_pieces(open_.select(*keys), words, "q_", pieces), index, masks, words)
        found = met.groupBy(*keys).agg(F.min("distance").alias("now"))
        told_ = open_.join(found, keys, "left").select(*keys, F.least("best", "now").alias("best"))
        told_ = kept(told_, "round")
        proven = F.coalesce(F.col("best") <= m * s + part[-1], F.lit(False))
        done.append(told_.filter(proven))
        open_ = told_.filter(~proven)
    if not done:
        return asked_for.select("query", F.lit(0).alias("distance")).limit(0)
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    return asked_for.join(best, keys).groupBy("query").agg(F.min("best").alias("distance"))


def _thirds(m: int) -> list[range]:
    cut = sorted({round(i * m / 3) for i in range(4)})
    return [range(a, b) for a, b in zip(cut, cut[1:])]


def leaking(pairs: DataFrame, splits: DataFrame, trained: str, other: str, evaluated: list[str] | None = None) -> DataFrame:
    """Pairs with one side in an evaluation split of dataset `other` and the other side in the training split of `trained`.

    pairs: (dataset_a, a, dataset_b, b, distance), in either direction; splits: (dataset, split, stem).
    """
    if trained == other:
        raise ValueError("the two datasets are the same")
    evaluated = evaluated or ["val", "test"]
    one = pairs.select(F.col("dataset_a").alias("ds"), F.col("a").alias("x"), F.col("dataset_b").alias("ds2"), F.col("b").alias("y"), "distance")
    two = pairs.select(F.col("dataset_b").alias("ds"), F.col("b").alias("x"), F.col("dataset_a").alias("ds2"), F.col("a").alias("y"), "distance")
    both = one.unionByName(two).filter((F.col("ds") == other) & (F.col("ds2") == trained))
    held = splits.filter((F.col("dataset") == other) & F.col("split").isin(*evaluated)).select(F.col("stem").alias("x"))
    learned = splits.filter((F.col("dataset") == trained) & (F.col("split") == "train")).select(F.col("stem").alias("y"))
    return both.join(held, "x", "left_semi").join(learned, "y", "left_semi").select(F.col("x").alias("evaluated"), F.col("y").alias("trained"), "distance").distinct()


def exclusions(pairs: DataFrame) -> DataFrame:
    """(dataset, stem) of both sides of all pairs, once each."""
    a = pairs.select(F.col("dataset_a").alias("dataset"), F.col("a").alias("stem"))
    return a.unionByName(pairs.select(F.col("dataset_b").alias("dataset"), F.col("b").alias("stem"))).distinct()


def without(splits: DataFrame, excluded: DataFrame, evaluated: list[str] | None = None) -> DataFrame:
    """splits with the excluded stems taken out of evaluation splits, never out of training."""
    evaluated = evaluated or ["val", "test"]
    own = F.col("split").isin(*evaluated)
    return splits.filter(own).join(excluded, ["dataset", "stem"], "left_anti").unionByName(splits.filter(~own).select("dataset", "stem", "split"))


def split_of(stems: DataFrame, splits: DataFrame, order: list[str]) -> DataFrame:
    """stems with the first split, in `order`, that has them; 'none' for the rest."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("split"))
    first = splits.filter(rank > 0).groupBy("dataset", "stem").agg(F.min_by("split", rank).alias("split"))
    return stems.join(first, ["dataset", "stem"], "left").withColumn("split", F.coalesce("split", F.lit("none")))
