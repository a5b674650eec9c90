import random

import pytest

from stanchion.operators import similarity, splits


def prints(spark, rows):
    return spark.createDataFrame(list(rows.items()), "stem string, hash long")


def test_within(spark):
    a = similarity.within(prints(spark, {"a": 0, "b": 15}), prints(spark, {"x": 1, "y": 240}), 1).collect()
    assert [tuple(r) for r in a] == [("a", "x", 1)]
    b = similarity.within(prints(spark, {"a": 0, "b": 1, "c": 3}), prints(spark, {"x": 0}), 2).collect()
    assert sorted((r.query, r.distance) for r in b) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_bands_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    base = [rng.getrandbits(64) for _ in range(30)]
    near = lambda v: v ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7)))
    q = {f"q{i}": near(rng.choice(base)) for i in range(60)}
    r = {f"r{i}": near(v) for i, v in enumerate(base)}
    want = sorted((x, y, (a ^ b).bit_count()) for x, a in q.items() for y, b in r.items() if (a ^ b).bit_count() <= radius)
    got = similarity.within(prints(spark, {k: signed(v) for k, v in q.items()}), prints(spark, {k: signed(v) for k, v in r.items()}), radius)
    assert sorted(map(tuple, got.collect())) == want
    words = similarity.within_words(prints(spark, {k: signed(v) for k, v in q.items()}), prints(spark, {k: signed(v) for k, v in r.items()}), radius, ["hash"])
    assert sorted(map(tuple, words.collect())) == want


def test_many_references(spark):
    """More than 100,000 rows, with and without a side that is broadcast, against plain integers."""
    from pyspark.sql import functions as F

    r = spark.range(100_001).select(F.col("id").alias("stem"), (F.col("id") * 2654435761).alias("hash"))
    q = spark.createDataFrame([(1, 0), (2, 7 * 2654435761), (3, -1)], "stem long, hash long")
    far = {(i, j): ((h ^ j * 2654435761) & (1 << 64) - 1).bit_count() for i, h in ((1, 0), (2, 7 * 2654435761), (3, -1)) for j in range(100_001)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (kept, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = similarity.within_words(q, r, 14, ["hash"]).collect()
            near = similarity.nearest(q, r, ["hash"]).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        assert {(x.query, x.reference): x.distance for x in got} == {k: n for k, n in far.items() if n <= 14} and len(got) > 3
        assert {x.query: x.distance for x in near} == {i: min(far[i, j] for j in range(100_001)) for i in (1, 2, 3)}


def test_pieces_prove_the_radius():
    """Whatever way the differing bits fall on the pieces, one piece is within its own radius."""
    for pieces in range(1, 7):
        for radius in range(12):
            radii = similarity.piece_radii(pieces, radius)
            worst = sum(r + 1 for r in radii)  # the fewest bits with which every piece is beyond its radius
            assert worst == radius + 1 and len(radii) == pieces


@pytest.mark.parametrize("per_word", [None, 1, 2, 3, 5])
def test_large_radius_and_nearest_against_all_pairs(spark, per_word):
    """Words of 16 bits, shared fingerprints, nulls, repeated rows: any number of pieces gives the pairs of all with all."""
    rng = random.Random(3)
    bases = [(rng.getrandbits(16), rng.getrandbits(16)) for _ in range(12)]
    flip = lambda v: v ^ sum(1 << i for i in rng.sample(range(16), rng.randint(0, 5)))
    make = lambda n: [(i, *(map(flip, rng.choice(bases)) if i % 4 else bases[0])) for i in range(n)]
    q, r = make(60), make(70)
    schema = "stem long, lo long, hi long"
    dq = spark.createDataFrame([*q, q[0], (97, None, 3), (98, 5, None)], schema)
    dr = spark.createDataFrame([*r, r[1], (99, None, 3)], schema)
    far = {(a[0], b[0]): (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() for a in q for b in r}
    for radius in (0, 4, 9) if per_word is None else (9,):
        got = similarity.within_words(dq, dr, radius, ["lo", "hi"], bits=16, per_word=per_word)
        assert sorted(map(tuple, got.collect())) == sorted((*k, n) for k, n in far.items() if n <= radius)
    if per_word is None:
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
        near = {x.query: x.distance for x in similarity.nearest(dq, dr, ["lo", "hi"], bits=16).collect()}
        assert near == {a[0]: min(far[a[0], b[0]] for b in r) for a in q}
        assert similarity.nearest(dq, dr.limit(0), ["lo", "hi"], bits=16).count() == 0
        assert similarity.nearest(dq.limit(0), dr, ["lo", "hi"], bits=16).count() == 0


def test_leakage_and_exclusion(spark):
    pairs = spark.createDataFrame([("chv", "a", "sh", "x", 1), ("chv", "b", "sh", "y", 2)], "dataset_a string, a string, dataset_b string, b string, distance int")
    sp = spark.createDataFrame([("chv", "test", "a"), ("sh", "train", "x"), ("chv", "train", "b"), ("sh", "val", "y")], "dataset string, split string, stem string")
    assert [r.evaluated for r in similarity.leaking(pairs, sp, "sh", "chv").collect()] == ["a"]
    assert [r.evaluated for r in similarity.leaking(pairs, sp, "chv", "sh").collect()] == ["y"]
    with pytest.raises(ValueError):
        similarity.leaking(pairs, sp, "chv", "chv")
    kept = similarity.without(sp, similarity.exclusions(pairs))
    assert {(r.split, r.stem) for r in kept.collect()} == {("train", "x"), ("train", "b")}


def test_splits(spark):
    items = spark.createDataFrame([(i, "common" if i < 20 else "rare") for i in range(40)], "k int, stratum string")
    sides = splits.stratified(items, 0.5, "k").groupBy("stratum", "side").count().collect()
    assert {(r.stratum, r.side): r["count"] for r in sides} == {(s, x): 10 for s in ("common", "rare") for x in ("minority", "majority")}
    assert splits.stratified(items.limit(30).withColumn("stratum", items.stratum.substr(1, 0)), 0.1, "k").filter("side = 'minority'").count() == 3
    import hashlib

    want = hashlib.sha1("\n".join(sorted(["b", "a", "c"])).encode()).hexdigest()[:12]
    got = splits.split_ids(spark.createDataFrame([("t", x) for x in "bac"], "split string, stem string"), ["split"], "stem").first()
    assert (got.n, got.id) == (3, want)
    assert splits.same_set(items, items) and not splits.same_set(items, items.union(items.limit(1)))
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    boxes = spark.createDataFrame([(1, 2), (1, 0), (1, 2)], "image_id long, cls int")
    assert {r.image_id: r.stratum for r in splits.strata(images, boxes).collect()} == {1: "0-2", 2: "background"}


def test_words_in_pieces(spark):
    """Small radii join pieces of several words, large ones compare all: both against brute force."""
    rng = random.Random(6)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(30)]
    rows = []
    for i in range(160):
        lo, hi = rng.choice(base)
        for _ in range(rng.randint(0, 9)):
            if rng.random() < 0.5:
                lo ^= 1 << rng.randrange(63)
            else:
                hi ^= 1 << rng.randrange(63)
        rows.append((i, lo, hi))
    df = spark.createDataFrame(rows, "stem long, lo long, hi long")
    for radius in (1, 3, 8, 11, 14, 40):
        got = sorted((r.query, r.reference, r.distance) for r in similarity.within_words(df.filter("stem % 3 = 0"), df, radius, ["lo", "hi"]).collect())
        far = [(a, b, (x ^ u).bit_count() + (y ^ v).bit_count()) for a, x, y in rows if a % 3 == 0 for b, u, v in rows]
        assert got == sorted(t for t in far if t[2] <= radius), radius


@pytest.mark.parametrize("radius", [4, 9])
def test_few_bits_used(spark, radius):
    """Products of small numbers leave the top bits equal in all: no piece may hold only these, or all would meet all."""
    a, b = ([(i, i * 2654435761) for i in range(lo, hi)] for lo, hi in ((0, 4000), (50, 350)))
    weights = similarity._weights(*(similarity._shares(spark.createDataFrame(x, "stem long, hash long").select("hash"), 64)[1] for x in (a, b)))
    pieces = similarity.cut_words(weights, 4)
    assert len(pieces) == 4 and min(tells for *_, tells in pieces) > 8
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in a for j, y in b if (x ^ y).bit_count() <= radius)
    sides = [spark.createDataFrame(x, "stem long, hash long") for x in (a, b)]
    assert sorted(map(tuple, similarity.within(*sides, radius).collect())) == want and len(want) >= 300
    assert sorted((j, i, d) for i, j, d in similarity.within(*sides[::-1], radius).collect()) == want


def test_blocks_against_all_pairs(spark, monkeypatch):
    """Blocks of fingerprints, of uneven number, with nulls and rows that stand twice."""
    monkeypatch.setattr(similarity, "LEAST_SIDE", 32)
    rng = random.Random(8)
    make = lambda n: [(i, rng.getrandbits(64) - (1 << 63), rng.getrandbits(32)) for i in range(n)] + [(n, 5, 5)] * 2
    q, r = make(100), make(70)
    one, other = (spark.createDataFrame([*x, (-1, None, 1)], "stem long, lo long, hi long") for x in (q, r))
    far = {(a[0], b[0]): ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() + (a[2] ^ b[2]).bit_count() for a in q for b in r}
    got = similarity.within_words(one, other, 40, ["lo", "hi"], per_word=0)
    assert sorted(map(tuple, got.collect())) == sorted((*k, n) for k, n in far.items() if n <= 40)
    near = similarity.nearest(one, other, ["lo", "hi"], per_word=0)
    assert sorted(map(tuple, near.collect())) == sorted((i, min(far[i, b[0]] for b in r)) for i in {a[0] for a in q})


def test_which_way_costs_less():
    """A large radius over many fingerprints goes by blocks, a small one by pieces."""
    even = [[1.0] * 32] * 2
    at = lambda n, radius: similarity._by_blocks(n, n, similarity.pieces_within(n, n, radius, even)[1])
    assert at(300_000, 18) and not at(300_000, 4) and not at(1000, 18)
    assert similarity._by_blocks(300_000, 300_000, similarity.pieces_nearest(300_000, 300_000, even)[1])
