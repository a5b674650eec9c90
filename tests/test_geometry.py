import math
from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from stanchion.functions import bits, geometry, names, polygon


def one(spark, *cols):
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    return r[0] if len(cols) == 1 else tuple(r)


def lit(*v):
    return geometry.Box(*(F.lit(float(x)) for x in v))


def test_measures(spark):
    p, i = lit(0.5, 0.5, 0.4, 0.8), lit(0.5, 0.15, 0.08, 0.06)
    assert math.isclose(one(spark, geometry.containment(i, p)), 1.0)
    assert one(spark, geometry.containment(lit(0.5, 0.5, 0, 0), p)) == 0.0
    assert math.isclose(one(spark, geometry.iou(lit(0.25, 0.5, 0.5, 1), lit(0.5, 0.5, 0.5, 1))), 1 / 3)
    assert one(spark, geometry.iou(lit(0.1, 0.1, 0, 0), lit(0.1, 0.1, 0, 0))) == 0.0
    assert one(spark, geometry.anchor_distance(i, F.lit(1), lit(0.5, 0.5, 0, 0))) == float("inf")
    assert one(spark, geometry.overlaps(lit(0.25, 0.5, 0.5, 1), lit(0.75, 0.5, 0.5, 1))) is False


def test_pixels_and_sizes(spark):
    b = geometry.from_pixels(*(F.lit(v) for v in (100, 200, 300, 600, 1000, 800)))
    assert one(spark, *b) == (0.2, 0.5, 0.2, 0.5)
    assert one(spark, *geometry.fitted(F.lit(4475), F.lit(4057), 640)) == (640, 580)
    assert one(spark, *geometry.fitted(F.lit(100), F.lit(1), 640)) == (100, 1)
    assert one(spark, geometry.state_code(F.lit(True), F.lit(False)), geometry.state_code(F.lit(True), F.lit(True))) == ("WH", "WHV")
    assert one(spark, *geometry.decode_state(F.lit(7))) == (None, None)


#: A kite, a hexagon with one vertex drawn inwards, and a zigzag with two; corners are multiples of 1/16.
SHAPES = [[(2, 7), (9, 1), (14, 7), (9, 15)], [(1, 3), (9, 1), (15, 6), (10, 8), (14, 13), (5, 15)], [(1, 1), (15, 2), (11, 6), (15, 10), (9, 9), (2, 14), (5, 7)]]


def winding(shape, x, y):
    """Where (x, y) is, in exact fractions: 'edge', 'in' or 'out'. By how often the boundary turns around the point."""
    turns = 0
    for (ax, ay), (bx, by) in zip(shape, shape[1:] + shape[:1]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return "edge"
        turns += (ay <= y < by and side > 0) - (by <= y < ay and side < 0)
    return "in" if turns else "out"


@pytest.mark.parametrize("shape", SHAPES)
def test_polygons(spark, shape):
    scaled = [(x / 16, y / 16) for x, y in shape]
    points = spark.range(17 * 17).select((F.col("id") % 17 / 16).alias("x"), (F.floor(F.col("id") / 17) / 16).alias("y"))
    a, b = polygon.contains(polygon.polygon(scaled), F.col("x"), F.col("y")), polygon.inside(scaled, F.col("x"), F.col("y"))
    seen = set()
    for r in points.select("x", "y", a.alias("a"), b.alias("b")).collect():
        where = winding([(Fraction(x), Fraction(y)) for x, y in shape], Fraction(r.x) * 16, Fraction(r.y) * 16)
        seen.add(where)
        assert r.a == r.b == (where != "out"), (r.x, r.y, where)
    assert seen == {"in", "out", "edge"}


def test_polygons_without_area(spark):
    flat = [(0.125, 0.25), (0.375, 0.25), (0.875, 0.25)]
    for y, want in ((0.25, True), (0.375, False)):
        assert one(spark, polygon.contains(polygon.polygon(flat), F.lit(0.5), F.lit(y)), polygon.inside(flat, F.lit(0.5), F.lit(y))) == (want, want)
    pair = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0.25).alias("y")) for x in (0.125, 0.875)))
    assert one(spark, polygon.contains(pair, F.lit(0.5), F.lit(0.25))) is False
    kite = [(x / 16, y / 16) for x, y in SHAPES[0]]
    assert math.isclose(one(spark, polygon.shoelace(polygon.polygon(kite))), 84 / 256)
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1.5, 0), (1, 1)]):
        with pytest.raises(ValueError):
            polygon.polygon(bad)


def test_pixels_round_to_even(spark):
    at = one(spark, polygon.to_pixels(polygon.polygon([(0.29, 0.57), (0.125, 0.375), (1.0, 0.0)]), F.lit(100), F.lit(100)))
    assert [(p.x, p.y) for p in at] == [(29, 57), (12, 38), (100, 0)]


@pytest.mark.parametrize("name,want", [("Hard_Hat", "helmet"), ("hard-hat", "helmet"), ("no-helmet", "no-helmet"), ("NO_VEST", "no-vest"), ("head_no_helmet", "no-helmet"), ("without vest", "no-vest"), ("safety-vest", "vest"), ("People", "person"), ("non-worker", "person"), ("gloves", names.EXTRA)])
def test_suggested_classes(spark, name, want):
    assert one(spark, names.suggest_class(F.lit(name))) == want


def test_names(spark):
    assert one(spark, names.stem(F.lit("a/b\\c.d.jpg")), names.basename(F.lit("a/b.txt"))) == ("c.d", "b.txt")
    r = one(spark, names.parse_run(F.lit("X04-y8n-s2-chv")))
    assert (r.model, r.seed, r.dataset) == ("y8n", 2, "chv") and one(spark, names.parse_run(F.lit("nope"))) is None
    assert one(spark, names.required_list(F.lit(" Vest,helmet , vest"))) == [2, 1]
    assert one(spark, names.source_kind(F.lit("0")), names.source_kind(F.lit("RTSP://x")), names.source_kind(F.lit("a.mp4"))) == ("camera", "stream", "file")
    assert one(spark, names.breach_banner(F.array(*(F.lit(x) for x in "abcd")))) == "4 in breach:  a   b   c   +1 more"
    assert one(spark, names.escape_html(F.lit("<a&'>"))) == "&lt;a&amp;&#39;&gt;"
    try:
        one(spark, names.required_list(F.lit("person")))
    except Exception as e:
        assert "person" in str(e)
    else:
        raise AssertionError


def test_bits(spark):
    assert one(spark, bits.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long"))) == 64
    rising = F.array(*(F.lit(i % 9) for i in range(72)))
    assert one(spark, bits.gradient_hash(rising)) == -1
    assert one(spark, bits.gradient_hash(F.transform(rising, lambda x: -x))) == 0


def test_members_by_cells(spark):
    """Cells give whom the test of every zone gives: concave, tiny, large and degenerate zones, points on edges, corners and cells' borders."""
    import random

    from stanchion.operators import zone

    rng = random.Random(12)
    shapes = [[(x / 16, y / 16) for x, y in s] for s in SHAPES]
    shapes += [[(rng.random(), rng.random()) for _ in range(rng.randint(3, 7))] for _ in range(25)]
    shapes += [[(0.5 + rng.random() / 500, 0.5 + rng.random() / 500) for _ in range(4)] for _ in range(5)]
    shapes += [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.25, 0.25), (0.25, 0.25), (0.75, 0.5)], [(0.125, 0.25), (0.375, 0.25), (0.875, 0.25)], [(0.1, 0.1), (0.9, 0.1)]]
    zones = spark.createDataFrame([(i, [tuple(map(float, p)) for p in s]) for i, s in enumerate(shapes)], "zone int, points array<struct<x:double,y:double>>")
    feet = [(rng.random(), rng.random()) for _ in range(300)] + [(x / 16, y / 16) for x in range(17) for y in range(17)] + [(0.5 + rng.random() / 400, 0.5 + rng.random() / 400) for _ in range(40)] + [p for s in shapes for p in s] + [(1.4, -0.3)]
    people = spark.createDataFrame([(i, float(x), y - 0.05, 0.1, 0.1) for i, (x, y) in enumerate(feet)], "level int, xc double, yc double, w double, h double")
    got = zone.members(people, zones)
    assert got.columns == [*people.columns, "zone"] and "NestedLoop" not in got._jdf.queryExecution().toString()
    every = zone.with_zones(people, zones).filter("in_zone")
    pairs = lambda df: sorted((r.level, r.zone) for r in df.collect())
    assert pairs(got) == pairs(every) and len(pairs(got)) > 1000
    assert zone.members(people, zones.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_tally_of_shared_shapes_and_places(spark, monkeypatch, most):
    """Zones of one shape and people at one place are looked up once; the counts are those of members()."""
    from stanchion.operators import zone

    looked = []
    cover = zone.cover
    monkeypatch.setattr(zone, "cover", lambda zones: (looked.append(zones.count()), cover(zones))[1])
    monkeypatch.setattr(zone, "BROADCAST_PAIRS", most)
    shapes = [[(0.1, 0.1), (0.6, 0.1), (0.3, 0.3), (0.1, 0.6)], [(0.4, 0.4), (0.9, 0.4), (0.9, 0.9)], [(0.0, 0.0), (0.01, 0.0), (0.0, 0.01)]]
    zones = spark.createDataFrame([(i, shapes[i % 3]) for i in range(30)], "zone int, points array<struct<x:double,y:double>>")
    people = spark.createDataFrame([(i // 3, i, (i * 7 % 10) / 10, (i * 3 % 10) / 10, 0.1, 0.1) for i in range(300)], "image_id int, box_idx int, xc double, yc double, w double, h double")
    got = sorted(map(tuple, zone.tally(people, zones, ["image_id"]).collect()))
    assert looked == [3]
    one = {}
    for r in zone.members(people, zones).collect():
        one.setdefault(r.zone, []).append(r.image_id)
    assert got == sorted((z, len(v), len(set(v))) for z, v in one.items()) and len(got) == 20
