"""Association, matching and suppression against plain computations, on scenes that a seeded generator draws."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from stanchion.operators import assign

COLS = "image_id long, box_idx int, cls int, xc double, yc double, w double, h double"


def scene(rng, n, grid=40):
    """n boxes by their corners on a grid, which makes ties and touching edges common: (cls, xc, yc, w, h)."""
    boxes = []
    for _ in range(n):
        cls = rng.choice([0, 0, 1, 2])
        reach = grid // 2 if cls == 0 else grid // 8
        left, top = rng.randrange(grid), rng.randrange(grid)
        right, low = left + rng.randint(0 if cls else 1, reach), top + rng.randint(1, reach)
        boxes.append((cls, (left + right) / 2 / grid, (top + low) / 2 / grid, (right - left) / grid, (low - top) / grid))
    return boxes


SCENES = [scene(random.Random(100 + k), k % 14) for k in range(70)]


def frame(spark, scenes):
    return spark.createDataFrame([(i, k, *b) for i, boxes in enumerate(scenes) for k, b in enumerate(boxes)], COLS)


def common(a, b):
    sides = [min(a[k] + a[k + 2] / 2, b[k] + b[k + 2] / 2) - max(a[k] - a[k + 2] / 2, b[k] - b[k + 2] / 2) for k in (1, 2)]
    return sides[0] * sides[1] if min(sides) > 0 else 0.0


def contained(a, b):
    return common(a, b) / (a[3] * a[4]) if a[3] * a[4] > 0 else 0.0


def pick(ranked, *ends):
    """In order, whatever shares no end with what has been picked."""
    used, out = [set() for _ in ends], []
    for x in sorted(ranked):
        own = [end(x) for end in ends]
        if all(o not in u for o, u in zip(own, used)):
            for o, u in zip(own, used):
                u.add(o)
            out.append(x)
    return out


def expected_bindings(boxes, least):
    ranked = []
    for (i, item), (p, who) in product(enumerate(boxes), repeat=2):
        share = contained(item, who)
        if item[0] and not who[0] and share >= least:
            place = who[2] - who[4] / 2 + (0.05 if item[0] == 1 else 0.35) * who[4]
            away = ((item[1] - who[1]) ** 2 + (item[2] - place) ** 2) ** 0.5 / (who[3] ** 2 + who[4] ** 2) ** 0.5
            ranked.append((-share, away, i, p, item[0]))
    return {(p, cls, i) for _, _, i, p, cls in pick(ranked, lambda x: x[2], lambda x: (x[3], x[4]))}


@pytest.mark.parametrize("least", [0.8, 0.55])
def test_bindings_and_what_follows_from_them(spark, least):
    boxes = frame(spark, SCENES)
    bound = assign.bind(boxes, threshold=least)
    got = {i: set() for i in range(len(SCENES))}
    for r in bound.collect():
        got[r.image_id].add((r.person, r.cls, r.item))
    assert got == {i: expected_bindings(s, least) for i, s in enumerate(SCENES)} and sum(map(len, got.values())) > 20
    worn = {(i, p, cls) for i, x in got.items() for p, cls, _ in x}
    for r in assign.people_states(boxes, bound).collect():
        helmet, vest = ((r.image_id, r.person, c) in worn for c in (1, 2))
        assert (r.wears_helmet, r.wears_vest, r.code) == (helmet, vest, "W" + "H" * helmet + "V" * vest)
    items = {(i, k) for i, s in enumerate(SCENES) for k, b in enumerate(s) if b[0]}
    assert {(r.image_id, r.item) for r in assign.unbound(boxes, bound).collect()} == items - {(i, k) for i, x in got.items() for _, _, k in x}


def test_matching(spark):
    rng = random.Random(8)
    seen = [[b for b in s if b[0] == 0] for s in SCENES]
    truth = [[(0, b[1] + rng.choice([0, 0.025, 0.05]), b[2], b[3], b[4] * rng.choice([1, 0.75])) for b in s] for s in seen]
    table = lambda scenes, name: frame(spark, scenes).withColumnRenamed("box_idx", name)
    got = sorted((r.image_id, r.worker, r.person) for r in assign.match_people(table(seen, "person"), table(truth, "worker")).collect())
    want = []
    for i, (people, workers) in enumerate(zip(seen, truth)):
        ranked = []
        for (w, a), (p, b) in product(enumerate(workers), enumerate(people)):
            both = common(a, b)
            share = both / (a[3] * a[4] + b[3] * b[4] - both)
            if share >= 0.5:
                ranked.append((-share, w, p))
        want += [(i, w, p) for _, w, p in pick(ranked, lambda x: x[1], lambda x: x[2])]
    assert got == sorted(want) and len(want) > 50


def test_suppression(spark):
    crowds = [[b for b in scene(random.Random(k), 30, 12) if b[0] == 0] for k in range(30)]
    boxes = frame(spark, crowds)
    want = set()
    for i, people in enumerate(crowds):
        gone = set()
        for a, b in product(range(len(people)), repeat=2):
            x, y = people[a], people[b]
            if a not in gone and b not in gone and y[3] * y[4] > x[3] * x[4] and contained(x, y) >= 0.8:
                gone.add(a)
        want |= {(i, a) for a in gone}
    assert {(r.image_id, r.box_idx) for r in assign.duplicate_people(boxes).collect()} == want and len(want) > 30
    kept = {(r.image_id, r.box_idx) for r in assign.suppress_duplicates(boxes.withColumn("cls", F.col("cls"))).collect()}
    assert kept == {(i, k) for i, s in enumerate(crowds) for k in range(len(s))} - want
