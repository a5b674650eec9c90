"""Crowded images: grids and rounds give what the fold over an image gives."""

import random

import pytest
from pyspark.sql import functions as F

from stanchion.operators import assign, audit

BOXES = "image_id long, box_idx int, cls int, xc double, yc double, w double, h double"


def boxes_of(seed, images, most, spread=1.0):
    rng, rows = random.Random(seed), []
    for i in range(images):
        for k in range(rng.randint(1, most)):
            cls = rng.choice([0, 0, 1, 2])
            w, h = (rng.uniform(0.02, 0.6), rng.uniform(0.02, 0.9)) if cls == 0 else (rng.uniform(0.01, 0.1), rng.uniform(0.01, 0.1))
            # coarse steps, so that boxes touch, coincide and tie
            rows.append((i, k, cls, *(round(v * 25) / 25 if rng.random() < 0.5 else v for v in (rng.random() * spread, rng.random() * spread, w, h))))
    return rows


@pytest.fixture
def small_crowd(monkeypatch):
    monkeypatch.setattr(assign, "CROWD", 12)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_grid_and_rounds_give_the_same_rows(spark, monkeypatch):
    boxes = spark.createDataFrame(boxes_of(1, 25, 40), BOXES).cache()
    people = boxes.filter("cls = 0").withColumnRenamed("box_idx", "person")
    workers = people.withColumnRenamed("person", "worker").withColumn("xc", F.col("xc") + 0.01 * (F.col("worker") % 5)).withColumn("h", F.col("h") * 1.1)
    labelled = workers.withColumn("code", F.col("worker") % 4)
    run = lambda: [rows(audit.containment_table(labelled, boxes.filter("cls > 0"), ["image_id"])), rows(assign.bind(boxes)), rows(assign.bind(boxes, threshold=0.3)), rows(assign.match_people(people, workers)), rows(assign.duplicate_people(boxes))]
    want = run()
    monkeypatch.setattr(assign, "CROWD", 12)
    assert assign.crowded([boxes], ["image_id"]).count() > 5
    assert run() == want and all(want)


def test_grid_meets_every_candidate_and_few_others(spark, small_crowd):
    boxes = spark.createDataFrame([(0, *r[1:]) for r in boxes_of(2, 1, 1500)], BOXES).withColumn("w", F.col("w") / 8).withColumn("h", F.col("h") / 8).cache()
    crowd = assign.crowded([boxes], ["image_id"])
    assert rows(assign.candidates(boxes, crowd=crowd)) == rows(assign.candidates(boxes))
    inner, outer = assign._side(boxes.filter("cls > 0"), ["image_id"], "i_", []), assign._side(boxes.filter("cls = 0"), ["image_id"], "p_", [])
    all_pairs = assign.meet(inner, outer, ["image_id"], "i_", "p_").count()
    assert assign.meet(inner, outer, ["image_id"], "i_", "p_", crowd).count() < all_pairs / 20


def test_one_image_of_20000_boxes(spark):
    rng = random.Random(9)
    people = [(0, k, 0, rng.random(), rng.random(), 0.02, 0.04) for k in range(10_000)]
    hats = [(0, 10_000 + k, 1, rng.random(), rng.random(), 0.004, 0.004) for k in range(10_000)]
    boxes = spark.createDataFrame(people + hats, BOXES)
    got = rows(assign.bind(boxes))
    cells = {}
    for p in people:
        for x in range(int((p[3] - 0.01) * 50), int((p[3] + 0.01) * 50) + 1):
            for y in range(int((p[4] - 0.02) * 50), int((p[4] + 0.02) * 50) + 1):
                cells.setdefault((x, y), []).append(p)
    found = []
    for _, k, cls, x, y, w, h in hats:
        for _, q, _, px, py, pw, ph in cells.get((int(x * 50), int(y * 50)), []):
            a = min(x + w / 2, px + pw / 2) - max(x - w / 2, px - pw / 2)
            b = min(y + h / 2, py + ph / 2) - max(y - h / 2, py - ph / 2)
            if a > 0 and b > 0 and a * b / (w * h) >= 0.8:
                dx, dy = x - px, y - (py - ph / 2 + 0.05 * ph)
                found.append((-(a * b / (w * h)), (dx * dx + dy * dy) ** 0.5 / (pw * pw + ph * ph) ** 0.5, k, q))
    items, taken, want = set(), set(), []
    for _, _, k, q in sorted(found):
        if k not in items and q not in taken:
            items.add(k)
            taken.add(q)
            want.append((0, q, 1, k))
    assert got == sorted(want) and len(got) > 3000


def test_suppression_of_long_chains(spark, small_crowd):
    """Boxes inside boxes, in index orders that make each one's fate hang on the next."""
    chain = [(0.5, 0.5, 0.9 - 0.02 * k, 0.9 - 0.02 * k) for k in range(30)]
    orders = [list(range(30)), list(range(29, -1, -1)), random.Random(3).sample(range(30), 30)]
    boxes = spark.createDataFrame([(i, k, 0, *chain[j]) for i, order in enumerate(orders) for k, j in enumerate(order)], BOXES)
    got = {}
    for i, k in rows(assign.duplicate_people(boxes)):
        got.setdefault(i, set()).add(k)
    for i, order in enumerate(orders):
        dropped = set()
        for k, j in enumerate(order):
            larger = [m for m, n in enumerate(order) if n < j and m not in dropped]
            if larger:
                dropped.add(k)
        assert got[i] == dropped
