"""Reports against the operators and plain counts they are put together from."""

import random

import pytest
from pyspark.sql import functions as F

from stanchion.operators import calibrate, reports

BOXES = "image_id long, box_idx int, cls int, xc double, yc double, w double, h double"


@pytest.fixture(scope="module")
def datasets(spark):
    rng, out = random.Random(5), {}
    for name in ("one", "two"):
        rows = []
        for i in range(60):
            for k in range(rng.randint(1, 7)):
                cls = rng.choice([0, 1, 2])
                size = (0.3, 0.7) if cls == 0 else (0.06, 0.06)
                rows.append((i, k, cls, rng.uniform(0.3, 0.7), rng.uniform(0.3, 0.6), *size))
        out[name] = spark.createDataFrame(rows, BOXES).cache()
    return out


def test_calibration(spark, datasets):
    tables = dict(reports.calibration(datasets))
    chosen = tables["Chosen, and as good"].filter("chosen").first().threshold
    pairs = {n: [r for r in calibrate.true_pairs(b).collect()] for n, b in datasets.items()}
    for r in tables["Containment and overlap of true pairs"].collect():
        own = [p for p in pairs[r.dataset] if p.cls == r.cls]
        scores, ious = sorted(p.score for p in own), sorted(p.iou for p in own)
        assert (r.pairs, r.median_score, r.median_iou) == (len(own), scores[len(own) // 2], ious[len(own) // 2])
        assert r.kept == pytest.approx(sum(s >= chosen for s in scores) / len(own)) and r.kept_iou == pytest.approx(sum(s >= 0.45 for s in ious) / len(own))
    for r in tables["True pairs below the threshold"].collect():
        own = [p.score for p in pairs[r.dataset] if p.cls == r.cls]
        assert (r.below, r.pairs) == (sum(s < chosen for s in own), len(own)) and (r.excess_images is None) == (r.cls != 1)
    evidence = {r.dataset: r for r in tables["Evidence"].collect()}
    for n, b in datasets.items():
        e = calibrate.evidence(b, chosen).first()
        assert evidence[n].single_person_images == e.single_person_images and evidence[n].helmet_pairs == sum(p.cls == 1 for p in pairs[n])
        assert evidence[n].false_pairs == calibrate.false_pairs(b).count()
    sweep = tables["Thresholds"]
    assert sweep.count() == 19 and {"one_helmet", "two_vest", "one_false", "separation"} <= set(sweep.columns)
    text = reports.render("Calibration", list(tables.items()))
    assert text.startswith("# Calibration\n\n## Evidence\n\n| dataset |") and text.count("## ") == 6


def test_conversion(spark):
    boxes = spark.createDataFrame([(1, 5), (1, 7), (2, 7), (2, 9), (3, 9)], "image_id long, cls int")
    parts = spark.createDataFrame([("d", "train", "a"), ("d", "val", "b"), ("d", "val", "a")], "dataset string, split string, stem string")
    tables = dict(reports.conversion(boxes, spark.range(1, 6).withColumnRenamed("id", "image_id"), {5: 0, 7: 1}, parts))
    assert [tuple(r) for r in tables["Dropped"].collect()] == [(9, 2)]
    assert tables["Kept"].first().asDict() == {"person": 1, "helmet": 2, "vest": 0, "empty_images": 3}
    assert [tuple(r) for r in tables["Problems"].collect()] == [("d", "train+val", 1)]
    assert tables["Splits"].count() == 2 and [tuple(r) for r in tables["Mapping"].collect()] == [(5, 0), (7, 1)]


def test_significance(spark):
    rng = random.Random(2)
    rows = [(m, d, s, "map", base + rng.random() / 50) for m, base in (("a", 0.5), ("b", 0.6), ("c", 0.7)) for d in ("x", "y") for s in range(3)]
    tables = dict(reports.significance(spark.createDataFrame(rows, "model string, trained_on string, seed int, metric string, value double")))
    assert {r.verdict for r in tables["Pairs"].collect()} == {"significant"}  # six pairs can reach 2/64
    assert tables["Cells"].filter(F.abs(F.col("width") - (F.col("high") - F.col("low"))) > 0).count() == 0 and tables["Cells"].count() == 6
    few = dict(reports.significance(spark.createDataFrame([r for r in rows if r[1] == "x"], "model string, trained_on string, seed int, metric string, value double")))
    assert {r.verdict for r in few["Pairs"].collect()} == {"underpowered"}  # three pairs cannot go below 2/8
