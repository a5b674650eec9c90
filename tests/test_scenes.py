"""Boxes and workers in one pass: frames of one row against joins, crowded frames, and how often a query reads its table."""

import pytest
from pyspark.sql import functions as F
from test_crowds import BOXES, boxes_of, rows

from stanchion.operators import assign, calibrate, metrics
from stanchion.plans import detection
from stanchion.sources import labels

ONE_PASS = ["majority_vote", "threshold_retention", "roc_sweep", "violation_confusion", "detection_rate", "zone_alert_confusion"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_table_is_read_once(spark, data, name):
    plan = getattr(detection, name)(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and " Join Inner, (" not in plan and " Join Left" not in plan


@pytest.fixture
def scene(spark):
    """Rows of boxes and workers; a worker is a person's box, moved and stretched a little."""
    boxes = spark.createDataFrame(boxes_of(5, 30, 30), BOXES)
    box = F.struct("box_idx", "cls", "xc", "yc", "w", "h").alias("box")
    moved = F.struct(F.col("box_idx").alias("worker"), (F.col("xc") + 0.01 * (F.col("box_idx") % 5)).alias("xc"), "yc", "w", (F.col("h") * 1.1).alias("h"), (F.col("box_idx") % 2 == 0).alias("helmet"), (F.col("box_idx") % 3 == 0).alias("vest"))
    return boxes.select("image_id", F.when(F.col("box_idx") % 7 != 0, box).alias("box"), F.when(F.col("cls") == 0, moved).alias("worker")).cache()


def by_joins(scene):
    boxes, workers = (scene.filter(F.col(c).isNotNull()).select("image_id", f"{c}.*") for c in ("box", "worker"))
    people = boxes.filter("cls = 0").withColumnRenamed("box_idx", "person")
    return workers, assign.match_people(people, workers), assign.people_states(boxes, assign.bind(boxes))


def test_decisions_equal_joins_and_crowds(spark, scene, monkeypatch):
    columns = ["image_id", "worker", "helmet", "person", "detected", "flag_helmet", "flag_vest"]
    workers, matched, states = by_joins(scene)
    want = sorted(map(repr, metrics.worker_decisions(workers, matched, states, ["image_id"]).select(*columns).collect()))
    run = lambda crowd: sorted(map(repr, metrics.decisions(scene, ["image_id"], ["worker", "helmet"], crowd).select(*columns).collect()))
    assert run(None) == want and len(want) > 100
    monkeypatch.setattr(assign, "CROWD", 12)
    crowd = assign.crowded([scene], ["image_id"])
    assert crowd.count() > 5 and run(crowd) == want


def test_told_people_and_workers(spark, scene, monkeypatch):
    workers, matched, states = by_joins(scene)
    columns = ["image_id", "worker.worker", "person.box_idx", "wears_helmet", "wears_vest"]
    run = lambda crowd: sorted(map(repr, (tuple(r) for r in metrics.tell(scene, ["image_id"], crowd).select(*columns).collect())))
    seen = matched.join(states.select("image_id", "person", "wears_helmet", "wears_vest"), ["image_id", "person"], "full_outer").join(workers.select("image_id", "worker"), ["image_id", "worker"], "full_outer")
    want = sorted(map(repr, (tuple(r) for r in seen.select("image_id", "worker", "person", F.coalesce("wears_helmet", F.lit(False)), F.coalesce("wears_vest", F.lit(False))).collect())))
    assert run(None) == want and "None" in str(want)
    monkeypatch.setattr(assign, "CROWD", 12)
    assert run(assign.crowded([scene], ["image_id"])) == want


def test_passed_counts_thresholds(spark):
    taus = [1, 2, 5, 9]
    got = spark.createDataFrame([(v,) for v in (0, 1, 4, 5, 9, 50, None)], "v int").select("v", metrics.passed(F.col("v"), taus)).collect()
    assert [n for _, n in got] == [sum(v is not None and v >= t for t in taus) for v, _ in got]
    assert rows(spark.range(1).select(metrics.passed(F.lit(3), []))) == [(0,)]


def test_nearest_object_by_frames_and_by_joins(spark, monkeypatch):
    every = boxes_of(7, 20, 30)
    boxes = spark.createDataFrame(every, BOXES)
    objects = boxes.filter("cls <> 0").select("image_id", F.col("box_idx").alias("obj_idx"), F.concat(F.lit("c"), "cls").alias("name"), "xc", "yc", "w", "h")
    run = lambda: rows(assign.nearest_object(boxes.withColumnRenamed("box_idx", "row_idx"), objects, ["image_id"]))
    want = []
    for i, k, cls, *at in every:
        near = [(sum((a - b) * (a - b) for a, b in zip(o[3:], at)), o[1], o[2]) for o in every if o[0] == i and o[2]]
        want += [(i, k, cls, f"c{min(near)[2]}", min(near)[1])] if near else []
    assert run() == sorted(want) and len(want) > 100
    monkeypatch.setattr(assign, "CROWD", 12)
    assert run() == sorted(want)


def test_false_pairs_of_crowded_images(spark, monkeypatch):
    boxes = spark.createDataFrame([(i, k, c, *(round(v * 2) / 2 for v in at)) for i, k, c, *at in boxes_of(8, 25, 30)], BOXES)
    want = rows(calibrate.false_pairs(boxes))
    assert 100 < len(want) < boxes.filter("cls > 0").count()  # some items meet a person like one of their own image
    monkeypatch.setattr(assign, "CROWD", 12)
    assert rows(calibrate.false_pairs(boxes)) == want


def test_retention_counts_scores_before_they_meet_thresholds(spark, monkeypatch):
    scores = spark.createDataFrame([(k % 2, v) for k, v in enumerate([0.0, 0.05, 0.3, 0.8, 0.95, 1.0, float("nan"), None, 0.15])], "cls int, score double")
    run = lambda: sorted(map(repr, calibrate.retention(scores, calibrate.grid(spark), ["cls"]).collect()))
    plan = calibrate.retention(scores, calibrate.grid(spark), ["cls"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # before the thresholds and after
    got = run()
    monkeypatch.setattr(calibrate, "FEW", 0)
    assert run() == got and len(got) == 38


def test_label_lines_are_split_once(spark):
    lines = ["1 0.5 0.25 0.1 0.2", "\t 2\t0.5  0.25 0.1 0.2 \t", "1 0.5", "1 0.5 ", "", " ", "\t", "helmet 1 1 1 1", "1.9 0 0 0 0 more x", "nan 0 0 0 0", "3e9 0 0 0 0", "1 0 x 0 0"]
    read = labels.parse_centre_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert set(read.columns) == {"value", "malformed", "xc", "yc", "w", "h", "cls"}
    got = [(r.value, r.cls, r.xc, r.h) for r in read.collect()]
    assert got == [(lines[0], 1, 0.5, 0.2), (lines[1], 2, 0.5, 0.2), (lines[2], None, None, None), (lines[3], None, None, None), (lines[7], None, None, None), (lines[8], 1, 0.0, 0.0), *((v, None, None, None) for v in lines[9:])]
    plan = read.filter("not malformed").select("cls", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
