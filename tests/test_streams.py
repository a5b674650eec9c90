"""Streams against the batch operators: rows out of order, chained counts, state read back, and a log that a crash does not double."""

import random

import pytest
from pyspark.sql import functions as F

from stanchion.operators import dwell
from stanchion.streaming import alerts as A
from stanchion.streaming.log import log_writer, read_log

S = dwell.SECOND
BASE = 1_700_000_000 * S
SCHEMA = "track_id long, t long, in_zone boolean, worn array<int>"


def observations(n=260, seed=21):
    rng, rows, now = random.Random(seed), [], 0
    for _ in range(n):
        now += rng.choice([50, 300, 700, 2100])
        rows.append((rng.randint(1, 3), now, rng.random() < 0.8, [c for c in (1, 2) if rng.random() < 0.2]))
    return rows


def stamped(df):
    return df.withColumn("ts_us", F.lit(BASE) + F.col("t") * 1000).withColumn("ts", F.timestamp_micros("ts_us"))


def batch_alerts(spark, rows):
    df = stamped(spark.createDataFrame(rows, SCHEMA))
    seen = dwell.remembered(df, [1, 2], S).filter("in_zone and size(missing) > 0")
    return sorted((r.track_id, r.started_us, r.fired_us, tuple(r.missing)) for r in dwell.alerts(seen, 2 * S, 2 * S).collect())


def feed(spark, path, rows):
    stamped(spark.createDataFrame(rows, SCHEMA)).drop("t").coalesce(1).write.mode("append").parquet(path)


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def out_of_order(rows, late_ms):
    """Batches in which no row is older than the newest of the batches before by more than the lateness."""
    rng = random.Random(4)
    order = sorted(rows, key=lambda r: r[1] + rng.randint(0, late_ms))
    return [order[i : i + 45] for i in range(0, len(order), 45)]


def test_shuffled_rows_give_the_batch_answer(spark, tmp_path):
    rows, src = observations(), str(tmp_path / "in")
    want = batch_alerts(spark, rows)
    batches = out_of_order(rows, 9_000)
    assert any(b[i][1] > b[i + 1][1] for b in batches for i in range(len(b) - 1)) and batches != [sorted(b, key=lambda r: r[1]) for b in batches]
    assert min(r[1] for r in batches[1]) < max(r[1] for r in batches[0])  # over the borders of batches, too
    last = max(r[1] for r in rows)
    for i, b in enumerate([*batches, [(99, last + 60_000, False, [1, 2])]]):
        feed(spark, src, b)
        stream = spark.readStream.schema("track_id long, in_zone boolean, worn array<int>, ts_us long, ts timestamp").parquet(src)
        if i in (2, len(batches)):  # a restart in the middle
            run(A.alert_stream(stream, 2 * S, 2 * S, S).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    got = sorted((r.track_id, r.started_us, r.fired_us, tuple(r.missing)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(want) > 3


def test_open_incidents_are_read_from_the_state(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [(1, t * 500, True, [2]) for t in range(10)] + [(2, 0, True, []), (2, 9_000, True, [1])] + [(3, t * 1000, False, []) for t in range(9)] + [(4, 8_900, True, [1, 2])]
    feed(spark, src, [*rows, (9, 9_001, False, [1, 2]), (9, 19_002, False, [1, 2])])
    stream = spark.readStream.schema("track_id long, in_zone boolean, worn array<int>, ts_us long, ts timestamp").parquet(src)
    run(A.alert_stream(stream, 2 * S, 5 * S, 60 * S).writeStream.format("memory").queryName("status").option("checkpointLocation", cp).outputMode("append"))
    got = {r.track_id: ((r.started_us - BASE) // 1000, (r.last_us - BASE) // 1000, r.fired, r.missing) for r in A.open_incidents(spark, cp, 5 * S).collect()}
    # all rows up to 9.002 s are through: 1 fired and goes on, 2 began anew at 9 s, 3 never stood in the zone, 4 wears all
    assert got == {1: (0, 4500, True, [1]), 2: (9000, 9000, False, [2])}
    later = A.open_incidents(spark, cp, 5 * S, BASE + 10_000_000).collect()
    assert [r.track_id for r in later] == [2]


def test_counts_follow_frames_and_alerts_over_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rng = random.Random(6)
    rows, now = [], 0
    for f in range(120):
        now += rng.choice([300, 700])
        people = [(rng.choice([None, 1, 2, 3]), [c for c in (1, 2) if rng.random() < 0.3]) for _ in range(rng.randint(0, 4))]
        rows.append((f, now, people))
    schema = "frame long, t long, people array<struct<track_id:long,worn:array<int>>>"
    observed = [(i, t, True, w) for _, t, ps in rows for i, w in ps if i is not None]
    fired = batch_alerts(spark, observed)
    for part in (rows[:70], rows[70:] + [(1000, now + 90_000, [(77, [1, 2])])]):
        stamped(spark.createDataFrame(part, schema)).drop("t").coalesce(1).write.mode("append").parquet(src)
        detections = spark.readStream.schema("frame long, people array<struct<track_id:long,worn:array<int>>>, ts_us long, ts timestamp").parquet(src)
        lacks = lambda p: F.size(F.array_except(F.array(F.lit(1), F.lit(2)), p["worn"])) > 0
        seen = detections.select(F.lit("yard").alias("zone"), "frame", F.size("people").alias("people"), F.size(F.filter("people", lambda p: p["track_id"].isNull() & lacks(p))).alias("untracked"))
        each = detections.select("ts", "ts_us", F.inline("people")).withColumn("in_zone", F.lit(True))
        alerts = A.alert_stream(each, 2 * S, 2 * S, S).withColumn("zone", F.lit("yard"))
        run(A.counted(seen, alerts, shards=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append"))
    got = A.totals(spark.read.parquet(out)).collect()
    untracked = sum(i is None and set(w) != {1, 2} for _, _, ps in rows for i, w in ps)
    assert [tuple(r) for r in got] == [("yard", 121, sum(len(ps) for _, _, ps in rows) + 1, len(fired), untracked)] and len(fired) > 2


def test_a_crash_leaves_every_alert_in_the_log_once(spark, tmp_path):
    src, cp, log = (str(tmp_path / x) for x in ("in", "cp", "log"))
    kind = "fired_at string, frame long, track_id long, zone string, missing string, started_at string, dwell_seconds double, confidence double"
    row = lambda i: (f"2024-01-01T00:00:{i:02d}", i, i % 3, "yard, east", 'helmet "or" vest', None, 2.5, 0.5)
    write, tries = log_writer(log), []

    def dying(batch, number):
        write(batch, number)
        tries.append(number)
        if len(tries) == 2:
            raise RuntimeError("lost after the write, before the commit")

    assert read_log(spark, log).count() == 0
    for a in (0, 10, 20):
        spark.createDataFrame([row(i) for i in range(a, a + 10)], kind).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(kind).parquet(src)
        q = stream.writeStream.foreachBatch(dying).option("checkpointLocation", cp).trigger(availableNow=True).start()
        if a == 10:
            with pytest.raises(Exception):
                q.awaitTermination(120)
            assert read_log(spark, log).count() == 20  # the batch is there, and is written again
        else:
            q.awaitTermination(120)
    assert len(tries) == 4 and len(set(tries)) == 3
    assert sorted(tuple(r) for r in read_log(spark, log).collect()) == [row(i) for i in range(30)]


def test_rows_that_tell_nothing_are_not_kept(spark, tmp_path):
    """A row outside with nothing worn moves the watermark and goes; it does not wait in the state."""
    from stanchion.streaming import alerts as A

    schema = spark.createDataFrame([], "track_id long, ts_us long, in_zone boolean, ts timestamp, worn array<int>").schema
    plan = A.alert_stream(A.frames(spark, str(tmp_path), schema), 10, 10, 0)._jdf.queryExecution().analyzed().toString()
    kept = [x for x in plan.splitlines() if "Filter" in x and "in_zone" in x]
    assert len(kept) == 1 and plan.index(kept[0]) < plan.index("EventTimeWatermark")
