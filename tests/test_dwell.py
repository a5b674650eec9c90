import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from stanchion.operators import dwell

S = dwell.SECOND


def violating(spark, *rows):
    return spark.createDataFrame([(t, round(at * S), m) for t, at, m in rows], "track_id long, ts_us long, missing array<int>")


def fired(df):
    return sorted((r.track_id, r.started_us / S, r.fired_us / S, tuple(r.missing)) for r in df.collect())


def test_alerts(spark):
    def run(times, d, g=2.0):
        return [x[1:3] for x in fired(dwell.alerts(violating(spark, *((1, t, [1]) for t in times)), round(d * S), round(g * S)))]

    assert run([0], 0) == [(0, 0)]
    assert run([i / 10 for i in range(50)], 0) == [(0, 0)]
    assert run([0, 1.5, 2.9, 3.0], 3) == [(0, 3.0)]
    assert run([0, 5], 0) == [(0, 0), (5, 5)]
    assert run([0, 2, 3], 3) == [(0, 3)]
    assert run([0, 10, 11, 12, 13], 3) == [(10, 13)]
    assert run([0, 2, 4], 4) == [(0, 4)]  # a gap of exactly grace goes on
    both = dwell.alerts(violating(spark, (7, 0, [1]), (7, 1, [1]), (7, 2, [1]), (9, 1, [1]), (9, 2, [1]), (9, 3, [1, 2])), 2 * S, 2 * S)
    assert fired(both) == [(7, 0, 2, (1,)), (9, 1, 3, (1, 2))]


def test_memory(spark):
    def missing(rows, memory):
        df = spark.createDataFrame([(1, round(t * S), w) for t, w in rows], "track_id long, ts_us long, worn array<int>")
        out = dwell.remembered(df, [1, 2], round(memory * S)).orderBy("ts_us").collect()
        return [r.missing for r in out]

    assert missing([(0, [1, 2]), (0.04, [2])], 1) == [[], []]
    assert missing([(0, [1, 2]), (1.5, [2])], 1) == [[], [1]]
    assert missing([(0, [1, 2]), (0.04, [])], 0) == [[], [1, 2]]
    assert missing([(0, [1, 2]), (1, [])], 1) == [[], []]  # exactly at the bound it is still believed


def machine(rows, dwell_, grace, memory):
    """The state machine by hand: (track, ts, in_zone, worn) in time order."""
    seen, open_, out = {}, {}, []
    for t, now, inside, worn in rows:
        for c in worn:
            seen[t, c] = now
        lacks = [c for c in (1, 2) if (t, c) not in seen or now - seen[t, c] > memory]
        if not inside or not lacks:
            continue
        o = open_.get(t)
        if o is None or now - o["last"] > grace:
            o = open_[t] = {"start": now, "fired": False}
        o["last"] = now
        if not o["fired"] and now - o["start"] >= dwell_:
            o["fired"] = True
            out.append((t, o["start"], now, tuple(lacks)))
    return sorted(out)


def observations():
    rng = random.Random(11)
    rows, now = [], 0
    for _ in range(300):
        now += rng.choice([100_000, 400_000, 900_000, 2_500_000])
        rows.append((rng.randint(1, 3), now, rng.random() < 0.8, [c for c in (1, 2) if rng.random() < 0.2]))
    return rows


def test_batch_equals_machine(spark):
    rows = observations()
    df = spark.createDataFrame(rows, "track_id long, ts_us long, in_zone boolean, worn array<int>")
    seen = dwell.remembered(df, [1, 2], S).filter("in_zone and size(missing) > 0")
    got = sorted((r.track_id, r.started_us, r.fired_us, tuple(r.missing)) for r in dwell.alerts(seen, 3 * S, 2 * S).collect())
    assert got == machine(rows, 3 * S, 2 * S, S) and got


def test_stream_equals_machine(spark, tmp_path):
    from stanchion.streaming.alerts import alert_stream

    rows = observations()
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame(rows, "track_id long, ts_us long, in_zone boolean, worn array<int>")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(int(base.timestamp() * S)) + F.col("ts_us")))
    df = df.withColumn("ts_us", F.unix_micros("ts"))
    shift = int(base.timestamp() * S)
    half = sorted(rows, key=lambda r: r[1])[len(rows) // 2][1] + shift
    src = str(tmp_path / "in")
    df.filter(F.col("ts_us") <= half).coalesce(1).write.mode("append").parquet(src)
    df.filter(F.col("ts_us") > half).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(src)
    q = alert_stream(stream, 3 * S, 2 * S, S).writeStream.format("memory").queryName("alerts_test").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.track_id, r.started_us - shift, r.fired_us - shift, tuple(r.missing)) for r in spark.sql("select * from alerts_test").collect())
    assert got == machine(rows, 3 * S, 2 * S, S)


def test_untracked_people_are_no_track(spark):
    rows = [(None, t * S, True, []) for t in range(6)] + [(1, t * S, True, []) for t in range(5)] + [(None, 9 * S, True, [1, 2])]
    df = spark.createDataFrame(rows, "track_id long, ts_us long, in_zone boolean, worn array<int>")
    seen = dwell.remembered(df, [1, 2], 100 * S)
    assert seen.filter("track_id is null and ts_us = 0 and size(missing) = 2").count() == 1 and seen.filter("track_id is null and size(missing) = 0").count() == 1
    lacking = seen.filter("size(missing) > 0")
    assert [(r.track_id, r.started_us, r.fired_us) for r in dwell.alerts(lacking, 3 * S, 2 * S).collect()] == [(1, 0, 3 * S)]
    assert dwell.islands(lacking, 2 * S).count() == 1


def run_stream(spark, tmp_path, build, df, name):
    src = str(tmp_path / name)
    for part in (df.filter("half"), df.filter("not half")):
        part.drop("half").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.drop("half").schema).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_stream_closes_and_skips_untracked(spark, tmp_path):
    from stanchion.streaming.alerts import alert_stream

    base = 1_700_000_000 * S
    rows = [(1, t, True, [], t == 2) for t in range(9)] + [(None, t, True, [], False) for t in range(9)]
    df = spark.createDataFrame(rows, "track_id long, t long, in_zone boolean, worn array<int>, closes boolean").withColumn("ts_us", F.lit(base) + F.col("t") * S)
    df = df.withColumn("ts", F.timestamp_micros("ts_us")).withColumn("half", F.col("t") < 4).drop("t")
    got = run_stream(spark, tmp_path, lambda s: alert_stream(s, 3 * S, 2 * S, 0, late="0 seconds"), df, "closing")
    # the incident that opens at 0 is closed at 2; the next opens at 3 and fires at 6
    assert [(r.track_id, (r.started_us - base) // S, (r.fired_us - base) // S) for r in got] == [(1, 3, 6)]


def test_stream_of_frames(spark, tmp_path):
    """Detections to alerts: a duplicate person goes, a helmet binds, and who stands outside the zone does not count."""
    from stanchion.streaming.alerts import frame_alerts

    base = 1_700_000_000 * S
    person, small, hat = (0, 0, 0.5, 0.45, 0.3, 0.7, 5), (1, 0, 0.47, 0.45, 0.15, 0.3, 6), (2, 1, 0.48, 0.13, 0.05, 0.05, None)
    away = (3, 0, 0.12, 0.45, 0.15, 0.35, 7)
    boxes = "array<struct<box_idx:int,cls:int,xc:double,yc:double,w:double,h:double,track_id:long>>"
    rows = [(t, [person, small, hat, away]) for t in range(6)]
    df = spark.createDataFrame(rows, f"t long, boxes {boxes}").withColumn("ts_us", F.lit(base) + F.col("t") * S).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("half", F.col("t") < 3).withColumnRenamed("t", "frame")
    zone = [(0.25, 0.0), (0.75, 0.0), (0.75, 1.0), (0.25, 1.0)]
    got = run_stream(spark, tmp_path, lambda s: frame_alerts(s, zone, 3 * S, 2 * S, 0, late="0 seconds"), df, "framed")
    assert [(r.track_id, (r.started_us - base) // S, (r.fired_us - base) // S, list(r.missing)) for r in got] == [(5, 0, 3, [2])]
