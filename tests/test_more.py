import math

from pyspark.sql import functions as F

from stanchion.operators import dwell, progress, stats


def test_resolve(spark):
    rows = [(1, 0, False), (1, 1, False), (1, 2, True), (1, 3, False), (2, 0, True), (2, 1, False)]
    df = spark.createDataFrame(rows, "track_id long, ts_us long, closed boolean")
    got = sorted((r.track_id, r.started_us, r.ended_us, r.n) for r in dwell.islands(df, 10, closes="closed").collect())
    assert got == [(1, 0, 1, 2), (1, 3, 3, 1), (2, 1, 1, 1)]


def test_nemenyi(spark):
    assert math.isclose(stats.studentized_range_tail(3.314493, 3), 0.05, abs_tol=1e-4)
    assert math.isclose(stats.studentized_range_tail(0.0, 4), 1.0, abs_tol=1e-6)
    t = spark.createDataFrame([("m", "a", 1.0, 4), ("m", "b", 2.0, 4), ("m", "c", 3.0, 4)], "metric string, model string, mean_rank double, blocks long")
    got = {(r.a, r.b): r.p for r in stats.nemenyi(t, ["metric"]).collect()}
    assert got["a", "c"] < got["a", "b"] and math.isclose(got["a", "b"], got["b", "c"])


def test_aggregate(spark):
    rows = [(m, d, s, k, v + s / 100) for m, v in (("a", 0.9), ("b", 0.7), ("c", 0.5), ("x", 0.1)) for d in ("p", "q") for s in range(3) for k in ("map", "rec") if not (m == "x" and s == 2)]
    out = stats.aggregate(spark.createDataFrame(rows, "model string, trained_on string, seed int, metric string, value double"))
    assert {(r.metric, r.k, r.blocks) for r in out["omnibus"].collect()} == {("map", 3, 6), ("rec", 3, 6)}
    assert all(math.isclose(r.adjusted, 2 * r.p) or r.adjusted >= r.p for r in out["omnibus"].collect())
    assert out["paired"].filter("p = 0.03125").count() == 6 and out["per_cell"].count() == 16 and out["pooled"].count() == 8


def test_queue_and_policy(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    got = progress.due(runs, runs.filter("run_id = 'a'"), runs.filter("run_id = 'c'")).collect()
    assert [(r.run_id, r.state) for r in got] == [("c", "resumable"), ("b", "pending")]
    p = spark.range(1).select(progress.frame_policy(F.lit("images"), F.lit(3.0), F.lit(1.0)).alias("p"), progress.rate(F.lit(None).cast("double"), F.lit(0.0)).alias("r")).first()
    assert (p.p.tracked, p.p.dwell, p.p.memory, p.r) == (False, 0.0, 0.0, 25.0)
