import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanchion.operators import audit, calibrate, metrics, progress, stats


def test_bca():
    """Against the definition, with an explicit jackknife."""
    from statistics import NormalDist, fmean

    import numpy as np

    normal = NormalDist()
    for x in ([0.70, 0.72, 0.74], [0.1, 0.9, 0.95, 0.97, 0.2], [3.0, 1.0, 1.5, 9.0]):
        mean, low, high, n, method = stats.bca(x)
        drawn = np.random.default_rng(0).choice(x, size=(10_000, len(x)), replace=True).mean(axis=1)
        z0 = normal.inv_cdf(float((drawn < np.mean(x)).mean()))
        jack = [fmean(x[:i] + x[i + 1 :]) for i in range(len(x))]
        a = sum((fmean(jack) - j) ** 3 for j in jack) / (6 * sum((fmean(jack) - j) ** 2 for j in jack) ** 1.5)
        for got, z in ((low, normal.inv_cdf(0.025)), (high, normal.inv_cdf(0.975))):
            want = np.percentile(drawn, 100 * normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))
            assert math.isclose(got, want, rel_tol=1e-3), (x, got, want)
        assert n == len(x) and method == "bca" and math.isclose(mean, fmean(x))
    assert stats.bca([0.5] * 3)[1:] == (0.5, 0.5, 3, "percentile")
    assert stats.bca([0.42]) == (0.42, 0.42, 0.42, 1, "point") and stats.bca([])[3:] == (0, "point")


def test_sign_flip_of_many_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"g{n}", i, round(rng.uniform(-1, 2), 3)) for n in (13, 16, 17) for i in range(n)] + [("one", 0, 0.25)]
    got = {r.g: r for r in stats.sign_flip(spark.createDataFrame(rows, "g string, seed int, diff double"), ["g"]).collect()}
    for g, r in got.items():
        d = [v for h, _, v in rows if h == g]
        sums = [0.0]
        for v in d:
            sums = [s + e * v for s in sums for e in (1, -1)]
        assert r.n == len(d) and r.p == sum(abs(s) >= abs(sum(d)) - 1e-9 for s in sums) / 2 ** len(d), g
    with pytest.raises(Exception, match="exact test"):
        stats.sign_flip(spark.createDataFrame([("x", i, 1.0) for i in range(41)], "g string, seed int, diff double"), ["g"], most=40).collect()


def test_sign_flip(spark):
    rows = [("x", i, d) for i, d in enumerate([0.02, 0.02, 0.02])] + [("y", i, 0.0) for i in range(3)] + [("z", i, d) for i, d in enumerate([0.1, -0.2, 0.3, 0.25])]
    got = {r.g: r for r in stats.sign_flip(spark.createDataFrame(rows, "g string, seed int, diff double"), ["g"]).collect()}
    assert got["x"].p == 0.25 and got["x"].min_p == 0.25 and got["y"].p == 1.0
    d = [0.1, -0.2, 0.3, 0.25]
    want = sum(abs(sum(s * v for s, v in zip(signs, d)) / 4) >= abs(sum(d) / 4) - 1e-12 for signs in itertools.product((1, -1), repeat=4)) / 16
    assert got["z"].p == want


def test_friedman(spark):
    rows = [(m, b, v + b / 100) for m, v in (("a", 0.9), ("b", 0.7), ("c", 0.5)) for b in range(4)]
    r = stats.friedman(spark.createDataFrame([("t", *x) for x in rows], "t string, model string, block int, value double"), "model", ["block"], ["t"]).first()
    assert math.isclose(r.statistic, 8.0) and math.isclose(r.p, math.exp(-4)) and r.error is None
    assert math.isclose(r.critical_difference, 2.343 * math.sqrt(12 / 24))
    two = spark.createDataFrame([("t", *x) for x in rows if x[0] != "c"], "t string, model string, block int, value double")
    assert stats.friedman(two, "model", ["block"], ["t"]).first().error
    ragged = spark.createDataFrame([("t", *x) for x in rows[:-1]], "t string, model string, block int, value double")
    assert stats.friedman(ragged, "model", ["block"], ["t"]).first().error == "unequal blocks"


@pytest.mark.parametrize("x,df,want", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (7.814727903, 3, 0.05), (9.487729037, 4, 0.05), (11.07049769, 5, 0.05), (1.0, 3, 0.8012519569), (30.0, 1, 4.3204630578e-08)])
def test_chi_square(spark, x, df, want):
    got = spark.range(1).select(stats.chi_square_tail(F.lit(x), F.lit(df))).first()[0]
    assert math.isclose(got, want, rel_tol=1e-6)


def test_holm_and_cliques(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "metric string, p double")
    got = {r.metric: r.adjusted for r in stats.holm(t, []).collect()}
    assert all(math.isclose(got[k], v) for k, v in {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}.items())
    m = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 1.9), ("d", 3.5)], "model string, mean_rank double")
    assert [(r.low, r.high) for r in stats.cliques(m, 1.0).collect()] == [(1.0, 1.9)]


def test_ratios(spark):
    t = spark.createDataFrame([("a", 6, 2, 4, 8), ("b", 0, 0, 0, 0), ("c", 98, 0, 0, 2)], "k string, tp long, fp long, fn long, tn long")
    got = {r.k: r for r in metrics.with_ratios(t).collect()}
    assert (got["a"].recall, got["a"].precision, got["a"].base_rate) == (0.6, 0.75, 0.5)
    assert (got["b"].recall, got["b"].precision, got["b"].f1, got["b"].base_rate) == (0.0, 0.0, 0.0, 0.0)
    assert got["c"].trivial_precision == 0.98 and got["c"].support == 98


def test_plateau_and_weights(spark):
    t = spark.createDataFrame([(0.2, 0.50), (0.5, 0.80), (0.6, 0.795), (0.9, 0.60)], "threshold double, separation double")
    assert sorted((r.threshold, r.chosen) for r in calibrate.plateau(t).collect()) == [(0.5, True), (0.6, False)]
    pos = spark.createDataFrame([("big", 1, 1.0)] * 50 + [("small", 1, 1.0), ("big", 2, 1.0), ("small", 2, 1.0)], "dataset string, cls int, score double")
    neg = spark.createDataFrame([("big", 0.1)] * 50 + [("small", 1.0)], "dataset string, score double")
    sep = {round(r.threshold, 2): r.separation for r in calibrate.separation(pos, neg, calibrate.grid(spark)).collect()}
    assert math.isclose(sep[0.5], 0.5) and len(sep) == 19


def test_false_pairs(spark):
    """Every item of an image with people draws one person; none of its own image, nor one equal to one of its own."""
    rng = random.Random(2)
    rows = [(i, k, 0, rng.randint(1, 9) / 10, 0.5, 0.4, 0.8) for i in range(60) for k in range(rng.randint(0, 3))]
    rows += [(i, 10 + k, rng.choice([1, 2]), 0.5, 0.2, 0.1, 0.1) for i in range(60) for k in range(rng.randint(0, 4))]
    boxes = spark.createDataFrame(rows, "image_id long, box_idx int, cls int, xc double, yc double, w double, h double")
    digest = lambda tag, r: hashlib.md5(f"0{tag}|{r[0]}|{r[1]}".encode()).hexdigest()
    useful = {r[0] for r in rows if r[2] == 0} & {r[0] for r in rows if r[2]}
    pool = sorted((r for r in rows if r[2] == 0 and r[0] in useful), key=lambda r: (digest("p", r), r[0], r[1]))
    drawn = {(r[0], r[1]): pool[int(digest("i", r)[:15], 16) % len(pool)] for r in rows if r[2] and r[0] in useful}
    want = {k for k, p in drawn.items() if not any(r[0] == k[0] and r[2] == 0 and r[3:] == p[3:] for r in rows)}
    got = calibrate.false_pairs(boxes).collect()
    assert len(got) == len(want) and {(r.image_id, r.item) for r in got} == want and len(want) < len(drawn)
    assert calibrate.false_pairs(boxes.limit(0)).count() == 0


def test_ordered_values(spark, monkeypatch):
    """Ranks in slices are those of the whole order, with ties, negative values, a null group and one of a single row."""
    monkeypatch.setattr(audit, "SLICES", 5)
    rng = random.Random(3)
    rows = [(g, round(rng.gauss(0, 3), rng.randint(0, 2))) for g in ("a", "b", None) for _ in range(400)] + [("one", 7.0), ("a", None)]
    got = {r.g: r for r in audit.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", {"p0": 0.0, "p37": 0.37, "p95": 0.95, "p100": 1.0}, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert [got[g][c] for c in ("p0", "p37", "p95", "p100")] == [v[min(round(q * (len(v) - 1)), len(v) - 1)] for q in (0, 0.37, 0.95, 1)], g
    assert audit.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", {"p50": 0.5}).count() == 1


def test_sweep_equals_each_threshold(spark):
    """Levels of an image's own confidences against association and matching once for each threshold."""
    from stanchion.operators import assign

    rng = random.Random(4)
    rows, work = [], []
    for i in range(25):
        for k in range(rng.randint(0, 6)):
            cls = rng.choice([0, 0, 1, 2])
            rows.append((i, k, cls, 0.5 + rng.randint(-2, 2) / 20, 0.5 if cls == 0 else 0.3, *((0.4, 0.8) if cls == 0 else (0.1, 0.1)), rng.choice([0.0, 0.2, 0.2, 0.45, 0.9, 1.0])))
        work += [(i, k, 0.5 + k / 20, 0.5, 0.4, 0.8, rng.random() < 0.5, rng.random() < 0.5) for k in range(rng.randint(0, 3))]
    boxes = spark.createDataFrame(rows, "image_id long, box_idx int, cls int, xc double, yc double, w double, h double, conf double")
    workers = spark.createDataFrame(work, "image_id long, worker int, xc double, yc double, w double, h double, helmet boolean, vest boolean")
    taus = [0.1, 0.2, 0.3, 0.5, 0.9, 0.95]
    got = {(r.axis, r.tau): (r.tp, r.fp, r.fn, r.tn, r.missed) for r in metrics.sweep(boxes, workers, taus, ["image_id"]).collect()}
    assert len(got) == 2 * len(taus)
    for tau in taus:
        live = boxes.filter(F.col("conf") >= tau)
        states = assign.people_states(live, assign.bind(live))
        met = assign.match_people(live.filter("cls = 0").withColumnRenamed("box_idx", "person"), workers)
        decided = metrics.by_class(metrics.worker_decisions(workers, met, states, ["image_id"]))
        for r in metrics.confusion(decided, ["axis"], F.col("truth"), F.col("flagged"), F.col("detected")).collect():
            assert got[r.axis, tau] == (r.tp, r.fp, r.fn, r.tn, r.missed), (r.axis, tau)


def test_latency_and_percentiles(spark):
    f = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([500] * 15 + [10, 20, 30, 40])] + [("b", 0, 5.0)], "k string, i int, ms double")
    got = {r.k: r for r in audit.latency(f, ["k"], "i", "ms").collect()}
    assert (got["a"].frames, got["a"].measured, got["a"].median_ms, got["a"].p95_ms) == (19, 4, 30.0, 40.0)
    assert (got["b"].measured, got["b"].median_fps) == (1, 200.0)


def test_progress(spark):
    log = spark.createDataFrame([("r", e, t, m) for e, t, m in [(1, 10.0, 0.1), (2, 20.0, 0.5), (3, 8.0, 0.5), (4, 18.0, 0.4)]], "run string, epoch int, time double, map50 double")
    r = progress.pace(log, ["run"], "epoch", "time", "map50").first()
    assert (r.epoch, r.best, r.best_epoch, r.since_best, r.seconds_per_epoch) == (4, 0.5, 2, 2, 10.0)
    assert math.isclose(r.eta_min, 48 * 10 / 60)
    grid = [(r.seed, r.model, r.direction) for r in progress.run_grid(spark, ["m", "n"], ["f", "o"], [0, 1]).orderBy("ordinal").collect()]
    assert grid[:4] == [(0, "m", "f"), (0, "m", "o"), (0, "n", "f"), (0, "n", "o")] and len(grid) == 8
    kind = "data string, datasets struct<root:string,more:map<string,array<struct<p:string>>>>"
    config = lambda data, root, deep: spark.createDataFrame([(data, (root, {"k": [(deep,), (None,)]}))], kind)
    for bad in (config("a\\Secret\\b", "", "x"), config("a", "", "x/Hidden"), config(None, "SECRET", None)):
        with pytest.raises(Exception, match="forbidden path"):
            progress.guard(bad, ["secret", "hidden", ""]).collect()
    declared = config("a", "d/secret", "x")
    assert progress.guard(declared, ["secret"], exempt=("datasets.root",)).count() == 1
    with pytest.raises(Exception, match="forbidden path"):
        progress.guard(declared, ["secret"]).collect()


def test_run_queue(spark):
    """Done runs are skipped, begun ones resume first, and one that fails does not hold up the others."""
    runs, seen = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string"), []

    def work(row, resume):
        seen.append((row.run_id, resume))
        if row.run_id == "c":
            raise RuntimeError("no memory")

    done, begun = runs.filter("run_id = 'a'"), runs.filter("run_id = 'd'")
    got = {r.run_id: (r.outcome, r.error) for r in progress.run_queue(runs, done, begun, work).collect()}
    assert seen == [("d", True), ("b", False), ("c", False)]
    assert got == {"a": ("skipped", None), "b": ("ok", None), "c": ("failed", "RuntimeError: no memory"), "d": ("ok", None)}
    assert {r.outcome for r in progress.run_queue(runs, done, begun, work, dry=True).collect()} == {"skipped", "dry-run"} and len(seen) == 3


class Killed(BaseException):
    """What no run can raise: the driver goes."""


def test_a_queue_that_was_stopped_goes_on(spark, tmp_path):
    runs, seen = spark.createDataFrame([(x,) for x in "abcdef"], "run_id string"), []
    none, journal = runs.limit(0), str(tmp_path / "journal")

    def work(row, resume):
        seen.append((row.run_id, resume))
        if row.run_id == "b" and len(seen) < 3:
            raise ValueError("the first time")
        if row.run_id == "d" and not resume:
            raise Killed

    with pytest.raises(Killed):
        progress.run_queue(runs, none, none, work, journal=journal)
    assert seen == [("a", False), ("b", False), ("c", False), ("d", False)]
    del seen[:2]
    got = {r.run_id: r.outcome for r in progress.run_queue(runs, none, none, work, journal=journal).collect()}
    # a and c ended well; b failed and is tried again; d had begun, so it resumes
    assert seen[2:] == [("b", False), ("d", True), ("e", False), ("f", False)]
    assert got == dict.fromkeys("abcdef", "ok")
    assert progress.run_queue(runs, none, none, work, journal=journal).filter("outcome = 'ok'").count() == 6 and len(seen) == 6


def test_any_number_of_pairs(spark):
    """Equal sums put together give what all sign vectors give, and the binomial tail where all differences are equal."""
    rng = np.random.default_rng(4)
    for n in (1, 5, 13, 16):
        x = np.round(rng.normal(0.01, 0.03, n), 4)
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        assert stats.shared_sums(x) == pytest.approx((np.abs(signs @ x) / n >= abs(x.sum()) / n - 1e-12).mean(), abs=1e-12)
    rows = [("equal", i, 0.25) for i in range(100)] + [("mixed", i, 0.5 if i < 60 else -0.5) for i in range(90)]
    got = {r.g: (r.n, r.p) for r in stats.sign_flip(spark.createDataFrame(rows, "g string, seed int, diff double"), ["g"]).collect()}
    tail = 2 * sum(math.comb(90, k) for k in range(60, 91)) / 2**90
    assert got["equal"] == (100, pytest.approx(2 / 2**100)) and got["mixed"] == (90, pytest.approx(tail))
    with pytest.raises(ValueError):
        stats.shared_sums(rng.random(60))


def test_draws_in_pieces_are_those_of_one_matrix(monkeypatch):
    x = np.random.default_rng(2).normal(size=37)
    whole = stats.bca(x)
    monkeypatch.setattr(stats, "CELLS", 37 * 61)
    assert stats.bca(x) == whole


@pytest.mark.parametrize("few", [0, 10**6])
def test_describe_and_latency_by_places(spark, monkeypatch, few):
    from stanchion.operators import audit

    monkeypatch.setattr(audit, "FEW", few)
    rng = np.random.default_rng(7)
    rows = [(str(g), i, float(v)) for g, n in enumerate((1, 2, 40, 700)) for i, v in enumerate(np.round(rng.exponential(20, n), 1))]
    df = spark.createDataFrame([*rows, ("none", 0, None)], "g string, i int, v double").repartition(5)
    got = {r.g: r for r in audit.describe(df, "v", ["g"]).collect()}
    assert (got["none"].n, got["none"].p50) == (0, None)
    fast = {r.g: r for r in audit.latency(df, ["g"], "i", "v").collect()}
    for g in "0123":
        x = np.array([v for h, _, v in rows if h == g])
        assert [got[g].p5, got[g].p50, got[g].p95, got[g]["mean"], got[g].sd] == pytest.approx([*np.quantile(x, [0.05, 0.5, 0.95]), x.mean(), x.std()])
        y = np.sort(x[15:] if len(x) > 15 else x)
        assert (fast[g].frames, fast[g].measured, fast[g].median_ms, fast[g].p95_ms) == (len(x), len(y), y[len(y) // 2], y[min(len(y) - 1, int(len(y) * 0.95))])
        assert fast[g].mean_ms == pytest.approx(y.mean())
    assert audit.describe(df, "v").first().n == len(rows)
