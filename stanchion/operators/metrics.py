"""Confusion tables and what is derived from them. Empty denominators give 0.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import assign, frames


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(decided: DataFrame, by: list[str], truth: Column, flagged: Column, detected: Column, n: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn and missed (of fn, those never detected) per group; violation is positive. n: how many decisions a row stands for."""
    count = F.count_if if n is None else lambda on: F.coalesce(F.sum(F.when(on, n)), F.lit(0))
    return decided.groupBy(*by).agg(
        count(truth & flagged).alias("tp"),
        count(~truth & flagged).alias("fp"),
        count(truth & ~flagged).alias("fn"),
        count(~truth & ~flagged).alias("tn"),
        count(truth & ~flagged & ~detected).alias("missed"),
    )


def with_ratios(table: DataFrame) -> DataFrame:
    """recall, precision, f1, base_rate, and the baseline that always flags: recall 1, precision the base rate."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = table.withColumn("support", tp + fn).withColumn("recall", ratio(tp, tp + fn)).withColumn("precision", ratio(tp, tp + fp))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("base_rate", ratio(tp + fn, tp + fp + fn + tn))
    return out.withColumn("trivial_recall", F.lit(1.0)).withColumn("trivial_precision", F.col("base_rate"))


def worker_decisions(workers: DataFrame, matched: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Each labelled worker with what the detections say: detected, and per class whether it is flagged as missing.

    workers: keys, worker, helmet, vest; matched: keys, worker, person; states: keys, person, wears_helmet, wears_vest.
    """
    met = workers.join(matched, [*keys, "worker"], "left").join(states.select(*keys, "person", "wears_helmet", "wears_vest"), [*keys, "person"], "left")
    return _flagged(met)


def decisions(rows: DataFrame, keys: list[str], fields: list[str], crowd: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """worker_decisions() of a table of boxes and workers (frames.scenes()): keys, fields of the worker, person, detected, flags.

    A frame is one row, in which its boxes are associated and its workers matched. crowd: frames that go by joins instead, to the same rows.
    """
    told = frames.decided(F.col("workers"), F.col("_bound"), F.col("_matched"), fields)
    out = _flagged(_in_frames(rows, keys, crowd, first).select(*keys, F.inline(told)))
    if crowd is None:
        return out
    _, _, workers, states, matched = _by_joins(rows, keys, crowd)
    return out.unionByName(worker_decisions(workers, matched, states, keys).select(*out.columns))


def tell(rows: DataFrame, keys: list[str], crowd: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """(keys, worker, person, wears_helmet, wears_vest) of the same table: each worker with the box of its person, and each person of nobody."""
    out = _in_frames(rows, keys, crowd, first).select(*keys, F.inline(frames.told(F.col("boxes"), F.col("workers"), F.col("_bound"), F.col("_matched"))))
    if crowd is None:
        return out
    boxes, people, workers, states, matched = _by_joins(rows, keys, crowd)
    box, own = (next(f.dataType for f in rows.schema if f.name == c) for c in ("box", "worker"))
    whole = lambda df, names, c: df.select(*keys, F.struct(*(F.col(n) for n in names)).alias(c))
    seen = boxes.filter(F.col("cls") == G.PERSON).select(*keys, F.col("box_idx").alias("_p"), F.struct(*box.names).alias("person"))
    worn = states.select(*keys, F.col("person").alias("_p"), "wears_helmet", "wears_vest")
    met = whole(workers, own.names, "worker").withColumn("_w", F.col("worker.worker"))
    pairs = matched.select(*keys, F.col("worker").alias("_w"), F.col("person").alias("_p"))
    seen = seen.join(worn, [*keys, "_p"]).join(pairs, [*keys, "_p"], "left")
    out_ = met.join(seen, [*keys, "_w"], "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.unionByName(out_.select(*keys, "worker", "person", no("wears_helmet"), no("wears_vest")))


def _in_frames(rows: DataFrame, keys: list[str], crowd: DataFrame | None, first: Column | None) -> DataFrame:
    """(keys, boxes, workers, _bound, _matched) of all frames but the crowded."""
    few = rows if crowd is None else rows.join(crowd, keys, "left_anti")
    matched = frames.matched(frames.overlapping(F.col("boxes"), F.col("workers")))
    return frames.scenes(few, keys, first).select(*keys, "boxes", "workers", frames.bindings(F.col("boxes")).alias("_bound"), matched.alias("_matched"))


def _by_joins(rows: DataFrame, keys: list[str], crowd: DataFrame) -> tuple[DataFrame, ...]:
    """Boxes, people, workers, people's states and matches of the crowded frames."""
    many = rows.join(crowd, keys, "left_semi")
    boxes, workers = (many.filter(F.col(c).isNotNull()).select(*keys, f"{c}.*") for c in ("box", "worker"))
    people = boxes.filter(F.col("cls") == G.PERSON).withColumnRenamed("box_idx", "person")
    return boxes, people, workers, assign.people_states(boxes, assign.bind(boxes, keys), keys), assign.match_people(people, workers, keys)


def _flagged(met: DataFrame) -> DataFrame:
    """met, workers with person, wears_helmet and wears_vest, with detected and what is flagged as missing."""
    met = met.withColumn("detected", F.col("person").isNotNull())
    flag = lambda c: F.coalesce(F.col("detected") & ~F.col(c), F.lit(False))
    return met.withColumn("flag_helmet", flag("wears_helmet")).withColumn("flag_vest", flag("wears_vest"))


def passed(value: Column, thresholds: list) -> Column:
    """How many of the thresholds (ascending) a value reaches: each half of them is asked for once."""
    if not thresholds:
        return F.lit(0)

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= thresholds[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(thresholds))


def sweep(boxes: DataFrame, workers: DataFrame, thresholds: list, keys: list[str], conf: str = "conf") -> DataFrame:
    """(axis, tau, tp, fp, fn, tn, missed) at every threshold (ascending), with only the boxes of that confidence or more."""
    box = F.struct("box_idx", "cls", "xc", "yc", "w", "h", conf)
    worker = F.struct("worker", "xc", "yc", "w", "h", "helmet", "vest")
    rows = boxes.select(*keys, box.alias("box")).unionByName(workers.select(*keys, worker.alias("worker")), allowMissingColumns=True)
    return sweep_scenes(frames.scenes(rows, keys), thresholds, conf)


def sweep_scenes(scenes: DataFrame, thresholds: list, conf: str = "conf") -> DataFrame:
    """sweep() of frames of one row (frames.scenes()).

    What an image's boxes say changes only at the confidences of those that meet. So an image is associated and matched once for each of
    these (a level, for the thresholds above the one before it), however many thresholds there are; levels are counted by the range
    of thresholds that they hold for, and only the counts are spread over the thresholds.
    """
    # how many thresholds a box passes
    live = F.filter(F.transform("boxes", lambda x: x.withField("passed", passed(x[conf], thresholds))), lambda x: x["passed"] > 0)
    seen = scenes.filter(F.size("workers") > 0).select("workers", live.alias("boxes"))
    # each image's pairs are measured once, and known with the thresholds that both of their boxes pass
    binds = frames.candidates(F.col("boxes"), more=lambda i, p: F.least(i["passed"], p["passed"]))
    overlaps = frames.overlapping(F.col("boxes"), F.col("workers"), more=lambda p: p["passed"])
    met = seen.select("workers", binds.alias("_binds"), overlaps.alias("_overlaps"))
    ends = F.concat(*(F.transform(c, lambda x: x["more"]) for c in ("_binds", "_overlaps")), F.array(F.lit(len(thresholds))))
    met = met.withColumn("_ends", F.sort_array(F.array_distinct(ends)))
    live_at = lambda c, level: F.filter(c, lambda x: x["more"] >= level)

    def at(hi: Column, i: Column) -> Column:
        both = F.struct(frames.bound(live_at("_binds", hi)).alias("b"), frames.matched(live_at("_overlaps", hi)).alias("m"))
        lo = F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))
        told = frames._once(both, lambda x: frames.decided(F.col("workers"), x["b"], x["m"], ["helmet", "vest"]))
        return F.struct(lo.alias("lo"), hi.alias("level"), told.alias("told"))

    levels = met.select(F.inline(F.transform("_ends", at))).select("lo", "level", F.inline("told"))
    # equal decisions are counted before they are told apart by class
    decided = _flagged(levels).groupBy("lo", "level", "helmet", "vest", "detected", "flag_helmet", "flag_vest").agg(F.count("*").alias("n"))
    counted = confusion(by_class(decided), ["axis", "lo", "level"], F.col("truth"), F.col("flagged"), F.col("detected"), F.col("n"))
    taus = F.array(*(F.lit(t) for t in thresholds))
    spread = counted.withColumn("tau", F.explode(F.slice(taus, F.col("lo") + 1, F.col("level") - F.col("lo"))))
    return spread.groupBy("axis", "tau").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "missed")))


def by_class(decided: DataFrame) -> DataFrame:
    """decided in long form: axis, truth (it is missing), flagged."""
    axis = lambda name: F.struct(F.lit(name).alias("axis"), (~F.col(name)).alias("truth"), F.col(f"flag_{name}").alias("flagged"))
    return decided.withColumn("_a", F.explode(F.array(axis("helmet"), axis("vest")))).select("*", "_a.axis", "_a.truth", "_a.flagged").drop("_a")


def zone_alerts(people: DataFrame, workers: DataFrame, matched: DataFrame, keys: list[str], zones: list[str]) -> DataFrame:
    """Per zone: alerts on workers who should be alerted on, on compliant ones, on unmatched detections, and misses.

    people: keys, person, alerting (names of zones); workers: keys, worker, standing (names of zones), lacks; matched: keys,
    worker, person. Rows meet once per image and are opened up by zone only when they are counted.
    """
    return zone_counts(alert_rows(people, workers, matched, keys), zones)


def alert_rows(people: DataFrame, workers: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """(own, standing, lacks, alerting, found): each worker, and each detection of nobody (own: false)."""
    found = people.select(*keys, "person", "alerting").join(matched, [*keys, "person"], "left")
    # one full outer join holds workers found, workers missed, and (their worker null) detections of nobody
    seen = workers.withColumn("_own", F.lit(True)).join(found, [*keys, "worker"], "full_outer")
    return seen.select(F.coalesce("_own", F.lit(False)).alias("own"), "standing", "lacks", "alerting", F.col("person").isNotNull().alias("found"))


def zone_counts(seen: DataFrame, zones: list[str]) -> DataFrame:
    """zone_alerts() of alert_rows(): rows that say the same are counted, and only the counts are opened up by zone."""
    same = seen.groupBy("own", "standing", "lacks", "alerting", "found").agg(F.count("*").alias("n"))
    same = same.withColumn("zone", F.explode(F.array(*(F.lit(z) for z in zones))))
    holds = lambda c: F.coalesce(F.array_contains(c, F.col("zone")), F.lit(False))
    own, count = F.col("own"), lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    inside, hit = own & holds("standing"), holds("alerting")
    should = inside & F.col("lacks")
    out = same.groupBy("zone").agg(
        count(own).alias("workers"),
        count(inside).alias("workers_in_zone"),
        count(should).alias("should_alert"),
        count(should & hit).alias("tp"),
        count(should & ~hit).alias("fn"),
        count(should & ~hit & ~F.col("found")).alias("missed"),
        count(own & ~should & hit).alias("fp_compliant"),
        count(~own & hit).alias("fp_unmatched"),
    )
    tp, fn, fpc, fpu = (F.col(c) for c in ("tp", "fn", "fp_compliant", "fp_unmatched"))
    out = out.withColumn("precision", ratio(tp, tp + fpc + fpu)).withColumn("precision_worker_level", ratio(tp, tp + fpc)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
