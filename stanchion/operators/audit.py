"""Counts, votes, cross tables and summaries of label tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.tables import kept
from .assign import _side, crowded, meet

#: Slices that a group's values are cut into to be ranked.
SLICES = 64


def class_counts(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return boxes.groupBy(*(by or []), "cls").agg(F.count("*").alias("n"))


def cooccurrence(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """(a, b, n): images that hold both classes, a <= b, a class with itself included. Pairs are made inside each image's short list of classes."""
    have = boxes.groupBy(key).agg(F.sort_array(F.collect_set("cls")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return have.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def majority(votes: DataFrame, by: list[str], vote: str, order: str) -> DataFrame:
    """(by, vote, n, purity): the most frequent vote, of equals the one whose first row comes first in `order`."""
    each = votes.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    total = F.sum("n").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "first", vote))
    best = each.withColumn("purity", F.col("n") / total).withColumn("_r", rank).filter("_r = 1")
    return best.select(*by, vote, "n", "purity")


def containment_table(workers: DataFrame, items: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(code, has_helmet, has_vest, n): workers by their label and by the items inside them. Workers without items count.

    workers: keys, worker, code, box; items: keys, cls, box.
    """
    own, there = _side(workers, keys, "w_", ["worker", "code"]), _side(items, keys, "i_", ["cls"])
    crowd = crowded([workers, items], keys) if least >= 0.5 else None
    if crowd is None:
        met = own.join(there, keys, "left")
    else:  # only items that can be half inside a worker meet them; workers that meet none stay
        near = meet(there, own, keys, "i_", "w_", crowd)
        met = near.unionByName(own.join(near.select(*keys, "w_worker").distinct(), [*keys, "w_worker"], "left_anti"), allowMissingColumns=True)
    inside = F.coalesce(G.containment(G.box("i_"), G.box("w_")) >= least, F.lit(False))
    per = met.groupBy(*keys, "w_worker").agg(F.first("w_code").alias("code"), F.bool_or(inside & (F.col("i_cls") == G.HELMET)).alias("h"), F.bool_or(inside & (F.col("i_cls") == G.VEST)).alias("v"))
    per = per.select("code", F.coalesce("h", F.lit(False)).alias("has_helmet"), F.coalesce("v", F.lit(False)).alias("has_vest"))
    return per.groupBy("code", "has_helmet", "has_vest").agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row: how many workers' items agree with their label, of how many."""
    helmet, vest = G.decode_state(F.col("code"))
    ok = (F.col("has_helmet") == helmet) & (F.col("has_vest") == vest)
    return table.agg(F.coalesce(F.sum(F.when(ok, F.col("n")).otherwise(0)), F.lit(0)).alias("agreements"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, and interpolated 5th, 50th and 95th percentiles, each between the two values next to its place."""
    by = by or []
    # one scan: all that is told follows from how often each value occurs, null ones too, for a group of these is a group
    counts = kept(df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "counts")
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    at = lambda q, n: F.lit(q) * (n - 1)
    places: dict[str, Callable[[Column], Column]] = {}
    for name, q in shares.items():
        places[f"{name}_lo"] = lambda n, q=q: F.floor(at(q, n))
        places[f"{name}_hi"] = lambda n, q=q: F.ceil(at(q, n))
    got = _at_places(counts.filter("_v is not null"), places, by)
    low = lambda name, n: F.floor(at(shares[name], n))
    there = F.when(F.col("_v").isNotNull(), F.col("_c"))
    means = counts.groupBy(*by).agg(F.coalesce(F.sum(there), F.lit(0)).alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum(there)).alias("mean"))
    away = counts.join(means.select(*(F.col(c).alias(f"_{c}") for c in by), "mean"), reduce(and_, (counts[c].eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True)))
    spread = away.groupBy(*by).agg(F.sqrt(F.sum((F.col("_v") - F.col("mean")) ** 2 * F.col("_c")) / F.sum(there)).alias("sd"))
    spread = spread.select(*(F.col(c).alias(f"_s_{c}") for c in by), "sd")
    moments = means.join(spread, reduce(and_, (means[c].eqNullSafe(spread[f"_s_{c}"]) for c in by), F.lit(True))).select(*by, "n", "mean", "sd")
    between = lambda name, n: F.when(F.col(f"{name}_lo") == F.col(f"{name}_hi"), F.col(f"{name}_lo")).otherwise((low(name, n) + 1 - at(shares[name], n)) * F.col(f"{name}_lo") + (at(shares[name], n) - low(name, n)) * F.col(f"{name}_hi"))
    told = got.select(*(F.col(c).alias(f"_{c}") for c in by), *(between(name, F.col("n")).alias(name) for name in shares))
    on = reduce(and_, (moments[c].eqNullSafe(told[f"_{c}"]) for c in by), F.lit(True))
    return moments.join(told, on, "left").select(*by, "n", "mean", "sd", *shares)


#: Distinct values up to which each group's are numbered by one window; of more, slices of them are.
FEW = 1_000_000


def _counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, _v, _c): how often each value of a group occurs, kept."""
    return kept(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")


def ordered(df: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], by: list[str]) -> DataFrame:
    """(by, n, and under each name the value at a place of the group's sorted values): places are from 0, given as functions
    of n; null values are left out."""
    return _at_places(_counted(df, value, by), places, by)


def _at_places(counts: DataFrame, places: dict[str, Callable[[Column], Column]], by: list[str]) -> DataFrame:
    """ordered() of counted values.

    Equal values are counted first. Where few distinct ones remain, they are numbered by a window. Otherwise no group is sorted in one
    task: an approximate quantile sketch cuts the values into slices, whose exact sizes say which slices hold the places, and
    only these are sorted.
    """
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()))
    run = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    if counts.count() <= FEW:
        rows = counts.withColumn("n", F.sum("_c").over(run)).withColumn("_upto", F.sum("_c").over(run.orderBy("_v"))).withColumn("_held", wanted)
    else:
        rows = _in_slices(counts, wanted, by, run)
    met = F.filter("_held", lambda w: (w.place < F.col("_upto")) & (w.place >= F.col("_upto") - F.col("_c")))
    got = rows.select(*by, "n", "_v", F.explode(met).alias("_w"))
    return got.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in places))


def _in_slices(counts: DataFrame, wanted: Column, by: list[str], run) -> DataFrame:
    same = lambda x, y, cols: reduce(and_, (x[c].eqNullSafe(y[c]) for c in cols), F.lit(True))
    marks = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / SLICES for i in range(1, SLICES)], 1000).alias("_marks"))
    x, y = counts.alias("x"), marks.alias("y")
    sliced = x.join(y, same(counts, marks, by)).select(*(F.col(f"x.{c}") for c in by), "_v", "_c", F.size(F.filter("_marks", lambda m: m < F.col("_v"))).alias("_s"))
    # windows over the SLICES rows of a group
    sizes = sliced.groupBy(*by, "_s").agg(F.sum("_c").alias("_m")).withColumn("n", F.sum("_m").over(run)).withColumn("_before", F.sum("_m").over(run.orderBy("_s")) - F.col("_m"))
    held = F.filter(wanted, lambda w: (w.place >= F.col("_before")) & (w.place < F.col("_before") + F.col("_m")))
    some = sizes.withColumn("_held", held).filter(F.size("_held") > 0).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_s").alias("_slice"), "n", "_before", "_held")
    on = reduce(and_, (sliced[c].eqNullSafe(some[f"_{c}"]) for c in by), sliced["_s"] == some["_slice"])
    upto = F.sum("_c").over(W.partitionBy(*by, "_s").orderBy("_v")) + F.col("_before")
    return sliced.join(some, on).withColumn("_upto", upto)


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank: place bround(q * (n - 1)) of the sorted values."""
    place = lambda q: lambda n: F.least(F.bround(F.lit(q) * (n - 1)), n - 1)
    return ordered(df, value, {name: place(q) for name, q in shares.items()}, by or []).drop("n")


def latency(frames: DataFrame, by: list[str], order: str, value: str, warm_up: int = 15) -> DataFrame:
    """frames, measured, mean, upper median, p95 and rates per group, without the first `warm_up` frames unless there are no
    others. order is unique in a group."""
    first = frames.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("_i") <= warm_up)  # kept few by each task
    warm = first.groupBy(*by).agg(F.max(order).alias("_warm")).select(*(F.col(c).alias(f"_{c}") for c in by), "_warm")
    size = frames.groupBy(*by).agg(F.count("*").alias("frames")).select(*(F.col(c).alias(f"_{c}") for c in by), "frames")
    on = lambda x, y: reduce(and_, (x[c].eqNullSafe(y[f"_{c}"]) for c in by))
    told = size.join(warm.select(*(F.col(f"_{c}").alias(f"_w{c}") for c in by), "_warm"), reduce(and_, (F.col(f"_{c}").eqNullSafe(F.col(f"_w{c}")) for c in by)))
    measured = frames.join(told, on(frames, told)).filter((F.col(order) > F.col("_warm")) | (F.col("frames") <= warm_up)).select(*frames.columns, "frames")
    # values are counted once; all that is told follows from how often each occurs
    counts = kept(measured.groupBy(*by, "frames", F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    mean = counts.groupBy(*by).agg(F.first("frames").alias("frames"), F.sum("_c").alias("measured"), (F.sum(F.col("_v") * F.col("_c")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))).alias("mean_ms"))
    at = _at_places(counts.filter("_v is not null"), {"median_ms": lambda n: F.floor(n / 2), "p95_ms": lambda n: F.least(n - 1, F.floor(n * 0.95))}, by).drop("n")
    at = at.select(*(F.col(c).alias(f"_{c}") for c in by), "median_ms", "p95_ms")
    rate = lambda c: F.try_divide(F.lit(1000.0), F.col(c))
    out = mean.join(at, on(mean, at), "left").select(*by, "frames", "measured", "mean_ms", "median_ms", "p95_ms")
    return out.withColumn("mean_fps", rate("mean_ms")).withColumn("median_fps", rate("median_ms"))


def timing(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation, 0 for one row."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def duplicate_groups(files: DataFrame, content: Column, key: str) -> DataFrame:
    """(digest, n, first) of contents that several keys have."""
    return files.groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def duplicate_members(files: DataFrame, content: Column, key: str) -> DataFrame:
    """(digest, key) of every file whose content several keys have, however many they are."""
    marked = files.select(F.md5(content).alias("digest"), F.col(key))
    return marked.join(duplicate_groups(files, content, key).select("digest"), "digest", "left_semi")


def constant_within(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, high, constant): whether a value is the same in all rows of a group."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")).withColumn("constant", F.col("low").eqNullSafe(F.col("high")))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, density): equal bins from low to high, the last one closed; values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    inside = df.filter((value >= low) & (value <= high)).withColumn("bin", at)
    each = inside.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))
    run = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return each.withColumn("density", F.col("n") / (F.sum("n").over(run) * width))


def log_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n): bins of equal width in the logarithm from low to high, the last one closed; values outside, and those
    that have no logarithm, are left out."""
    step = (math.log10(high) - math.log10(low)) / bins
    inside = df.filter((value >= low) & (value <= high) & (value > 0))
    at = F.least(F.floor((F.log10(value) - math.log10(low)) / step), F.lit(bins - 1))
    return inside.groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def remap(boxes: DataFrame, mapping: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Boxes with their classes mapped, and how many of each unmapped class were dropped."""
    to = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    marked = boxes.withColumn("_to", to[F.col("cls")])
    kept = marked.filter("_to is not null").withColumn("cls", F.col("_to")).drop("_to")
    return kept, marked.filter("_to is null").groupBy("cls").agg(F.count("*").alias("dropped"))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
