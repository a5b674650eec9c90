"""Choosing the containment threshold: scores of true and false pairs, retention by threshold, separation, plateau."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.tables import kept
from .assign import FIELDS, crowded
from .metrics import passed
from .splits import hash_places

#: The threshold grid is 0.05 .. 0.95; separations this close count as equal.
STEPS, PLATEAU = 19, 0.01


def grid(spark, steps: int = STEPS) -> DataFrame:
    return spark.range(1, steps + 1).select((F.col("id") * 5 / 100).alias("threshold"))


def true_pairs(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, item, cls, score, iou): items of images with exactly one person, scored against that person. One pass: an image's
    people are counted, and the one is handed to its items, by a window."""
    keys = keys or ["image_id"]
    image, person = W.partitionBy(*keys), F.col("cls") == G.PERSON
    met = boxes.select(*keys, "box_idx", "cls", *FIELDS, F.count_if(person).over(image).alias("_n"), F.max(F.when(person, F.struct(*FIELDS))).over(image).alias("_p"))
    met = met.filter((F.col("_n") == 1) & F.col("cls").isin(*G.REQUIRED))
    i, p = G.box(), G.Box(*(F.col(f"_p.{c}") for c in FIELDS))
    return met.select(*keys, F.col("box_idx").alias("item"), "cls", G.containment(i, p).alias("score"), G.iou(i, p).alias("iou"))


def false_pairs(boxes: DataFrame, key: str = "image_id", seed: int = 0) -> DataFrame:
    """(key, item, score): every item of an image with people against a person of another image, drawn by a hash. A person
    equal in value to a box of the item's own image is no false pair, and the item then has none.

    The people of images with items are numbered in the order of a hash, and an item draws a number: an equi join. The boxes of
    these images are kept once; an item brings its own image's people along, but in a crowded image, where they are joined."""
    crowd = crowded([boxes], [key])
    person, item = F.col("cls") == G.PERSON, F.col("cls").isin(*G.REQUIRED)
    value = F.struct(*FIELDS)

    def useful(df: DataFrame, own: Column) -> DataFrame:
        image = W.partitionBy(key)
        met = df.select(key, "box_idx", *FIELDS, person.alias("_person"), item.alias("_item"), F.bool_or(person).over(image).alias("_a"), F.bool_or(item).over(image).alias("_b"), own.alias("_own"))
        return met.filter(F.col("_a") & F.col("_b") & (F.col("_person") | F.col("_item"))).select(key, "box_idx", *FIELDS, "_person", F.when(F.col("_item"), F.col("_own")).alias("_own"))

    own = F.collect_list(F.when(person, value)).over(W.partitionBy(key))
    if crowd is None:
        both = useful(boxes, own)
    else:
        kind = boxes.select(F.array(value).alias("v")).schema["v"].dataType
        both = useful(boxes.join(crowd, key, "left_anti"), own).unionByName(useful(boxes.join(crowd, key, "left_semi"), F.lit(None).cast(kind)))
    both = kept(both, "useful")
    of = lambda tag: F.md5(F.concat_ws("|", F.lit(f"{seed}{tag}"), F.col(key).cast("string"), F.col("box_idx").cast("string")).cast("binary"))
    people, items = both.filter("_person"), both.filter("NOT _person")
    pool = hash_places(people.select(key, "box_idx", *FIELDS), of("p"), [key, "box_idx"]).select("_place", *(F.col(c).alias("p_" + c) for c in FIELDS))
    drawn = F.conv(F.substring(of("i"), 1, 15), 16, 10).cast("long") % F.col("_n")
    items = items.crossJoin(F.broadcast(people.agg(F.count("*").alias("_n")))).withColumn("_place", drawn)  # one row
    met = items.join(pool, "_place")
    same = lambda v: reduce(and_, (v[c] == F.col("p_" + c) for c in FIELDS))
    met = met.filter(F.coalesce(~F.exists("_own", same), F.lit(True)))
    if crowd is not None:
        theirs = people.join(crowd, key, "left_semi").select(key, *(F.col(c).alias("p_" + c) for c in FIELDS))
        met = met.join(theirs, [key, *("p_" + c for c in FIELDS)], "left_anti")
    return met.select(key, F.col("box_idx").alias("item"), G.containment(G.box(), G.box("p_")).alias("score"))


#: Thresholds up to which scores are told apart by one compiled expression.
FEW = 200


def retention(scores: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, threshold, kept): share of scores at or above each threshold. Groups without scores are for the caller: retention of nothing is 1.

    Scores are counted by how many thresholds they reach, and only the counts meet the thresholds."""
    reached = F.col(score) >= F.col("threshold")
    few = [r.threshold for r in thresholds.select("threshold").distinct().orderBy("threshold").limit(FEW + 1).collect()]
    if len(few) > FEW or None in few:
        met = scores.crossJoin(F.broadcast(thresholds))
        return met.groupBy(*by, "threshold").agg(F.avg(F.when(reached, 1.0).otherwise(0.0)).alias("kept"))
    # a score stands for its level, the highest threshold that it reaches
    levels = scores.groupBy(*by, passed(F.col(score), few).alias("_level")).agg(F.count("*").alias("_c"))
    place = thresholds.withColumn("_at", passed(F.col("threshold"), few))
    met = levels.crossJoin(F.broadcast(place))
    return met.groupBy(*by, "threshold").agg((F.sum(F.when(F.col("_level") >= F.col("_at"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("kept"))


def separation(positive: DataFrame, negative: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, separation): mean over dataset and class of true pairs kept, less mean over datasets of false pairs kept.

    positive: dataset, cls, score; negative: dataset, score. A class that a dataset has no pairs of counts as kept.
    """
    sets = F.broadcast(positive.select("dataset").union(negative.select("dataset")).distinct())
    classes = F.array(*(F.lit(c) for c in G.REQUIRED))
    every = sets.crossJoin(F.broadcast(thresholds))
    held = every.select("dataset", "threshold", F.explode(classes).alias("cls")).join(retention(positive, thresholds, ["dataset", "cls"]), ["dataset", "cls", "threshold"], "left")
    lost = every.join(retention(negative, thresholds, ["dataset"]), ["dataset", "threshold"], "left")
    mean = lambda df, name: df.groupBy("threshold").agg(F.avg(F.coalesce("kept", F.lit(1.0))).alias(name))
    return mean(held, "p").join(mean(lost, "n"), "threshold").select("threshold", (F.col("p") - F.col("n")).alias("separation"))


def plateau(table: DataFrame, tolerance: float = PLATEAU) -> DataFrame:
    """Rows of a (threshold, separation) table within tolerance of the best, `chosen` marking the first of the best."""
    best = F.broadcast(table.agg(F.max("separation").alias("best"), F.max_by("threshold", F.struct("separation", -F.col("threshold"))).alias("pick")))
    met = table.crossJoin(best).filter(F.col("separation") >= F.col("best") - tolerance)
    return met.select("threshold", "separation", (F.col("threshold") == F.col("pick")).alias("chosen"))


def evidence(boxes: DataFrame, threshold: float | Column = G.CONTAINMENT, keys: list[str] | None = None) -> DataFrame:
    """One row of counts: images with one and several people (and items), items in more than one person of these, images
    with helmets, and images with more helmets than people."""
    keys = keys or ["image_id"]
    per = boxes.groupBy(*keys).agg(F.count_if(F.col("cls") == G.PERSON).alias("people"), F.count_if(F.col("cls") == G.HELMET).alias("helmets"), F.count_if(F.col("cls").isin(*G.REQUIRED)).alias("items"))
    both = (F.col("people") > 0) & (F.col("items") > 0)
    a = per.agg(
        F.count_if(both & (F.col("people") == 1)).alias("single_person_images"),
        F.count_if(both & (F.col("people") > 1)).alias("multi_person_images"),
        F.count_if(F.col("helmets") > 0).alias("helmet_images"),
        F.count_if((F.col("helmets") > 0) & (F.col("helmets") > F.col("people"))).alias("excess_helmet_images"),
    )
    from .assign import candidates

    hits = candidates(boxes, keys, threshold).groupBy(*keys, "item").agg(F.count("*").alias("n")).filter("n > 1")
    return a.crossJoin(F.broadcast(hits.agg(F.count("*").alias("ambiguous_items"))))


def weakest(pairs: DataFrame, k: int, by: list[str], tie: list[str], score: str = "score") -> DataFrame:
    """Per group the k lowest scores, with their rank."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(score, *tie))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
