"""The tables of the reports: calibration of the association, conversion of labels, and significance over seeds.

A report is a list of (title, table). Tables are summaries of a few rows; render() puts them into one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.sinks import markdown
from ..sources.tables import kept
from . import audit, calibrate, splits, stats

#: Fixed value: the overlap that an earlier rule asked for, which the containment is compared with.
RIVAL_IOU = 0.45


def _named(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("dataset"), "*") for name, t in tables.items()))


def retained(pairs: DataFrame, threshold: float, rival: float = RIVAL_IOU, by: list[str] | None = None) -> DataFrame:
    """(by, pairs, median_score, kept, median_iou, kept_iou, below): true pairs by how many a threshold keeps, against a rule by overlap.
    Medians are the upper ones. pairs: by, score, iou."""
    by = by or ["dataset", "cls"]
    middle = {"median": lambda n: F.floor(n / 2)}
    medians = [audit.ordered(pairs, c, middle, by).select(*by, F.col("median").alias(f"median_{c}")) for c in ("score", "iou")]
    share = lambda c, t: F.avg(F.when(F.col(c) >= t, 1.0).otherwise(0.0))
    told = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), share("score", threshold).alias("kept"), share("iou", rival).alias("kept_iou"), F.count_if(F.col("score") < threshold).alias("below"))
    return reduce(lambda a, b: a.join(b, by), [told, *medians]).select(*by, "pairs", "median_score", "kept", "median_iou", "kept_iou", "below")


def calibration(datasets: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """datasets: boxes (image_id, box_idx, cls, box) by name. The threshold is chosen over all datasets; everything else follows from it."""
    datasets = {name: kept(b.select("image_id", "box_idx", "cls", "xc", "yc", "w", "h"), "boxes") for name, b in datasets.items()}
    spark = next(iter(datasets.values())).sparkSession
    positive = kept(_named({n: calibrate.true_pairs(b) for n, b in datasets.items()}), "true")
    negative = kept(_named({n: calibrate.false_pairs(b) for n, b in datasets.items()}), "false")
    sweep = kept(calibrate.separation(positive.select("dataset", "cls", "score"), negative.select("dataset", "score"), calibrate.grid(spark)), "sweep")
    flat = calibrate.plateau(sweep)
    chosen = flat.filter("chosen").first().threshold
    seen = _named({n: calibrate.evidence(b, chosen) for n, b in datasets.items()})
    of = lambda c: F.count_if(F.col("cls") == c)
    counts = positive.groupBy("dataset").agg(of(G.HELMET).alias("helmet_pairs"), of(G.VEST).alias("vest_pairs"))
    base = seen.join(counts, "dataset", "left").join(negative.groupBy("dataset").agg(F.count("*").alias("false_pairs")), "dataset", "left").fillna(0)
    grid, kept_at = calibrate.grid(spark), retained(positive, chosen)
    by_class = calibrate.retention(positive, grid, ["dataset", "cls"]).groupBy("threshold").pivot("dataset", list(datasets))
    columns = by_class.agg(*(F.max(F.when(F.col("cls") == c, F.col("kept"))).alias(G.CLASS_NAMES[c]) for c in G.REQUIRED))
    lost = calibrate.retention(negative, grid, ["dataset"]).groupBy("threshold").pivot("dataset", list(datasets)).agg(F.max("kept"))
    lost = lost.select("threshold", *(F.col(f"`{n}`").alias(f"{n}_false") for n in datasets))
    excess = F.when(F.col("cls") == G.HELMET, F.try_divide(F.col("excess_helmet_images").cast("double"), F.col("helmet_images"))).alias("excess_images")
    return [
        ("Evidence", base.select("dataset", "single_person_images", "multi_person_images", "helmet_pairs", "vest_pairs", "false_pairs").orderBy("dataset")),
        ("Containment and overlap of true pairs", kept_at.drop("below").orderBy("dataset", "cls")),
        ("Thresholds", sweep.join(columns, "threshold", "left").join(lost, "threshold", "left").orderBy("threshold")),
        ("Chosen, and as good", flat.orderBy("threshold")),
        ("Items in several people", seen.select("dataset", "ambiguous_items").orderBy("dataset")),
        ("True pairs below the threshold", kept_at.join(seen, "dataset").select("dataset", "cls", "below", "pairs", (F.col("below") / F.col("pairs")).alias("share"), excess).orderBy("dataset", "cls")),
    ]


def conversion(boxes: DataFrame, images: DataFrame, mapping: dict[int, int], parts: DataFrame) -> list[tuple[str, DataFrame]]:
    """boxes: image_id, cls of the source's classes; images: image_id; parts: dataset, split, stem."""
    mapped, dropped = audit.remap(boxes, mapping)
    spark = boxes.sparkSession
    rows = [(int(a), int(b)) for a, b in sorted(mapping.items())]
    empty = images.join(mapped.select("image_id").distinct(), "image_id", "left_anti").agg(F.count("*").alias("empty_images"))
    instances = mapped.agg(*(F.count_if(F.col("cls") == c).alias(name) for c, name in G.CLASS_NAMES.items()))
    twice = parts.groupBy("dataset", "stem").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    problems = twice.groupBy("dataset", F.array_join("splits", "+").alias("splits")).agg(F.count("*").alias("stems_in_several"))
    return [
        ("Mapping", spark.createDataFrame(rows, "source int, target int")),
        ("Dropped", dropped.orderBy("cls")),
        ("Kept", instances.crossJoin(F.broadcast(empty))),  # one row each
        ("Splits", splits.split_ids(parts, ["dataset", "split"], "stem").orderBy("dataset", "split")),
        ("Problems", problems.orderBy("dataset", "splits")),
    ]


def significance(scores: DataFrame, model: str = "model", dataset: str = "trained_on", seed: str = "seed", metric: str = "metric") -> list[tuple[str, DataFrame]]:
    """All tables over seeds, with the width of intervals, and what a test of so few pairs could show at all."""
    t = stats.aggregate(scores, model, dataset, seed, metric)
    wide = lambda df: df.withColumn("width", F.col("high") - F.col("low"))
    able = F.when(F.col("p") < stats.ALPHA, "significant").when(F.col("min_p") >= stats.ALPHA, "underpowered").otherwise("not significant")
    return [
        ("Cells", wide(t["per_cell"]).orderBy(metric, model, dataset)),
        ("Pooled", wide(t["pooled"]).orderBy(metric, model)),
        ("Pairs", t["paired"].withColumn("verdict", able).orderBy(metric, "a", "b")),
        ("Ranks", t["mean_ranks"].orderBy(metric, "mean_rank")),
        ("Omnibus", t["omnibus"].orderBy(metric)),
    ]


def render(title: str, tables: list[tuple[str, DataFrame]]) -> str:
    """A report as text. Its tables are collected: they hold a row for each dataset, class, threshold, model or split."""
    return f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown(table)}\n" for name, table in tables)
