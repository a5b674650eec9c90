"""A frame as one row: what is done to its boxes in sequence, over arrays.

The operators of `assign` and `zone` take one row per box and shuffle by image. Where a frame comes
as one row with an array of boxes, as from a stream, the same steps are folds over that array, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def gather(boxes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, boxes): one row per frame."""
    return boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))


def _box(x: Column) -> G.Box:
    return G.Box(x["xc"], x["yc"], x["w"], x["h"])


def _people(boxes: Column) -> Column:
    return F.filter(boxes, lambda x: x["cls"] == G.PERSON)


def duplicates(boxes: Column, overlap: float = G.DUPLICATE) -> Column:
    """Indices of people contained in a larger person that is itself not dropped by then, in index order."""
    hides = lambda a, b: (a["box_idx"] != b["box_idx"]) & (G.area(_box(b)) > G.area(_box(a))) & (G.containment(_box(a), _box(b)) >= overlap)
    over = lambda a: F.transform(F.filter(_people(boxes), lambda b: hides(a, b)), lambda b: F.struct(a["box_idx"].alias("small"), b["box_idx"].alias("large")))
    pairs = F.array_sort(F.flatten(F.transform(_people(boxes), over)))
    held = lambda acc, x: F.array_contains(acc, x["small"]) | F.array_contains(acc, x["large"])
    return F.aggregate(pairs, F.array().cast("array<int>"), lambda acc, x: F.when(held(acc, x), acc).otherwise(F.concat(acc, F.array(x["small"].cast("int")))))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f looks at it. Inside a function over an array an expression is
    evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _measured(boxes: Column) -> Column:
    """Each box with its corners and area."""
    named = lambda b: zip(("x1", "y1", "x2", "y2"), G.corners(b))
    return F.transform(boxes, lambda x: F.struct(x.alias("box"), *(v.alias(n) for n, v in named(_box(x))), G.area(_box(x)).alias("area")))


def _common(a: Column, b: Column) -> Column:
    return G.common(*(tuple(m[c] for c in ("x1", "y1", "x2", "y2")) for m in (a, b)))


def _near(these: Column, those: Column, share: Callable[[Column, Column], Column], least: float | Column, row: Callable[[Column], Column]) -> Column:
    """The row of each pair <a, b, share> of these and those with a share of `least` or more, in order."""
    mine, other = _measured(these), _measured(those)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"), share(a, b).alias("share"))
    of = lambda all_: lambda a: F.filter(F.transform(all_, lambda b: pair(a, b)), lambda x: x["share"] >= least)
    return _once(other, lambda all_: F.array_sort(F.transform(F.flatten(F.transform(mine, of(all_))), row)))


def candidates(boxes: Column, threshold: float | Column = G.CONTAINMENT, more: Callable[[Column, Column], Column] = lambda i, p: F.lit(0)) -> Column:
    """Items and the people they are inside, in the order in which they bind: strongest containment first, ties to the nearer
    anchor, then by index. more: what else of the two is to be known."""
    share = lambda i, p: F.when(i["area"] > 0, _common(i, p) / i["area"]).otherwise(0.0)

    def row(x: Column) -> Column:
        i, p = x["a"]["box"], x["b"]["box"]
        return F.struct((-x["share"]).alias("s"), G.anchor_distance(_box(i), i["cls"], _box(p)).alias("d"), i["box_idx"].cast("int").alias("item"), p["box_idx"].cast("int").alias("person"), i["cls"].cast("int").alias("cls"), more(i, p).alias("more"))

    return _near(F.filter(boxes, lambda x: x["cls"].isin(*G.REQUIRED)), _people(boxes), share, threshold, row)


def taken(ordered: Column, fields: list[str], clash: Callable[[Column, Column], Column]) -> Column:
    """Of an ordered array those that clash with none taken before, with these integer fields."""
    plain = lambda x: F.struct(*(x[f].alias(f) for f in fields))
    none = F.array().cast(f"array<struct<{','.join(f'{f}:int' for f in fields)}>>")
    return F.aggregate(ordered, none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(y, x)), acc).otherwise(F.concat(acc, F.array(plain(x)))))


def bound(ordered: Column) -> Column:
    """array<struct<person, cls, item>>: an item binds once, a person once per class."""
    return taken(ordered, ["person", "cls", "item"], lambda y, x: (y["item"] == x["item"]) | ((y["person"] == x["person"]) & (y["cls"] == x["cls"])))


def bindings(boxes: Column, threshold: float = G.CONTAINMENT) -> Column:
    return bound(candidates(boxes, threshold))


def overlapping(boxes: Column, workers: Column, threshold: float = G.MATCH_IOU, more: Callable[[Column], Column] = lambda p: F.lit(0)) -> Column:
    """Workers and the people they overlap, best overlap first, then by index."""

    def share(w: Column, p: Column) -> Column:
        return _once(_common(p, w), lambda both: F.when(p["area"] + w["area"] - both > 0, both / (p["area"] + w["area"] - both)).otherwise(0.0))

    def row(x: Column) -> Column:
        w, p = x["a"]["box"], x["b"]["box"]
        return F.struct((-x["share"]).alias("s"), w["worker"].cast("int").alias("worker"), p["box_idx"].cast("int").alias("person"), more(p).alias("more"))

    return _near(workers, _people(boxes), share, threshold, row)


def matched(ordered: Column) -> Column:
    """array<struct<worker, person>>: one to one."""
    return taken(ordered, ["worker", "person"], lambda y, x: (y["worker"] == x["worker"]) | (y["person"] == x["person"]))


def decided(workers: Column, bound_: Column, matched_: Column, fields: list[str]) -> Column:
    """array<struct<fields of the worker, person, wears_helmet, wears_vest>>: each labelled worker with the person that is matched with it
    (null: none) and what that person wears."""

    def told(w: Column, person: Column) -> Column:
        wears = lambda c: F.exists(bound_, lambda y: (y["person"] == person) & (y["cls"] == c))
        return F.struct(*(w[f].alias(f) for f in fields), person.alias("person"), wears(G.HELMET).alias("wears_helmet"), wears(G.VEST).alias("wears_vest"))

    own = lambda w: F.get(F.filter(matched_, lambda m: m["worker"] == w["worker"]), F.lit(0))["person"]
    return F.transform(workers, lambda w: _once(own(w), lambda person: told(w, person)))


def told(boxes: Column, workers: Column, bound_: Column, matched_: Column) -> Column:
    """array<struct<worker, person, wears_helmet, wears_vest>>: each labelled worker with the box of the person that is matched with it
    (null: none), and each person of nobody (worker null)."""

    def row(w: Column, p: Column) -> Column:
        wears = lambda c: F.coalesce(F.exists(bound_, lambda y: (y["person"] == p["box_idx"]) & (y["cls"] == c)), F.lit(False))
        return F.struct(w.alias("worker"), p.alias("person"), wears(G.HELMET).alias("wears_helmet"), wears(G.VEST).alias("wears_vest"))

    nobody = F.get(F.filter(workers, lambda w: F.lit(False)), F.lit(0))
    whose = lambda w: lambda p: F.exists(matched_, lambda m: (m["worker"] == w["worker"]) & (m["person"] == p["box_idx"]))
    alone = F.filter(_people(boxes), lambda p: ~F.exists(matched_, lambda m: m["person"] == p["box_idx"]))
    own = F.transform(workers, lambda w: _once(F.get(F.filter(boxes, whose(w)), F.lit(0)), lambda p: row(w, p)))
    return F.concat(own, F.transform(alone, lambda p: row(nobody, p)))


def gathered(rows: DataFrame, keys: list[str], names: dict[str, str], first: Column | None = None) -> DataFrame:
    """(keys, the values of names): one row per frame, with an array of what is not null in each column of names, in any order.

    They are gathered by a window, as rows that come in order of their frame, like those that a window numbered, are then not sorted again.
    first: what tells one row of each frame from its others; else it is found by numbering.
    """
    frame = W.partitionBy(*keys)
    held = rows.withColumn("_first", F.row_number().over(frame.orderBy(*keys)) == 1 if first is None else first)
    held = held.select(*keys, "_first", *(F.collect_list(c).over(frame).alias(n) for c, n in names.items()))
    return held.filter("_first").drop("_first")


def scenes(rows: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """(keys, boxes, workers): one row per frame of a table with a row for each box, for each labelled worker, or for both at once
    (box, worker: structs, null where there is none)."""
    return gathered(rows, keys, {"box": "boxes", "worker": "workers"}, first)


def judged(frames: DataFrame, inside: Callable[[Column, Column], Column], overlap: float = G.DUPLICATE, threshold: float = G.CONTAINMENT) -> DataFrame:
    """One row per person that is no duplicate: the frame's other columns, box_idx, track_id, worn and in_zone (by the feet)."""
    rest = [c for c in frames.columns if c != "boxes"]
    dropped = frames.withColumn("_dropped", duplicates(F.col("boxes"), overlap))
    kept = dropped.withColumn("boxes", F.filter("boxes", lambda x: (x["cls"] != G.PERSON) | ~F.array_contains("_dropped", x["box_idx"].cast("int"))))
    bound = kept.withColumn("_bound", bindings(F.col("boxes"), threshold))
    people = bound.select(*rest, "_bound", F.explode(_people(F.col("boxes"))).alias("_p"))
    worn = F.transform(F.filter("_bound", lambda y: y["person"] == F.col("_p.box_idx")), lambda y: y["cls"])
    x, y = G.feet(_box(F.col("_p")))
    return people.select(*rest, "_p.box_idx", "_p.track_id", F.array_sort(worn).alias("worn"), inside(x, y).alias("in_zone"))
