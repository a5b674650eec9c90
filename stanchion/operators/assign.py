"""Association inside an image: one equi join on the image with a condition on the boxes, then one ordered fold per image.

Greedy assignment takes candidates in one total order and skips those whose ends are taken.
That is a fold over the sorted candidates of one image; most images are small (tens of boxes), so
the fold runs over an array inside generated code, after the only shuffle, on the image.

Images of more than CROWD boxes go another way to the same rows. Boxes meet by cells of a grid instead of all with all
(meet), and the assignment runs as joins, in rounds: a pair that comes first at both of its ends is what the fold would
take, whatever else happens; it is taken, its rivals go, and the rest is looked at again. A crowded image is then many
tasks, and no array holds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.tables import kept
from . import frames

FIELDS = ("xc", "yc", "w", "h")
#: Boxes of an image beyond which it is not one fold; and the finest grid, of 2^LEVELS cells a side.
CROWD, LEVELS = 1000, 12


def _side(boxes: DataFrame, keys: list[str], prefix: str, more: list[str]) -> DataFrame:
    return boxes.select(*keys, *(F.col(c).alias(prefix + c) for c in (*FIELDS, *more)))


def crowded(frames: list[DataFrame], keys: list[str], crowd: int | None = None) -> DataFrame | None:
    """Keys of images with more boxes than CROWD in all frames together; None if there are none."""
    every = reduce(DataFrame.unionByName, (f.select(*keys) for f in frames))
    found = every.groupBy(*keys).count().filter(F.col("count") > (crowd or CROWD)).select(*keys)
    return None if found.isEmpty() else found


def meet(inner: DataFrame, outer: DataFrame, keys: list[str], i: str, o: str, crowd: DataFrame | None = None) -> DataFrame:
    """Pairs of an image's inner and outer boxes (with columns prefixed i and o) that may have half of the inner's width and height
    in common: all of a small image; of a crowded one those where the inner's centre can be in the outer.

    An outer box is put on the grid whose cells are just larger than it, where it touches four cells at most, and an inner
    one's centre is looked up on all grids.
    """
    if crowd is None:
        return inner.join(outer, keys)
    few = inner.join(crowd, keys, "left_anti").join(outer, keys)
    x1, y1, x2, y2 = G.corners(G.box(o))
    pad = 1e-9  # a centre may be on the very edge
    size = F.greatest(F.col(f"{o}w"), F.col(f"{o}h"), F.lit(2.0**-LEVELS))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2(size)).cast("int")))
    cell = lambda v, at: F.floor(v * F.pow(F.lit(2.0), at)).cast("long")
    span = lambda a, b: F.explode(F.sequence(cell(a - pad, F.col("_level")), cell(b + pad, F.col("_level"))))
    outside = outer.join(crowd, keys, "left_semi").withColumn("_level", level).withColumn("_x", span(x1, x2)).withColumn("_y", span(y1, y2))
    here = inner.join(crowd, keys, "left_semi").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    here = here.withColumn("_x", cell(F.col(f"{i}xc"), F.col("_level"))).withColumn("_y", cell(F.col(f"{i}yc"), F.col("_level")))
    many = here.join(outside, [*keys, "_level", "_x", "_y"]).drop("_level", "_x", "_y")
    return few.unionByName(many)


def candidates(boxes: DataFrame, keys: list[str] | None = None, threshold: float | Column = G.CONTAINMENT, crowd: DataFrame | None = None) -> DataFrame:
    """(keys, item, person, cls, score, dist) of every item and person of an image with containment of the threshold or more.

    crowd: the images to go by cells, if the threshold is half or more.
    """
    keys = keys or ["image_id"]
    people = _side(boxes.filter(F.col("cls") == G.PERSON), keys, "p_", ["box_idx"])
    items = _side(boxes.filter(F.col("cls").isin(*G.REQUIRED)), keys, "i_", ["box_idx", "cls"])
    by_cell = crowd if isinstance(threshold, float) and threshold >= 0.5 else None
    met = meet(items, people, keys, "i_", "p_", by_cell)
    item, person = G.box("i_"), G.box("p_")
    met = met.withColumn("score", G.containment(item, person)).filter(F.col("score") >= threshold)
    return met.select(*keys, F.col("i_box_idx").alias("item"), F.col("p_box_idx").alias("person"), F.col("i_cls").alias("cls"), "score", G.anchor_distance(item, F.col("i_cls"), person).alias("dist"))


def greedy(pairs: DataFrame, keys: list[str], order: list[Column], once: list[list[str]], keep: list[str], crowd: DataFrame | None = None) -> DataFrame:
    """Of each group of keys the pairs taken in order, skipping a pair that agrees with a taken one in all columns of any list in
    `once`. order: a total one inside the group. crowd: groups that are worked on in rounds."""
    names = list(dict.fromkeys(keep + [c for group in once for c in group]))
    if crowd is not None:
        few = greedy(pairs.join(crowd, keys, "left_anti"), keys, order, once, keep)
        return few.unionByName(_in_rounds(pairs.join(crowd, keys, "left_semi"), keys, order, once, names).select(*keys, *keep))
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *(F.col(c) for c in names))
    sorted_ = F.array_sort(F.collect_list(row))
    grouped = pairs.groupBy(*keys).agg(sorted_.alias("_all"))
    empty = F.filter(F.col("_all"), lambda x: F.lit(False))

    def clash(x: Column, y: Column) -> Column:
        tests = [None] * len(once)
        for i, group in enumerate(once):
            t = F.lit(True)
            for c in group:
                t = t & (x[c] == y[c])
            tests[i] = t
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    taken = F.aggregate("_all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.explode(taken).alias("_t")).select(*keys, *(F.col(f"_t.{c}").alias(c) for c in keep))


def _in_rounds(pairs: DataFrame, keys: list[str], order: list[Column], once: list[list[str]], names: list[str]) -> DataFrame:
    """(keys, names) of what greedy() takes, by rounds of pairs that come first at all of their ends."""
    left = kept(pairs.select(*keys, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), *names), "pairs")
    taken = []
    while not left.isEmpty():
        firsts = [left.groupBy(*keys, *group).agg(F.min(F.struct("_o", *names)).alias("_m")).select(*keys, "_m") for group in once]
        won = reduce(lambda a, b: a.join(b, [*keys, "_m"]), firsts).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in names))
        won = kept(won, "taken")
        taken.append(won)
        for group in once:
            left = left.join(won.select(*keys, *group), [*keys, *group], "left_anti")
        left = kept(left, "pairs")
    return reduce(DataFrame.unionByName, taken) if taken else pairs.select(*keys, *names).limit(0)


def bind(boxes: DataFrame, keys: list[str] | None = None, threshold: float | Column = G.CONTAINMENT) -> DataFrame:
    """(keys, person, cls, item): items bound to persons, strongest containment first, ties to the nearer anchor, then
    by index; an item binds once, a person once per class."""
    keys = keys or ["image_id"]
    order = [-F.col("score"), F.col("dist"), F.col("item"), F.col("person")]
    crowd = crowded([boxes], keys)
    return greedy(candidates(boxes, keys, threshold, crowd), keys, order, [["item"], ["person", "cls"]], ["person", "cls", "item"], crowd)


def people_states(boxes: DataFrame, bound: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per person: helmet, vest (item index or null), wears_helmet, wears_vest, code."""
    keys = keys or ["image_id"]
    per = bound.groupBy(*keys, "person").agg(F.max(F.when(F.col("cls") == G.HELMET, F.col("item"))).alias("helmet"), F.max(F.when(F.col("cls") == G.VEST, F.col("item"))).alias("vest"))
    people = boxes.filter(F.col("cls") == G.PERSON).withColumnRenamed("box_idx", "person")
    met = people.join(per, [*keys, "person"], "left")
    met = met.withColumn("wears_helmet", F.col("helmet").isNotNull()).withColumn("wears_vest", F.col("vest").isNotNull())
    return met.withColumn("code", G.state_code(F.col("wears_helmet"), F.col("wears_vest")))


def unbound(boxes: DataFrame, bound: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items that nobody wears."""
    keys = keys or ["image_id"]
    items = boxes.filter(F.col("cls").isin(*G.REQUIRED)).withColumnRenamed("box_idx", "item")
    return items.join(bound.select(*keys, "item"), [*keys, "item"], "left_anti")


def match_people(people: DataFrame, workers: DataFrame, keys: list[str] | None = None, threshold: float = G.MATCH_IOU) -> DataFrame:
    """(keys, worker, person): labelled workers and detected people paired one to one, best overlap first.

    people: keys, person and box columns; workers: keys, worker and box columns.
    """
    keys = keys or ["image_id"]
    crowd = crowded([people, workers], keys)
    by_cell = crowd if threshold >= 0.5 else None
    met = meet(_side(workers, keys, "w_", ["worker"]), _side(people, keys, "p_", ["person"]), keys, "w_", "p_", by_cell)
    met = met.withColumn("score", G.iou(G.box("p_"), G.box("w_"))).filter(F.col("score") >= threshold)
    pairs = met.select(*keys, F.col("w_worker").alias("worker"), F.col("p_person").alias("person"), "score")
    return greedy(pairs, keys, [-F.col("score"), F.col("worker"), F.col("person")], [["worker"], ["person"]], ["worker", "person"], crowd)


def duplicate_people(boxes: DataFrame, keys: list[str] | None = None, overlap: float = G.DUPLICATE) -> DataFrame:
    """(keys, box_idx) of people to drop: contained in a larger person that is itself not dropped by then, in index order."""
    keys = keys or ["image_id"]
    people = boxes.filter(F.col("cls") == G.PERSON)
    crowd = crowded([people], keys)
    met = meet(_side(people, keys, "a_", ["box_idx"]), _side(people, keys, "b_", ["box_idx"]), keys, "a_", "b_", crowd if overlap >= 0.5 else None)
    a, b = G.box("a_"), G.box("b_")
    met = met.filter((F.col("a_box_idx") != F.col("b_box_idx")) & (G.area(b) > G.area(a)) & (G.containment(a, b) >= overlap))
    pairs = met.select(*keys, F.col("a_box_idx").alias("small"), F.col("b_box_idx").alias("large"))
    if crowd is None:
        return _dropped(pairs, keys)
    return _dropped(pairs.join(crowd, keys, "left_anti"), keys).unionByName(_dropped_in_rounds(pairs.join(crowd, keys, "left_semi"), keys))


def _dropped(pairs: DataFrame, keys: list[str]) -> DataFrame:
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("small", "large"))).alias("_all"))
    empty = F.transform(F.filter(F.col("_all"), lambda x: F.lit(False)), lambda x: x.small)
    held = lambda acc, x: F.array_contains(acc, x.small) | F.array_contains(acc, x.large)
    dropped = F.aggregate("_all", empty, lambda acc, x: F.when(held(acc, x), acc).otherwise(F.concat(acc, F.array(x.small))))
    return grouped.select(*keys, F.explode(dropped).alias("box_idx"))


def _dropped_in_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same as joins. A person inside a larger one of higher index goes, as that one is not dropped by then; of those of
    lower index, it goes as soon as one is known to stay, and stays when all are known to go."""
    small, large = [*keys, "small"], F.col("large")
    pairs = kept(pairs, "pairs")
    gone = kept(pairs.filter(large > F.col("small")).select(*small).distinct(), "dropped")
    dropped = [gone]
    # whose turn is open: pairs with a larger one of lower index, of people that are not gone yet
    left = kept(pairs.filter(large < F.col("small")).join(gone, small, "left_anti"), "open")
    while True:
        left = kept(left.join(gone.select(*keys, F.col("small").alias("large")), [*keys, "large"], "left_anti"), "open")
        if left.isEmpty():
            break
        waiting = left.select(*small).distinct()
        sure = left.join(waiting.select(*keys, F.col("small").alias("large")), [*keys, "large"], "left_anti")
        gone = kept(sure.select(*small).distinct(), "dropped")
        dropped.append(gone)
        left = left.join(gone, small, "left_anti")
    return reduce(DataFrame.unionByName, dropped).select(*keys, F.col("small").alias("box_idx"))


def suppress_duplicates(boxes: DataFrame, keys: list[str] | None = None, overlap: float = G.DUPLICATE) -> DataFrame:
    """Boxes without the duplicate people; items stay."""
    keys = keys or ["image_id"]
    return boxes.join(duplicate_people(boxes, keys, overlap), [*keys, "box_idx"], "left_anti")


def nearest_object(rows: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's object with the least squared distance in centre and size; the first of equals.

    rows: keys, row_idx, cls, box; objects: keys, obj_idx, name, box.
    """
    row, object_ = F.struct("row_idx", "cls", *FIELDS).alias("row"), F.struct("obj_idx", "name", *FIELDS).alias("object")
    return nearest_in(rows.select(*keys, row).unionByName(objects.select(*keys, object_), allowMissingColumns=True), keys)


def nearest_in(both: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """nearest_object() of one table with a row for each row, for each object, or for both at once (row, object: structs, null where there is none).

    An image is one row, in which each row looks for its object; crowded images go by a join instead, to the same rows.
    """
    crowd = crowded([both], keys)
    few = both if crowd is None else both.join(crowd, keys, "left_anti")
    seen = frames.gathered(few, keys, {"row": "rows", "object": "objects"}, first).filter(F.size("objects") > 0)
    far = lambda r: lambda o: F.struct(_away(r, o).alias("far"), o["obj_idx"].alias("obj_idx"), o["name"].alias("name"))
    best = F.transform("rows", lambda r: F.struct(r["row_idx"].alias("row_idx"), r["cls"].alias("cls"), F.array_min(F.transform("objects", far(r))).alias("o")))
    out = seen.select(*keys, F.inline(best)).select(*keys, "row_idx", "cls", "o.name", "o.obj_idx")
    if crowd is None:
        return out
    many = both.join(crowd, keys, "left_semi")
    met = many.filter("row IS NOT NULL").select(*keys, "row").join(many.filter("object IS NOT NULL").select(*keys, "object"), keys)
    nearest = F.min_by("object", F.struct(_away(F.col("row"), F.col("object")).alias("far"), F.col("object.obj_idx").alias("i")))
    return out.unionByName(met.groupBy(*keys, "row.row_idx", "row.cls").agg(nearest.alias("o")).select(*keys, "row_idx", "cls", "o.name", "o.obj_idx"))


def _away(a: Column, b: Column) -> Column:
    gaps = [b[c] - a[c] for c in FIELDS]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] + gaps[3] * gaps[3]
