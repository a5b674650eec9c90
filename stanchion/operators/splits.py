"""Reproducible splits: shuffles are orders of a hash of seed and key, so they hold on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 0):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def strata(images: DataFrame, boxes: DataFrame, by: str = "image_id") -> DataFrame:
    """images with `stratum`: their distinct classes in order joined by '-', or 'background'."""
    own = boxes.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("cls")).cast("array<string>"), "-").alias("stratum"))
    return images.join(own, by, "left").withColumn("stratum", F.coalesce("stratum", F.lit("background")))


def hash_places(items: DataFrame, hash_: Column, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """items with `_place`, from 0 in the order of a hexadecimal hash (and ties) inside each group, and `_n`, the group's size.
    Ranks are numbered inside slices of the hash and shifted by the sizes of the slices before, so no group is sorted in one task."""
    by = by or []
    marked = items.withColumn("_h", hash_).withColumn("_slice", F.substring("_h", 1, 3))
    sizes = marked.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # over the 4096 slices of a group
    sizes = sizes.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(whole.orderBy("_slice")) - F.col("_c")).drop("_c")
    own = marked.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_h", *ties)))
    x, y = own.alias("x"), sizes.alias("y")
    on = F.col("x._slice") == F.col("y._slice")
    for c in by:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    met = x.join(y, on)
    return met.select(*(F.col(f"x.{c}") for c in items.columns), (F.col("_before") + F.col("_own") - 1).alias("_place"), F.col("_n"))


def stratified(items: DataFrame, share: float, key: str, stratum: str = "stratum", seed: int = 0) -> DataFrame:
    """items with `side`: of each stratum the first bround(n * share) in hash order are 'minority', the others 'majority'."""
    marked = hash_places(items, hash_order(key, seed), [key], [stratum])
    return marked.withColumn("side", F.when(F.col("_place") < F.bround(F.col("_n") * share), "minority").otherwise("majority")).drop("_place", "_n")


def sample(items: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n items, always the same ones."""
    return items.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def split_ids(splits: DataFrame, by: list[str], key: str) -> DataFrame:
    """A content hash of each split: 12 digits of the SHA-1 of its sorted keys, one per line. A split's keys are held in one
    row, as its identity is that of its sorted text: a split's keys must be under 2 GB as text."""
    joined = F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n")
    return splits.groupBy(*by).agg(F.count("*").alias("n"), F.substring(F.sha1(joined.cast("binary")), 1, 12).alias("id"))


def truncate_train(splits: DataFrame, n: int, key: str, split: str = "split") -> DataFrame:
    """The first n training keys in order; other splits as they are."""
    train = splits.filter(F.col(split) == "train").orderBy(key).limit(n)
    return train.unionByName(splits.filter(F.col(split) != "train"))


def overlaps(splits: DataFrame, split: str = "split", key: str = "stem") -> DataFrame:
    """(a, b, n) of each two splits that share keys."""
    own = splits.select(F.col(split).alias("s"), F.col(key).alias("k")).distinct()
    met = own.alias("x").join(own.alias("y"), "k").filter("x.s < y.s")
    return met.groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.count("*").alias("n"))


def same_list(a: DataFrame, b: DataFrame, order: str, key: str) -> bool:
    """Whether two lists hold the same keys at the same places."""
    x, y = (d.select(F.col(order).alias("_i"), F.col(key).alias("_k")) for d in (a, b))
    return x.join(y, "_i", "full_outer").filter(~x["_k"].eqNullSafe(y["_k"])).isEmpty()


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each of two tables has that the other lacks, as often as it has them more."""
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return only(a, b, "only_first").crossJoin(F.broadcast(only(b, a, "only_second")))  # one row each


def list_differences(a: DataFrame, b: DataFrame, order: str, key: str) -> DataFrame:
    """One row: at how many places two lists differ, and how many places only one of them has."""
    x, y = (d.select(F.col(order).alias("_i"), F.col(key).alias("_k"), F.lit(True).alias("_in")) for d in (a, b))
    met = x.join(y, x["_i"] == y["_i"], "full_outer")
    both = x["_in"].isNotNull() & y["_in"].isNotNull()
    return met.agg(F.count_if(both & ~x["_k"].eqNullSafe(y["_k"])).alias("differing"), F.count_if(y["_in"].isNull()).alias("only_first"), F.count_if(x["_in"].isNull()).alias("only_second"))


def presence(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Which side each key is on: both, images or labels."""
    a, b = images.select(key).distinct().withColumn("_a", F.lit(True)), labels.select(key).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a").isNull(), "labels").when(F.col("_b").isNull(), "images").otherwise("both")
    return a.join(b, key, "full_outer").select(key, where.alias("side"))
