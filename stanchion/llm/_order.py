"""Places in a global order, without any task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import drop, keep

_ROW_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in so many bits


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df, kept in the shared folder, with each row's place (long, from 0) in the order.

    Rows are dealt out by ranges of the order and sorted there; only the number of rows of each partition meets on the
    driver, so it grows with the partitions, not with the rows. Rows that tie in all of `order` come in any order.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    held = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, at), "ordered")
    part = F.shiftright(F.col(name), _ROW_BITS).cast("int")
    before, total = [], 0
    for r in sorted(held.groupBy(part.alias("p")).count().collect()):
        before.append((r["p"], total - (r["p"] << _ROW_BITS)))
        total += r["count"]
    if not before:
        return held
    shift = spark.createDataFrame(before, "_part int, _shift long")
    out = held.join(F.broadcast(shift), part == F.col("_part"))
    return out.withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")


def kept_numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """numbered(), written once more, with the table in between deleted."""
    ranked = numbered(df, order, name)
    out = keep(ranked, "numbered")
    drop(ranked)
    return out
