"""Debounced alerts and short-term memory, over rows with integer microseconds.

An incident of a track goes on while its violating rows are at most `grace` apart; it fires once,
at the first row `dwell` or more after its start. With rows in time order this is a window: a row
opens an incident if there is no earlier row or the gap is larger than grace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Default dwell, grace and memory in seconds.
DWELL, GRACE, MEMORY = 3.0, 2.0, 1.0


def micros(seconds: float) -> int:
    return round(seconds * SECOND)


def incidents(violating: DataFrame, grace: int, keys: list[str] | None = None, ts: str = "ts_us", closes: str | None = None) -> DataFrame:
    """violating with `incident`, the number of the incident inside its track.

    closes names a boolean column of rows that are no violation but end an open incident at once; they are not returned.
    Rows without a track (a null key) belong to no incident and are left out.
    """
    keys = keys or ["track_id"]
    violating = violating.dropna(subset=keys)
    run = W.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(run)
    opens = before.isNull() | (F.col(ts) - before > grace)
    if closes:
        opens = ~F.col(closes) & (opens | F.lag(closes).over(run))
    marked = violating.withColumn("_opens", opens.cast("int")).withColumn("incident", F.sum("_opens").over(run)).drop("_opens")
    return marked.filter(~F.col(closes)) if closes else marked


def alerts(violating: DataFrame, dwell: int, grace: int, keys: list[str] | None = None, ts: str = "ts_us", missing: str = "missing") -> DataFrame:
    """One row per incident that fires: started_us, fired_us, missing at firing."""
    keys = keys or ["track_id"]
    marked = incidents(violating, grace, keys, ts)
    start = F.min(ts).over(W.partitionBy(*keys, "incident"))
    due = marked.withColumn("started_us", start).filter(F.col(ts) - F.col("started_us") >= dwell)
    first = F.min_by(F.struct(F.col(ts).alias("fired_us"), F.col(missing).alias("missing")), ts)
    return due.groupBy(*keys, "incident").agg(F.min("started_us").alias("started_us"), first.alias("f")).select(*keys, "incident", "started_us", "f.fired_us", "f.missing")


def islands(violating: DataFrame, grace: int, keys: list[str] | None = None, ts: str = "ts_us", closes: str | None = None) -> DataFrame:
    """One row per incident: its first and last row, and how many there are."""
    keys = keys or ["track_id"]
    return incidents(violating, grace, keys, ts, closes).groupBy(*keys, "incident").agg(F.min(ts).alias("started_us"), F.max(ts).alias("ended_us"), F.count("*").alias("n"))


def remembered(observed: DataFrame, required: list[int], memory: int, keys: list[str] | None = None, ts: str = "ts_us", worn: str = "worn") -> DataFrame:
    """observed with `missing`: required classes last seen on the track more than `memory` ago, or never. A row's own sight
    counts; a row without a track (a null key) has no other."""
    keys = keys or ["track_id"]
    run = W.partitionBy(*keys).orderBy(ts).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = observed
    for c in required:
        own = F.when(F.array_contains(worn, c), F.col(ts))
        untracked = F.lit(False)
        for k in keys:
            untracked = untracked | F.col(k).isNull()
        seen = F.when(untracked, own).otherwise(F.last(own, ignorenulls=True).over(run))
        out = out.withColumn(f"_seen_{c}", seen)
    lacks = [F.when(F.col(f"_seen_{c}").isNull() | (F.col(ts) - F.col(f"_seen_{c}") > memory), F.lit(c)) for c in required]
    return out.withColumn("missing", F.array_compact(F.array(*lacks))).drop(*(f"_seen_{c}" for c in required))
