"""Training runs: the grid of cells, their states and checks, and the pace of a run's log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..sources.tables import scratch


def run_grid(spark, models: list[str], directions: list[str], seeds: list[int]) -> DataFrame:
    """(ordinal, seed, model, direction), seed-major."""
    n, m = len(models), len(directions)
    at = F.col("id").cast("int")
    pick = lambda values, i: F.get(F.array(*(F.lit(v) for v in values)), i)
    div = lambda a, b: F.floor(a / b).cast("int")
    return spark.range(len(seeds) * n * m).select(at.alias("ordinal"), pick(seeds, div(at, n * m)).alias("seed"), pick(models, div(at, m) % n).alias("model"), pick(directions, at % m).alias("direction"))


def run_state(has_summary: Column, has_checkpoint: Column) -> Column:
    return F.when(has_summary, "done").when(has_checkpoint, "resumable").otherwise("pending")


def stale(age_seconds: Column, per_epoch: Column, floor: float = 300.0) -> Column:
    return age_seconds >= F.greatest(3 * per_epoch, F.lit(floor))


def gates(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether all blocking checks passed, and which failed. checks: name, passed, blocking."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("passed") & F.col("blocking"), F.col("name"))))
    warn = F.array_sort(F.collect_list(F.when(~F.col("passed") & ~F.col("blocking"), F.col("name"))))
    return checks.groupBy(*(by or [])).agg(F.coalesce(F.bool_and(F.col("passed") | ~F.col("blocking")), F.lit(True)).alias("passed"), bad.alias("failed"), warn.alias("warnings"))


def same_protocol(configs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether all rows agree, null counting as a value."""
    one = lambda c: (F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) <= 1).alias(c)
    return configs.agg(*(one(c) for c in columns))


def deltas(log: DataFrame, by: list[str], order: str, stamp: str) -> DataFrame:
    """log with `delta`, the growth of a counter that starts again from zero after a reset."""
    before = F.coalesce(F.lag(stamp).over(W.partitionBy(*by).orderBy(order)), F.lit(0.0))
    return log.withColumn("delta", F.when(F.col(stamp) >= before, F.col(stamp) - before).otherwise(F.col(stamp)))


def pace(log: DataFrame, by: list[str], order: str, stamp: str, score: str, epochs: int = 200, patience: int = 50, last: int = 10) -> DataFrame:
    """Per run: epoch, best score and its epoch, epochs since, upper median of the positive ones of the last deltas, minutes left."""
    d = deltas(log, by, order, stamp).withColumn("_back", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order))))
    recent = F.array_sort(F.collect_list(F.when((F.col("_back") <= last) & (F.col("delta") > 0) & ~F.isnan("delta"), F.col("delta"))))
    best = F.max_by(F.struct(F.col(order).alias("at"), F.col(score).alias("value")), F.struct(F.col(score), -F.col(order)))
    out = d.groupBy(*by).agg(F.max(order).alias("epoch"), best.alias("b"), recent.alias("r"))
    out = out.withColumn("seconds_per_epoch", F.get("r", F.floor(F.size("r") / 2).cast("int"))).withColumn("since_best", F.col("epoch") - F.col("b.at"))
    left = F.least(F.lit(epochs) - F.col("epoch"), F.lit(patience) - F.col("since_best"))
    eta = F.when(left > 0, left * F.col("seconds_per_epoch") / 60).otherwise(0.0)
    return out.select(*by, "epoch", F.col("b.value").alias("best"), F.col("b.at").alias("best_epoch"), "since_best", "seconds_per_epoch", eta.alias("eta_min"))


def offsets(counts: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """counts with `start`, the sum of all before."""
    run = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("start", F.sum(n).over(run) - F.col(n))


def texts(value: Column, kind: DataType, exempt: tuple[str, ...] = (), at: str = "") -> Column:
    """array<string>: all texts in a value of this type, however deep in structs, arrays and maps. exempt: paths of fields
    (a.b) that are not looked into."""
    empty = F.array().cast("array<string>")
    if at in exempt:
        return empty
    if isinstance(kind, StringType):
        return F.array_compact(F.array(value))
    if isinstance(kind, StructType):
        found = [texts(value[f.name], f.dataType, exempt, f"{at}.{f.name}".lstrip(".")) for f in kind.fields]
        return F.coalesce(F.concat(*found), empty) if found else empty
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: texts(x, kind.elementType, exempt, at))), empty)
    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: texts(x, kind.valueType, exempt, at))), empty)
    return empty


def forbidden(values: Column, *markers: str) -> Column:
    """Whether any text of an array names a forbidden path: backslashes as slashes, in lower case, anywhere in it."""
    named = F.array(*(F.lit(m.lower()) for m in markers if m)).cast("array<string>")
    return F.exists(values, lambda v: F.exists(named, lambda m: F.contains(F.lower(F.replace(v, F.lit("\\"), F.lit("/"))), m)))


def guard(df: DataFrame, markers: list[str], exempt: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """df, raising where a text anywhere in a row names a forbidden path. exempt: fields that may declare one."""
    row = StructType([f for f in df.schema.fields if columns is None or f.name in columns])
    every = F.concat(F.array().cast("array<string>"), *(texts(F.col(f"`{f.name}`"), f.dataType, exempt, f.name) for f in row.fields))
    offending = F.filter(every, lambda v: forbidden(F.array(v), *markers))
    message = F.concat(F.lit("a forbidden path: "), F.array_join(offending, ", "))
    return df.filter(F.when(F.size(offending) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def newest(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest row of each group; older ones are dropped on purpose."""
    return frames.groupBy(*by).agg(F.max_by(F.struct(*frames.columns), order).alias("f")).select("f.*")


def first_usable(frames: DataFrame, by: list[str], order: str, brightness: str, most: int = 60, every: int = 3, enough: float = 40.0) -> DataFrame:
    """Of every third of the first frames the first that is bright enough, else the brightest."""
    seen = frames.filter((F.col(order) < most) & (F.col(order) % every == 0))
    rank = F.struct(F.col(brightness) >= enough, F.when(F.col(brightness) >= enough, -F.col(order).cast("double")).otherwise(F.col(brightness)), -F.col(order))
    return seen.groupBy(*by).agg(F.max_by(F.struct(F.col(order).alias("frame"), F.col(brightness).alias("brightness")), rank).alias("f")).select(*by, "f.*")


def due(runs: DataFrame, summaries: DataFrame, checkpoints: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs that are not done, with their state, those to resume first. Runs in a queue are independent: one that fails does not hold others up."""
    done, begun = summaries.select(key).distinct().withColumn("_s", F.lit(True)), checkpoints.select(key).distinct().withColumn("_c", F.lit(True))
    met = runs.join(done, key, "left").join(begun, key, "left")
    state = run_state(F.col("_s").isNotNull(), F.col("_c").isNotNull())
    return met.withColumn("state", state).drop("_s", "_c").filter("state <> 'done'").orderBy(F.desc("state"), key)


JOURNAL = "at long, {key}, event string, seconds double, error string"


def _journal(spark, path: str, key: str, kind: str) -> DataFrame:
    """All entries, those of several sessions; none where the journal does not exist yet."""
    schema = JOURNAL.format(key=f"`{key}` {kind}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_queue(runs: DataFrame, summaries: DataFrame, checkpoints: DataFrame, work: Callable[[Row, bool], object], key: str = "run_id", dry: bool = False, journal: str | None = None) -> DataFrame:
    """(key, outcome, seconds, error) of every run, each worked on once: skipped (done before), ok, failed, or dry-run.

    work gets a run's row and whether it is to resume. What it raises is that run's failure and goes no further, so the others
    have their turn. A run is a whole Spark or training job, so the queue is a loop on the driver, over the runs of a grid.

    journal: the path of a table that outlives the driver (without one, the queue is not to be resumed). That a run begins, and how it ended, is appended to it before the
    queue goes on. A queue that is started again with the same journal passes over runs that ended well, tries failed ones
    again, and resumes one that began and never ended. The outcomes are those of the journal, whichever session they are of.
    """
    spark, kind = runs.sparkSession, runs.schema[key].dataType.simpleString()
    journal = journal or scratch(spark, "journal")
    last = lambda: _journal(spark, journal, key, kind).groupBy(key).agg(F.max_by(F.struct("event", "seconds", "error"), "at").alias("e")).select(key, "e.*")

    def note(value, event: str, seconds: float = 0.0, error: str | None = None) -> None:
        entry = [(time.time_ns(), value, event, seconds, error)]
        spark.createDataFrame(entry, JOURNAL.format(key=f"`{key}` {kind}")).coalesce(1).write.mode("append").parquet(journal)

    ended = {r[key]: r.event for r in last().collect()}
    for row in due(runs, summaries, checkpoints, key).toLocalIterator():
        value = row[key]
        if ended.get(value) == "ok":
            continue
        if dry:
            note(value, "dry-run")
            continue
        note(value, "began")
        began = time.monotonic()
        try:
            work(row, row.state == "resumable" or ended.get(value) == "began")
            note(value, "ok", time.monotonic() - began)
        except Exception as e:  # one bad run must not cost the rest
            note(value, "failed", time.monotonic() - began, f"{type(e).__name__}: {e}"[:1000])
    told = runs.select(key).distinct().join(last(), key, "left")
    outcome = F.coalesce("event", F.lit("skipped")).alias("outcome")
    return told.select(key, outcome, F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "error")


def frame_policy(kind: Column, dwell: Column, memory: Column) -> Column:
    """struct(tracked, dwell, memory): stills have no identity over time, so they are not tracked, fire at once and remember nothing."""
    still = kind == "images"
    return F.struct((~still).alias("tracked"), F.when(still, 0.0).otherwise(dwell).alias("dwell"), F.when(still, 0.0).otherwise(memory).alias("memory"))


def rate(override: Column, declared: Column, usual: float = 25.0) -> Column:
    """Frames per second: what is asked for, else what the source declares if positive, else the usual."""
    return F.coalesce(override, F.when(declared > 0, declared), F.lit(usual))
