"""Queries that run a finite stream over the tracked events, and what it leaves: alerts, counts, a log, and its state.

Each call streams into new folders under spark.checkpoint.dir, which stay. A row of a track that no one has, far ahead
in time, ends the stream: the watermark then passes all others.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.tables import scratch
from ..streaming import alerts as A
from ..streaming.log import log_writer, read_log
from . import carriers as C
from .events import _ISLANDS, HOUR
from .registry import ORACLES, query

DWELL, GRACE, END = 24 * HOUR, 36 * HOUR, -1
#: An end in the year 2200, and a lateness that reaches from it back over all events.
FAR_US, LATE = 7_258_118_400_000_000, "36500 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state of several variables needs this provider; a session that build_session() made has it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _observed(spark: SparkSession, d: str, end_us=FAR_US, **more) -> DataFrame:
    """The events as a stream of observations, from files whose rows are in no order of time."""
    rows = C.tracks(spark, d).select("track_id", "ts_us", F.col("violating").alias("in_zone"))
    rows = rows.unionByName(spark.range(1).select(F.lit(END).cast(rows.schema["track_id"].dataType).alias("track_id"), F.lit(end_us).cast("long").alias("ts_us"), F.lit(False).alias("in_zone")))
    rows = rows.withColumns({"ts": F.timestamp_micros("ts_us"), "worn": F.array().cast("array<int>")})
    path = scratch(spark, "observed")
    rows.write.parquet(path)
    return A.frames(spark, path, rows.schema)


def _finish(spark: SparkSession, writer, name: str) -> str:
    """Runs a stream to its end; the path of its checkpoint."""
    checkpoint = scratch(spark, f"{name}-checkpoint")
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return checkpoint


def _written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = scratch(spark, name)
    _finish(spark, stream.writeStream.format("parquet").option("path", out).outputMode("append"), name)
    return spark.read.schema(stream.schema).parquet(out)


@query(ORACLES["dwell_alerts"].replace("track_id, incident, started_us", "track_id, started_us"))
def stream_alerts(spark, d):
    """Dwell alerts by keyed state, of rows that wait for the watermark: those of the batch operators."""
    with _rocks(spark):
        found = _written(spark, A.alert_stream(_observed(spark, d), DWELL, GRACE, 0, late=LATE), "alerts")
    return found.withColumn("missing", N.join_classes(F.col("missing")))


_FIRED = ORACLES["dwell_alerts"]


@query(f"""WITH fired AS ({_FIRED}) SELECT 'yard' AS zone, count(*) AS frames, count(*) AS people, (SELECT count(*) FROM fired) AS alerts, count(*) FILTER (WHERE violating AND event_id % 5 = 0) AS untracked
FROM ({C.duck(C.TRACKS)})""")
def stream_counters(spark, d):
    """Exact running counts beside the alerts, in one query of two stateful operators."""
    events = C.tracks(spark, d).select(F.lit("yard").alias("zone"), F.col("event_id").alias("frame"), F.lit(1).alias("people"), (F.col("violating") & (F.col("event_id") % 5 == 0)).cast("int").alias("untracked"))
    path = scratch(spark, "frames")
    events.write.parquet(path)
    with _rocks(spark):
        alerts = A.alert_stream(_observed(spark, d), DWELL, GRACE, 0, late=LATE).withColumn("zone", F.lit("yard"))
        counts = _written(spark, A.counted(A.frames(spark, path, events.schema), alerts), "counts")
    return A.totals(counts)


@query(f"""WITH {_ISLANDS}, e AS (SELECT track_id, incident, min(ts_us) AS started_us, max(ts_us) AS last_us FROM i GROUP BY 1, 2)
SELECT track_id, started_us, last_us, last_us - started_us >= {DWELL} AS fired, 'helmet+vest' AS missing FROM e WHERE last_us >= (SELECT max(ts_us) FROM ({C.duck(C.TRACKS)})) - {GRACE}""")
def stream_status(spark, d):
    """Which incidents are open when the stream stands at the last event, from its state."""
    last = C.tracks(spark, d).agg(F.max("ts_us")).first()[0] or 0
    with _rocks(spark):
        stream = A.alert_stream(_observed(spark, d, -(-last // 1000) * 1000), DWELL, GRACE, 0, late="0 seconds")
        checkpoint = _finish(spark, stream.writeStream.format("noop").outputMode("append"), "status")
        found = A.open_incidents(spark, checkpoint, GRACE, last)
    return found.withColumn("missing", N.join_classes(F.col("missing")))


@query(f"SELECT track_id, started_us AS started_at, fired_us AS fired_at, missing, round((fired_us - started_us) / 1e6::DOUBLE, 3) AS dwell_seconds FROM ({_FIRED})")
def stream_log(spark, d):
    """The stream's log of violations, by its exactly-once writer."""
    path = scratch(spark, "log")
    with _rocks(spark):
        a = A.alert_stream(_observed(spark, d), DWELL, GRACE, 0, late=LATE).withColumn("missing", N.join_classes(F.col("missing")))
        seconds = F.round((F.col("fired_us") - F.col("started_us")) / 1e6, 3)
        log = a.select(F.col("fired_us").cast("string").alias("fired_at"), F.lit(0).cast("long").alias("frame"), "track_id", F.lit("yard").alias("zone"), "missing", F.col("started_us").cast("string").alias("started_at"), seconds.alias("dwell_seconds"), F.lit(1.0).alias("confidence"))
        _finish(spark, log.writeStream.foreachBatch(log_writer(path)).outputMode("append"), "log")
    return read_log(spark, path).select("track_id", F.col("started_at").cast("long").alias("started_at"), F.col("fired_at").cast("long").alias("fired_at"), "missing", "dwell_seconds")
