"""A log of violations that a stream writes exactly once.

Each micro-batch has a folder of its own, named by the batch's number, and is written over whatever an earlier
try of the same batch has left there. A stream that is restarted repeats only the batch that was not committed,
with the same rows, so every alert is in the log once. A folder counts once its write is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import LOG

SCHEMA = "fired_at string, frame long, track_id long, zone string, missing string, started_at string, dwell_seconds double, confidence double"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch of alerts with the columns of the log as CSV."""

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number:012d}"
        p, fs = _path(batch.sparkSession, folder)
        if fs.exists(p) or not batch.isEmpty():
            batch.select(*LOG).write.mode("overwrite").option("header", True).csv(folder)

    return write


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All alerts of complete batches, in the log's columns."""
    p, fs = _path(spark, f"{path}/batch=*/_SUCCESS")
    done = sorted(st.getPath().getParent().toString() for st in fs.globStatus(p) or [])
    if not done:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("header", True).csv(done)
