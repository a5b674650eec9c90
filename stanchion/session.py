"""Session settings the engine is built for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stanchion", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and RocksDB state for the streaming operators.

    Shuffle partitions are left to adaptive coalescing from a high start, so that one setting
    serves small and large inputs; give `spark__sql__shuffle__partitions="8"` for local tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # joins on (image, box) reuse a partitioning by image; images are small, so this does not pile up
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
