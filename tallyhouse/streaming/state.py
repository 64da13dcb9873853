"""Where streams keep their state."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BY_KEY = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_by_key(spark: SparkSession) -> None:
    """Keep state on disk, entry by entry, which collections in state need. Streams that start in this session from now
    on use it, whatever store the session had."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, BY_KEY)
