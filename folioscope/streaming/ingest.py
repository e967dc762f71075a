"""Books that newly land, taken in once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, landing: str, schema: str, done: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("book", "name"), late: tuple[str, str] | None = None) -> StreamingQuery:
    """Process what is new in ``landing`` (parquet) and add it to ``done``; rows whose keys were seen before are dropped.

    Which keys were seen is the stream's state, kept with the checkpoint and dealt
    out by key, so neither a batch nor a restart reads ``done`` again.  A state of all
    keys grows with them (a RocksDB state store keeps it on disk); with ``late``, a
    time column and a delay, keys are forgotten when the watermark has passed them.
    The sink's log tells which files of ``done`` count, so a batch that is run again
    adds nothing twice; ``process`` sees a streaming DataFrame.  Runs over all that is available, then stops.
    """
    source = spark.readStream.schema(schema).parquet(landing)
    fresh = source.withWatermark(*late).dropDuplicatesWithinWatermark([*keys]) if late else source.dropDuplicates([*keys])
    return process(fresh).writeStream.format("parquet").option("path", done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
