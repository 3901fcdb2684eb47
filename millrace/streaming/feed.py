"""Curate files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def curate_available(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Run a stateless step (identify, verify, exclude, annotate, predict) over files not seen before, and stop.

    The checkpoint remembers what was read; a restart after a failure neither
    loses nor repeats files. The other side of a join may be a static table.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = step(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
