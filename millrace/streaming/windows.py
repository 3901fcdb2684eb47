"""Event-time windows over files that arrive out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches that :func:`feed` writes at most.
MOST_BATCHES = 1000


def window_aggregates(
    spark: SparkSession, source: str, schema: str, time: str, delay: str, size: str, keys: list[str], aggregates: list[Column], sink: str, checkpoint: str, sessions: bool = False, files_per_batch: int | None = 1,
) -> int:
    """Aggregate the files not seen before by window and keys, append what is final to ``sink`` (Parquet), and stop; returns how many rows came too late (those of one window and key in one task count once).

    Windows are tumbling ones of ``size``, or sessions of one key that end when nothing has come for ``size``. A window is final, and
    is written once, when its end is not after the watermark: the latest time seen, less ``delay``. Open windows stay in the state that the
    checkpoint keeps; they are neither lost nor written twice by a restart, and later files may still complete them. Rows whose window was closed by the
    watermark that a batch before the last one has set are dropped and counted; none within ``delay`` of the latest is. A batch has ``files_per_batch``
    files, or with None all that are there: what arrives together then has one watermark, and the number of batches is that of the arrivals, however many files each has. Rows without a time belong to no window. A null key is a key.

    State is one row per open window and key, so it is bounded by ``delay`` and the number of keys, not by the length of the stream.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source)
    stream = stream.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, delay)
    window = (F.session_window if sessions else F.window)(time, size).alias("window")
    out = stream.groupBy(window, *keys).agg(*aggregates)
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    out = out.select(*bounds, *[c for c in out.columns if c != "window"])
    query = out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def first_arrivals(spark: SparkSession, source: str, schema: str, key: str, time: str, delay: str, sink: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Redundancy removal over arrivals: a row goes on unless its key was seen within ``delay`` before it.

    The state holds a key until the watermark (the latest time seen, less ``delay``) has passed its first time by ``delay`` and a batch has ended since, so it does not grow with the
    stream; a key that comes back after that is new, and one that comes back in between may still count as seen. Rows without a key all go on, rows without a time are dropped. The checkpoint carries the state over a restart.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream = stream.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull())
    # Each row without a key is its own; the number only has to differ within a batch and its neighbours.
    own = F.when(F.col(key).isNull(), F.concat(F.lit("row "), F.uuid())).otherwise(F.concat(F.lit("key "), F.col(key).cast("string"))).alias("__own")
    marked = stream.select("*", own).withWatermark(time, delay)
    kept = marked.dropDuplicatesWithinWatermark(["__own"]).drop("__own")
    query = kept.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feed(df: DataFrame, batch: str, path: str, arrived: Callable[[], object] = lambda: None) -> None:
    """Write a table as files that arrive one batch after another, by the numbers in a column (which is left out); a null number comes first. ``arrived`` is called after each. More than MOST_BATCHES are an error."""
    numbers = sorted((r[0] for r in df.select(batch).distinct().limit(MOST_BATCHES + 1).collect()), key=lambda b: (b is not None, b or 0))
    if len(numbers) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches")
    for number in numbers:
        df.filter(F.col(batch).eqNullSafe(F.lit(number))).drop(batch).write.mode("append").parquet(path)
        arrived()
