"""Intermediate tables in the folder that the cluster shares, and Arrow columns as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import new_path

# Workers give freed batches back to the system, so one that waits for its next task holds little.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of a megabyte or more are mapped by themselves, now and later


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of 8 MB at most: the default of 10,000 rows holds 64 MB of texts several times over, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


#: Tables written by :func:`keep` in this process, for :func:`release`.
_kept: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: work done once, lineage cut, lost executors survived."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_so_far() -> int:
    return len(_kept)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables kept after the first ``since``, once what was made of them is written."""
    for path in _kept[since:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _kept[since:]


def _number(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_metadata.file_path", "_metadata.row_index")


def identified(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns (one is ``key``), and ``tie``, a number that tells the rows that share a key apart: every row is one of its own.

    The number is a hash of the row's place in its file, so no text is read for it and each scan gives the same; it is
    tested, and made anew while any two rows agree in key and number. Rows that come from no file, or from a
    place several times, are written to one first. ``df`` must give the same rows each time.
    """
    if "_metadata" not in df.columns:
        try:
            for seed in range(3):
                rows = df.select(*[c.alias(n) for n, c in columns.items()], _number(seed).alias("tie"))
                if rows.groupBy("key", "tie").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
                    return rows
        except AnalysisException:
            pass
    return identified(keep(df.select(*[c.alias(n) for n, c in columns.items()]), "rows"), **{n: F.col(n) for n in columns})


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, and n + 1 offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``limit`` bytes of text at most (a longer text comes alone)."""
    data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def hash_sample(df: DataFrame, on: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the least hash of a column; the choice does not depend on row order.

    A threshold from the row count goes first, so tasks send on little more than the sample.
    """
    key, n = F.xxhash64(F.col(on), F.lit(10)), df.count()
    if n > 2 * limit:
        share = 1.2 * limit / n + 100 / n
        df = df.filter(F.shiftrightunsigned(key, 1) < F.lit(int(share * (1 << 63))))
    return df.orderBy(key, on).limit(limit)


#: Bits of a filter: 2 MB, whatever the input. With very many keys it lets more rows through, which costs time and changes no result.
FILTER_BITS = 1 << 24


def key_filter(df: DataFrame, hashed: str) -> np.ndarray:
    """One bit for each 64-bit hash in a column, by its low bits; put together by Spark, FILTER_BITS / 32 rows at most come back."""
    at = F.col(hashed).bitwiseAND(FILTER_BITS - 1).cast("int")
    words = df.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def may_have(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """False where a hash is surely not in the filter."""
    at = hashed.astype(np.int64) & (FILTER_BITS - 1)
    return ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
