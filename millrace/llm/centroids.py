"""Centroid clustering of vectors: plain Lloyd rounds in whole numbers.

1. Vectors are checked and turned into whole numbers once, and written to the shared folder; each round reads that table.
2. A round broadcasts the centroids (``k`` times the length of a vector). Each partition works out the squared differences to
   every centroid in numpy, takes the nearest one (the lowest number of several), and sends on one row per centroid and component:
   the sum and the count. A groupBy adds them up, so what is shuffled does not depend on the number of vectors.
3. The driver divides the ``k`` times length sums, in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import keep

#: Components are smaller than this, so a squared distance of MOST_COMPONENTS of them fits in 64 bits.
LARGEST, MOST_COMPONENTS = 1 << 27, 128


def whole_numbers(df: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, whole): floor(scale * x) of each component of the vectors that have exactly ``size`` of them, none null or not finite; 32-bit numbers as bytes."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(F.size("vector") == size)
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
            good = np.isfinite(x).all(1)
            x = np.floor(scale * x[good])
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"a component is {LARGEST} or more after scaling: its squared distances would not fit in 64 bits")
            raw = x.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([raw[i : i + 4 * size] for i in range(0, len(raw), 4 * size)], pa.binary())], names=["key", "whole"])

    return rows.mapInArrow(run, f"key {kind}, whole binary")


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").astype(np.int64).reshape(-1, size)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of least squared distance (the lowest number of several), and that distance."""
    distance = np.stack([np.square(vectors - c).sum(1) for c in centroids], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(best)), best]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid: ``k`` times size rows reach the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                own = _matrix(batch["whole"], size)
                best, _ = nearest(own, shared.value)
                np.add.at(sums, best, own)
                counts += np.bincount(best, minlength=k)
        there = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": np.repeat(there, size), "component": np.tile(np.arange(size), len(there)), "total": sums[there].ravel(), "n": np.repeat(counts[there], size)})

    parts = vectors.select("whole").mapInPandas(run, "cluster int, component int, total long, n long")
    merged = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for row in merged.orderBy("cluster", "component").collect():
        out.setdefault(row.cluster, (row.n, []))[1].append(int(row.total))
    shared.destroy()
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The vectors whose keys have the least SHA-256 of ``seed:key`` in hexadecimal, in that order; a null key counts as no text, equal keys go by their vectors."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(by, "whole").select("whole").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.whole), "<i4") for r in rows], np.int64).reshape(-1, size)


def cluster(df: DataFrame, key: str, vector: str, size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(key, ``cluster``, ``distance``) of every vector kept by :func:`whole_numbers` after ``rounds`` rounds and a last assignment; and the final centroids.

    A round replaces each centroid by floor(sum / count) of its vectors, componentwise and exact; one without vectors stays.
    With fewer vectors than ``k`` there are fewer centroids; an empty table gives an empty table. Rows that share a key, or have none, are
    vectors of their own. Other columns are dropped, so none can clash. Components too large for exact 64-bit distances are an error.
    """
    if not 0 < size <= MOST_COMPONENTS or k < 1:
        raise ValueError(f"vectors have 1 to {MOST_COMPONENTS} components, and there is a centroid at least")
    vectors = keep(whole_numbers(df, key, vector, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed, size)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in cluster_sums(vectors, centroids).items():
            centroids[c] = [t // n for t in total]
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(vectors.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").astype(np.int64).reshape(-1, size), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {kind}, cluster int, distance long").withColumnRenamed("key", key), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` (distances summed over a vector's cluster, and over all) and ``centroid_sha256`` (of its centroid's components in decimal, joined by commas).

    One row per centroid comes back from the sum and is joined by broadcast; it is bounded by the number of centroids.
    """
    spark = assigned.sparkSession
    assigned = keep(assigned, "assigned")
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    rows = [(c, s, sum(sums.values()), ",".join(map(str, centroids[c]))) for c, s in sums.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    each = each.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(each), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")
