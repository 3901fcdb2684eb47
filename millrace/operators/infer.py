"""Inference with a model that the caller supplies, or with a linear one that is fitted here and kept in the shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predict(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series]], inputs: list[str], output: str, kind: T.DataType) -> DataFrame:
    """Add a prediction column.

    ``make_model`` runs once per task and returns a function of a batch of the
    input columns. Batches are Arrow batches; no shuffle, order and rows kept. Nulls reach the model as pandas
    shows them (NaN or None), and NaN comes back as null, in all columns; an empty table gives an empty table. A column that is called like ``output`` already is an error.
    """
    if output in df.columns:
        raise ValueError(f"there is a column {output} already")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield batch.assign(**{output: model(batch[inputs])})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(output, kind)]))


def fit_linear(df: DataFrame, inputs: list[str], label: str, ridge: float = 1e-9) -> dict:
    """Least squares over all rows: ``{"inputs": [...], "weights": [...], "bias": ...}``.

    One pass sums up products of the columns, (inputs + 2) squared numbers, which the driver solves; ``ridge`` is a small penalty on the weights of columns in units of
    their spread, so constant or repeated inputs do no harm. Rows with a null or NaN anywhere do not count; without rows all weights are 0.
    """
    names = [*inputs, label]
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    rows = rows.filter(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(names))))
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    # Means first, so that large numbers of little spread lose no digits.
    mean = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(n)]).first()
    if mean[0] is None:
        return {"inputs": inputs, "weights": [0.0] * len(inputs), "bias": 0.0}
    off = [F.col(f"x{i}") - F.lit(float(mean[i])) for i in range(n)]
    sums = rows.agg(*[F.avg(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((n, n))
    for (i, j), s in zip(pairs, sums, strict=True):
        cov[i, j] = cov[j, i] = s
    spread = np.sqrt(np.diag(cov)[:-1])
    spread[spread == 0] = 1.0
    scaled = cov[:-1, :-1] / np.outer(spread, spread) + ridge * np.eye(n - 1)
    weights = np.linalg.solve(scaled, cov[:-1, -1] / spread) / spread
    return {"inputs": inputs, "weights": weights.tolist(), "bias": float(mean[n - 1] - np.dot(weights, list(mean)[:-1]))}


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Write a model to a folder that the cluster shares."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def linear_model(model: dict) -> Callable[[], Callable[[pd.DataFrame], pd.Series]]:
    """A model of :func:`fit_linear` for :func:`predict`; a row with a missing input has no (null) prediction."""

    def make() -> Callable[[pd.DataFrame], pd.Series]:
        weights, bias = np.array(model["weights"]), model["bias"]
        return lambda x: pd.Series(x[model["inputs"]].astype("float64").to_numpy() @ weights + bias, index=x.index)

    return make
