"""Parquet tables of the test data set, read with explicit schemas (no inference pass)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The columns of each table.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of ``sf_dir``. Reads only the columns that the plan needs."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any file source of Spark, with the schema given: parquet, csv, json, orc or text."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    """Write a curated dataset; one directory per value of ``partition_by``."""
    writer = df.write.format(fmt).mode("overwrite").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine is set only where a session has none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Intermediate tables of one operator in the shared folder: work done once, lineage cut, lost executors survived.

    The one who opens it holds the names, so two operators at a time never touch each other's tables. When it closes, all tables but the
    result go, also after a failure.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._kept = spark, [], []

    def __enter__(self) -> Workspace:
        return self

    def path(self, name: str) -> str:
        """A path that goes when the workspace closes."""
        self._paths.append(new_path(self.spark, name))
        return self._paths[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing reads any more, before the workspace closes."""
        for df in tables:
            gone = [path for kept, path in self._kept if kept is df]
            self._kept = [x for x in self._kept if x[0] is not df]
            self._paths = [x for x in self._paths if x not in gone]
            self._delete(gone)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Like :meth:`keep`, for a table that stays."""
        out = self.keep(df, name)
        self._paths.pop()
        return out

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_) -> None:
        self._delete(self._paths)
        self._paths, self._kept = [], []
