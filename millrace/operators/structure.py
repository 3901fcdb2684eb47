"""Inspection of structure: which columns are keys, and which columns' values lie within another's.

Values are known by 128 bits (two 64-bit hashes). Everything is counted by value first, on the map side too, so frequent values are no hot keys; what reaches
the driver is a row for each column or set of columns.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sets of columns that are counted in one scan; more take further scans.
AT_ONCE = 64
#: Part of all values, by their hash, in which repeats are looked for first: a repeat found there is one, whatever the rest is.
SLICE = 256
#: Types whose values are compared with each other, and the type they are compared as.
FAMILIES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "string": "string", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "boolean": "boolean"}


def _value(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")]


def _repeating(df: DataFrame, sets: list[tuple[str, ...]], part: int) -> set[tuple[str, ...]]:
    """Sets of columns with a value that two rows have, among the values whose hash is a multiple of ``part``: all rows of such a value are looked at."""
    out = set()
    for lo in range(0, len(sets), AT_ONCE):
        some = sets[lo : lo + AT_ONCE]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *_value(*map(F.col, s))) for i, s in enumerate(some)])).alias("v")
        values = df.select(each).select("v.*").filter(F.col("a") % part == 0).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        out |= {some[r.i] for r in values.filter("n > 1").select("i").distinct().collect()}
    return out


def candidate_keys(df: DataFrame, columns: list[str], most: int = 2) -> DataFrame:
    """(``columns``, ``size``): the least sets of up to ``most`` columns whose values together are never null and never repeat; names joined by commas, in the order given.

    Level by level: a set is looked at only if no part of it is a key and none of its columns has nulls. One part in SLICE of its values
    comes first, with all their rows; a set with a repeat there is no key. Only the others, keys or nearly so, have all their values shuffled. An empty table has no keys.
    """
    spark = df.sparkSession
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    keys: list[tuple[str, ...]] = []
    usable = [c for i, c in enumerate(columns) if counts[f"c{i}"] == counts.n]
    for size in range(1, most + 1 if counts.n else 1):
        sets = [s for s in combinations(usable, size) if not any(set(k) <= set(s) for k in keys)]
        for part in (SLICE, 1):
            repeat = _repeating(df, sets, part)
            sets = [s for s in sets if s not in repeat]
        keys += sets
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "columns string, size int")


def inclusions(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(``column``, ``within``, ``n_values``): pairs of columns, named table.column, such that every value of the first is one of the second's.

    Nulls are no values, and a column without values lies in none. Columns are compared with those of one family of types (:data:`FAMILIES`);
    columns of other types are left out. One table of values says in which columns each is; a value makes a row for each pair
    of its columns, so the work is bounded by the number of columns and not by how often a value occurs.
    """
    names, parts = [], []
    for table, df in tables.items():
        own = []
        for c, kind in df.dtypes:
            if kind in FAMILIES:
                own.append(F.struct(F.lit(len(names)).alias("i"), F.col(c).isNull().alias("missing"), F.lit(FAMILIES[kind]).alias("family"), *_value(F.col(c).cast(FAMILIES[kind]))))
                names.append(f"{table}.{c}")
        if own:
            parts.append(df.select(F.explode(F.array(*own)).alias("v")).select("v.*").filter("NOT missing").drop("missing").distinct())
    columns = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    if not parts:
        return spark.createDataFrame([], "column string, within string, n_values bigint")
    values = reduce(DataFrame.unionAll, parts).groupBy("family", "a", "b").agg(F.array_sort(F.collect_set("i")).alias("s"))
    pairs = values.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    own = pairs.filter("x = y").select("x", F.col("n").alias("own"))
    found = pairs.filter("x <> y").join(own, "x").filter("n = own")
    # A row for each column: few.
    one, two = (F.broadcast(columns.toDF(s, out)) for s, out in (("x", "column"), ("y", "within")))
    return found.join(one, "x").join(two, "y").select("column", "within", F.col("n").alias("n_values"))
