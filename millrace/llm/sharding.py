"""Sharding by jump consistent hashing, in DataFrame functions only.

A key walks through increasing shard counts and jumps at a few of them; its shard
among n is where its last jump below n went. The jumps depend on the key and on
how many it has made, never on n, so one more shard takes rows only into itself. Draws come
from MD5, which other engines have too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.tables import keep


def draw_bits(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts with colons between them; null is an empty part."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substr(F.md5(joined), F.lit(1), F.lit(8)), 16, 10).cast("long")


def jump_shard(key: Column, *counts: int, most_steps: int | None = None) -> Column:
    """The key's shard for each of the shard counts (array<int>), from a single walk.

    Null keys are one more key. A walk makes ln(n) jumps on average and n at most; the fold takes three times
    as many and a few more, and for the rare key whose walk is not over then, a second fold takes the rest.
    """
    most = max(counts)
    steps = min(most, most_steps or 8 + math.ceil(3 * math.log(most + 1)))
    key = F.coalesce(key.cast("string"), F.lit(""))

    def step(walk: Column, i: Column) -> Column:
        at = walk["next"]
        to = F.least(F.floor((at + 1) / ((draw_bits(key, i) + 1) / F.lit(float(1 << 32)))), F.lit(most).cast("long"))
        shards = F.array(*[F.when(at < n, at.cast("int")).otherwise(walk["shards"][k]) for k, n in enumerate(counts)])
        over = at >= most
        return F.struct(F.when(over, at).otherwise(to).alias("next"), F.when(over, walk["shards"]).otherwise(shards).alias("shards"))

    start = F.struct(F.lit(0).cast("long").alias("next"), F.array(*[F.lit(0)] * len(counts)).alias("shards"))
    begun = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    if steps == most:
        return begun["shards"]
    # Inside transform the first fold's result is a variable, so it is worked out once.
    rest = lambda walk: F.aggregate(F.sequence(F.lit(steps + 1), F.lit(most)), walk, step)["shards"]
    return F.get(F.transform(F.array(begun), lambda walk: F.when(walk["next"] >= most, walk["shards"]).otherwise(rest(walk))), 0)


def shard(df: DataFrame, key: str, shards: int, sizes: dict[str, Column], lanes: int = 64) -> DataFrame:
    """Give each row a shard and a slot in it, under the law ``key``.

    Adds ``shard`` int, ``grown_shard`` int (with one shard more) and ``slot`` long: 0, 1, ... within the shard without
    gaps, in the order of lane, key and sizes. ``sizes`` names columns that are worked
    out from the row before it is shuffled; only they and the key are kept.

    Slots come from ``lanes`` independent parts of each shard, numbered one after another, so no
    shard is sorted as a whole; the lane depends on sizes too, so rows of one hot key spread.
    Null keys go together to one shard. Repeated rows stay, with a slot each. Empty tables
    give empty tables. Other columns are dropped, so none can clash.
    """
    both = jump_shard(F.col("__key"), shards, shards + 1)
    rows = df.select(F.col(key).alias("__key"), *[v.alias(k) for k, v in sizes.items()])
    rows = rows.withColumn("__both", both).withColumn("shard", F.col("__both")[0]).withColumn("grown_shard", F.col("__both")[1]).drop("__both")
    # Written once, so no walk is made twice.
    rows = keep(rows.withColumn("__lane", F.pmod(draw_bits(F.col("__key"), *[F.col(c) for c in sizes]), F.lit(lanes)).cast("int")), "placed")

    # Two windows over one partitioning would still sort a whole shard; the counts of lanes are a table of shards x lanes rows.
    counts = rows.groupBy("shard", "__lane").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("shard").orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(W.partitionBy("shard", "__lane").orderBy("__key", *sizes))
    out = rows.withColumn("__own", own.cast("long") - 1).join(before, ["shard", "__lane"])
    return out.select(F.col("__key").alias(key), *sizes, "shard", (F.col("__before") + F.col("__own")).alias("slot"), "grown_shard")
