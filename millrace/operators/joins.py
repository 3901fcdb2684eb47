"""Joins by time and by interval, with hot keys and long intervals cut into slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources import Workspace


def as_of(left: DataFrame, right: DataFrame, time: str, keys: list[str], slice_seconds: int, tolerance_seconds: int | None = None, suffix: str = "_right") -> DataFrame:
    """All rows of ``left``, each with the last row of ``right`` that has its keys and a time not after its own; null columns if there is none.

    Columns of ``right`` but the keys come with ``suffix``. Of several right rows at one time the greatest by the
    rest of the row counts. With a tolerance, a right row that is older by more does not count. A null key or time matches nothing. ``left`` rows may
    repeat. Empty inputs are fine.

    Time is cut into slices, so the rows of a hot key are sorted slice by slice in many tasks: the last right row of each (key, slice) is carried over to
    later slices by a window over slices, one row each, and then joined in. Nothing is compared pair by pair.
    """
    if slice_seconds < 1:
        raise ValueError("a slice has a second at least")
    taken = {c: f"{c}{suffix}" for c in right.columns if c not in keys}
    clash = set(taken.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    when = seconds(F.col(time))
    usable = when.isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]
    slot = F.floor(when / (slice_seconds * 1_000_000)).alias("__slice")
    value = F.struct(when.alias("when"), F.struct(*right.columns).alias("row"))
    mine = left.filter(usable).select(*names, slot, when.alias("__when"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__right"))
    theirs = right.filter(usable).select(*names, slot, when.alias("__when"), F.lit(0).alias("__side"), F.lit(None).cast(mine.schema["__left"].dataType).alias("__left"), value.alias("__right"))

    # One row for each (key, slice) on either side; the greatest right row of all slices before is what comes in.
    ends = theirs.groupBy(*by, "__slice").agg(F.max("__right").alias("__last"))
    wanted = ends.unionByName(mine.select(*by, "__slice", F.lit(None).cast(ends.schema["__last"].dataType).alias("__last")).distinct()).groupBy(*by, "__slice").agg(F.max("__last").alias("__last"))
    before = F.max("__last").over(W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1))
    carried = wanted.select(*by, "__slice", before.alias("__right")).filter("__right IS NOT NULL")
    carried = carried.select(*by, "__slice", F.lit(None).cast("bigint").alias("__when"), F.lit(0).alias("__side"), F.lit(None).cast(mine.schema["__left"].dataType).alias("__left"), "__right")

    # Within a slice: right rows of a time come before left rows of it, and what is carried comes first.
    own = W.partitionBy(*by, "__slice").orderBy(F.asc_nulls_first("__when"), "__side").rowsBetween(W.unboundedPreceding, 0)
    matched = mine.unionByName(theirs).unionByName(carried).withColumn("__found", F.max("__right").over(own)).filter("__side = 1")
    good = F.col("__found").isNotNull()
    if tolerance_seconds is not None:
        good = good & (F.col("__when") - F.col("__found.when") <= tolerance_seconds * 1_000_000)
    columns = [F.col(f"__left.`{c}`").alias(c) for c in left.columns]
    out = matched.select(*columns, *[F.when(good, F.col(f"__found.row.`{c}`")).alias(n) for c, n in taken.items()])
    rest = left.filter(~F.coalesce(usable, F.lit(False)))
    return out.unionByName(rest.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in taken.items()]))


def in_interval(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, keys: tuple[str, ...] = (), bins: int = 256) -> DataFrame:
    """Pairs of a point and an interval with low <= value < high and equal keys: all columns of both, the keys once.

    The line is cut at quantiles of the intervals' bounds (``bins`` numbers reach the driver), so crowded stretches have small bins. A point lies in one bin; an interval
    is copied to each bin that it touches. The join is an equi-join by bin and keys, and each pair meets in the
    point's bin alone, so it is found once. An interval that touches more than 16 bins goes by whole blocks of 16 bins instead, and beyond that by blocks of
    256, so a long one has a bounded number of copies. A null value, bound or key matches nothing, and neither does an empty interval. Names of columns must differ, but for the keys.
    """
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    usable = intervals.filter(F.col(low) < F.col(high))
    number = lambda c: F.unix_micros(c.cast("timestamp")).cast("double") if _is_time(points, value) else c.cast("double")
    bounds = usable.select(F.explode(F.array(number(F.col(low)), number(F.col(high)))).alias("x"))
    share = [i / bins for i in range(1, bins)]
    cuts = sorted(set((bounds.agg(F.percentile_approx("x", share, 10_000).alias("q")).first().q or [])))
    # The number of cuts at or below a number; a step of this function never puts a point in a bin that its interval does not touch.
    line = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    place = lambda c: F.size(F.filter(line, lambda x: x <= number(c)))
    first, last = place(F.col(low)), place(F.col(high))
    sides = usable.withColumn("__first", first).withColumn("__last", last)

    def parts(level: int, a: Column, b: Column) -> Column:
        """The stretch [a, b) of blocks of 16**level bins: its ends by such blocks, its middle by larger ones, each bin once."""

        def own(x: Column, y: Column) -> Column:
            blocks = F.transform(F.sequence(x, y - 1), lambda i: F.struct(F.lit(level).alias("level"), i.alias("bin")))
            return F.when(x < y, blocks).otherwise(F.array().cast("array<struct<level:int,bin:int>>"))

        if level == 2:
            return own(a, b)
        up, down = F.ceil(a / 16).cast("int"), F.floor(b / 16).cast("int")
        return F.when(up < down, F.concat(own(a, up * 16), parts(level + 1, up, down), own(down * 16, b))).otherwise(own(a, b))

    sides = sides.withColumn("__block", F.explode(parts(0, F.col("__first"), F.col("__last") + 1))).select(*intervals.columns, F.col("__block.level").alias("__level"), F.col("__block.bin").alias("__bin"))
    spots = points.filter(F.col(value).isNotNull()).withColumn("__at", place(F.col(value)))
    spots = spots.withColumn("__block", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("__at") / 16**n).cast("int").alias("bin")) for n in range(3)])))
    spots = spots.select(*points.columns, F.col("__block.level").alias("__level"), F.col("__block.bin").alias("__bin"))
    joined = spots.join(sides, [*keys, "__level", "__bin"])
    return joined.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__level", "__bin")


def interval_summary(points: DataFrame, intervals: DataFrame, value: str, least: str, low: str, high: str, cells: int = 1024) -> DataFrame:
    """All rows of ``intervals``, with ``n_points``, how many points have low <= value < high, and ``least_point``, the least ``least`` among these (null without any). Both may repeat rows.

    No pair is made, so the work grows with the rows of both sides and not with their product. Values and bounds are numbers. Points are counted by value first, and equal intervals are one. Values get
    their place in order: they are dealt to ``cells`` by quantiles, whose totals are broadcast, and sorted within a cell together with the bounds. What is below a bound
    gives the count. For the least, nodes of 16, 256, ... places hold theirs, and an interval is a stretch of at most 30 nodes of each size. A null or NaN value or bound
    matches nothing, and neither does an empty interval.
    """
    clash = {"n_points", "least_point"} & set(intervals.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    number = lambda c: F.col(c).cast("double")
    good = lambda c: number(c).isNotNull() & ~F.isnan(number(c))
    with Workspace(points.sparkSession) as work:
        each = work.keep(points.filter(good(value)).groupBy(number(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("m")), "values")
        wanted = work.keep(intervals.filter(good(low) & good(high) & (F.col(low) < F.col(high))).select(number(low).alias("lo"), number(high).alias("hi")).distinct(), "intervals")
        cuts = sorted(set(each.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 10_000).alias("q")).first().q or []))
        line = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
        bounds = wanted.select(F.col("lo").alias("v")).unionAll(wanted.select("hi")).distinct().select("v", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(dict(each.dtypes)["m"]).alias("m"), F.lit(0).alias("point"))
        rows = each.select("v", "n", "m", F.lit(1).alias("point")).unionAll(bounds).withColumn("cell", F.size(F.filter(line, lambda x: x <= F.col("v"))))
        earlier = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # over ``cells`` rows at most
        totals = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("point").alias("k")).select("cell", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "k")])
        # A bound comes before a value that is equal to it.
        own = W.partitionBy("cell").orderBy("v", "point").rowsBetween(W.unboundedPreceding, -1)
        below = [(F.col(f"{c}0") + F.coalesce(F.sum(f).over(own), F.lit(0))).alias(o) for c, f, o in (("n", "n", "below"), ("k", "point", "place"))]
        placed = work.keep(rows.join(F.broadcast(totals), "cell").select("v", "m", "point", *below), "placed")
        at = placed.filter("point = 0")
        ends = wanted.join(at.select(F.col("v").alias("lo"), F.col("below").alias("a"), F.col("place").alias("first")), "lo").join(at.select(F.col("v").alias("hi"), F.col("below").alias("b"), F.col("place").alias("last")), "hi")
        ends = work.keep(ends.filter("a < b").select("lo", "hi", (F.col("b") - F.col("a")).alias("n"), "first", "last"), "ends")

        levels = max(1, -(-max(1, each.count()).bit_length() // 4))

        def nodes(level: int, a: Column, b: Column) -> Column:
            """The stretch [a, b) of nodes of 16**level places."""

            def one(x: Column, y: Column) -> Column:
                found = F.transform(F.sequence(x, y - 1), lambda i: F.struct(F.lit(level).alias("level"), i.alias("node")))
                return F.when(x < y, found).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))

            if level == levels:
                return one(a, b)
            up, down = F.shiftright(a + 15, 4), F.shiftright(b, 4)
            return F.when(up < down, F.concat(one(a, up * 16), nodes(level + 1, up, down), one(down * 16, b))).otherwise(one(a, b))

        above = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("place", 4 * i).alias("node")) for i in range(levels + 1)])).alias("x")
        tree = placed.filter("point = 1").select(above, "m").groupBy("x").agg(F.min("m").alias("m"))
        pieces = ends.select("lo", "hi", F.explode(nodes(0, F.col("first"), F.col("last"))).alias("x"))
        low_ones = pieces.join(tree, "x").groupBy("lo", "hi").agg(F.min("m").alias("m"))
        found = work.result(ends.join(low_ones, ["lo", "hi"]).select("lo", "hi", "n", "m"), "summaries")
    out = intervals.join(found, (number(low) == F.col("lo")) & (number(high) == F.col("hi")), "left")
    return out.select(*[intervals[c] for c in intervals.columns], F.coalesce("n", F.lit(0)).alias("n_points"), F.col("m").alias("least_point"))


def _is_time(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date")
