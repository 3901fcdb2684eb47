"""Model evaluation: folds that do not leak, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups are dealt by hand if they hold more than one part in so many of a fold's share.
HEAVY = 64
#: Labels that may be told apart.
MOST_LABELS = 1000


def split_folds(df: DataFrame, group: str, label: str, folds: int, output: str = "fold") -> DataFrame:
    """All rows with a fold from 0 to ``folds`` - 1: whole groups go to one fold, and labels are spread evenly.

    Groups that hold more than 1 / (HEAVY * folds) of all rows (so HEAVY * folds groups at most; their counts by label reach the driver) are dealt largest first, each to the
    fold where its labels are missing most. All others go by a hash of the group, so their fold never changes
    when rows are added. A null group is a group, as is a null label a label. More than MOST_LABELS labels are an error, and so is
    a column called like ``output``. An empty table gives an empty table.
    """
    if folds < 1 or output in df.columns:
        raise ValueError("there is one fold at least, and its column is a new one")
    counts = df.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    total = sum(labels.values())
    sizes = counts.groupBy(F.col("group").alias("heavy")).agg(F.sum("n").alias("size")).filter(F.col("size") * HEAVY * folds > total)
    rows = counts.join(F.broadcast(sizes), F.col("group").eqNullSafe(F.col("heavy"))).select("group", "label", "n", "size").collect()
    large: dict = {}
    for r in rows:
        large.setdefault((r.size, r.group), {})[r.label] = r.n
    load = [dict.fromkeys(labels, 0) for _ in range(folds)]
    dealt = []
    for (size, name), own in sorted(large.items(), key=lambda x: (-x[0][0], x[0][1] is None, str(x[0][1]))):
        # Each label counts by its share, so rare ones weigh as much as common ones.
        cost = [sum(((f[k] + n) ** 2 - f[k] ** 2) / labels[k] ** 2 for k, n in own.items()) for f in load]
        best = min(range(folds), key=lambda i: (cost[i], i))
        for k, n in own.items():
            load[best][k] += n
        dealt.append((name, best))
    kind = df.schema[group].dataType.simpleString()
    hand = df.sparkSession.createDataFrame(dealt, f"__group {kind}, __fold int")
    digest = F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")))
    hashed = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds).cast("int")
    out = df.join(F.broadcast(hand), df[group].eqNullSafe(hand["__group"]), "left")
    return out.select(*[df[c] for c in df.columns], F.coalesce(F.col("__fold"), hashed).alias(output))


def ranking_metrics(df: DataFrame, score: str, label: str, cells: int = 1024, digits: int = 9) -> DataFrame:
    """One row: ``n_pos``, ``n_neg``, ``auc`` with ``auc_low`` and ``auc_high`` (95 %), ``average_precision`` and ``calibration_error``.

    ``label`` is true (or not 0) for positives. Rows with a null or NaN score, or a null label, do not count. Ties count half in the area, and one step in the precision. The interval is
    DeLong's: from the variance of each row's placement among the other class. Calibration: mean over ten bins of [0, 1] of
    |sum of scores - positives|; scores outside belong to the outer bins. Without positives or negatives the areas are null.

    Rows are counted by score first (on the map side too). Distinct scores are then dealt to ``cells`` by quantiles, whose totals are
    summed up from the top, and only within a cell are scores sorted: no task sees all of them.
    """
    s = F.col(score).cast("double")
    rows = df.select(s.alias("s"), F.col(label).cast("boolean").cast("bigint").alias("pos")).filter("s IS NOT NULL AND NOT isnan(s) AND pos IS NOT NULL")
    bins = F.least(F.greatest(F.floor(F.col("s") * 10), F.lit(0)), F.lit(9))
    each = rows.groupBy("s").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    cuts = sorted(set(each.agg(F.percentile_approx("s", [i / cells for i in range(1, cells)], 10_000).alias("q")).first().q or []))
    line = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = each.withColumn("cell", F.size(F.filter(line, lambda x: x < F.col("s"))))
    totals = placed.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)  # over ``cells`` rows at most
    above = totals.select("cell", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_above"))
    own = W.partitionBy("cell").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(above), "cell").select("s", "pos", "neg", (F.col("p_above") + F.sum("pos").over(own)).alias("up_pos"), (F.col("n_above") + F.sum("neg").over(own)).alias("up_neg"))
    wide = lambda c: c.cast("decimal(19,0)")
    # Twice the placements, as whole numbers: of a positive the negatives below it, of a negative the positives above it.
    all_ = ranked.crossJoin(F.broadcast(each.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))))
    of_pos = 2 * (F.col("n_neg") - F.col("up_neg")) + F.col("neg")
    of_neg = 2 * F.col("up_pos") - F.col("pos")
    sums = all_.agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.sum(wide(F.col("pos")) * wide(of_pos)).cast("double").alias("u"),
        F.sum(F.col("pos") * of_pos.cast("double") * of_pos).alias("pp"), F.sum(F.col("neg") * of_neg.cast("double") * of_neg).alias("nn"),
        F.sum(F.col("pos") * F.col("up_pos").cast("double") / (F.col("up_pos") + F.col("up_neg"))).alias("precision"),
    )
    off = rows.groupBy(bins.alias("bin")).agg(F.abs(F.sum("s") - F.sum("pos")).alias("off"), F.count(F.lit(1)).alias("n")).agg(F.sum("off").alias("off"), F.sum("n").alias("rows"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.col("u") / (2 * p * n)
    variance = (F.col("pp") / (4 * n * n) / p - auc * auc) / p + (F.col("nn") / (4 * p * p) / n - auc * auc) / n
    half = F.sqrt(F.greatest(variance, F.lit(0.0))) * 1.959963984540054
    some = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    out = sums.crossJoin(F.broadcast(off))
    value = lambda c: F.round(F.when(some, c), digits)
    return out.select(
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), value(auc).alias("auc"), value(F.greatest(auc - half, F.lit(0.0))).alias("auc_low"), value(F.least(auc + half, F.lit(1.0))).alias("auc_high"),
        F.round(F.when(F.col("n_pos") > 0, F.col("precision") / p), digits).alias("average_precision"), F.round(F.when(F.col("rows") > 0, F.col("off") / F.col("rows")), digits).alias("calibration_error"),
    )
