"""The steps of dataset curation as joins and aggregations.

Nulls: a null key is equal to nothing, so such a row is never a member, never
overlaps, and keeps null annotations. Empty inputs give empty outputs with the
same columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import words
from millrace.sources import Workspace


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inspect a source: one row per column with rows, nulls, distinct values, least and greatest (as text).

    Each column is counted by value first, on the map side too, and what is left is summed up; a scan reads
    that column alone. An empty source has zero rows and null bounds.
    """

    def one(c: str) -> DataFrame:
        by_value = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return by_value.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
            F.count("v").alias("n_distinct"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest"),
        ).select(F.lit(c).alias("column"), "*")

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def identify(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; unknown (null) counts as no."""
    return df.filter(predicate)


def verify_membership(df: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """Rows whose key a trusted list has; repeats in the list do not repeat rows."""
    return df.join(trusted.select(key), key, "left_semi")


def exclude_overlap(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key another dataset does not have; rows without a key stay."""
    return df.join(other.select(key), key, "left_anti")


def annotate(df: DataFrame, annotations: DataFrame, key: str, suffix: str = "_noted") -> DataFrame:
    """All rows, with the annotations of their key where there are any; several annotations of a key repeat its rows.

    An annotation column that has the name of a column of ``df`` gets ``suffix``.
    """
    return df.join(annotations.select(key, *[F.col(c).alias(c + suffix if c in df.columns else c) for c in annotations.columns if c != key]), key, "left")


def integrate(parts: list[DataFrame]) -> DataFrame:
    """Put sources with differing columns together; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_rows(df: DataFrame, name: Column, names: DataFrame, most_broadcast: int = 1_000_000, buckets: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose name (two hashes, ``a`` and ``b``) is surely not among ``names``, and those that may be; with a column ``__name``.

    What is broadcast is ``names`` itself if there are ``most_broadcast`` or fewer, else the set of buckets that they fall into, ``buckets``
    of 8 bytes at most. So rows that are not meant never move, and the others still have to be joined by name.
    """
    rows = df.withColumn("__name", name)
    if names.count() <= most_broadcast:
        some = F.broadcast(names.select(F.struct("a", "b").alias("__name")).distinct())
        return rows.join(some, "__name", "left_anti"), rows.join(some, "__name", "left_semi")
    rows = rows.withColumn("__bucket", F.pmod(F.col("__name.a"), F.lit(buckets)))
    some = F.broadcast(names.select(F.pmod("a", F.lit(buckets)).alias("__bucket")).distinct())
    return rows.join(some, "__bucket", "left_anti").drop("__bucket"), rows.join(some, "__bucket", "left_semi").drop("__bucket")


def without_rows(df: DataFrame, name: Column, names: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose name (two hashes, ``a`` and ``b``) is not among ``names``. Only rows that may be go into a shuffle, and none if ``names`` is small."""
    clear, rest = split_rows(df, name, names, most_broadcast)
    if names.count() > most_broadcast:
        clear = clear.unionByName(rest.join(names.select(F.struct("a", "b").alias("__name")), "__name", "left_anti"))
    return clear.select(*df.columns)


def _name(*columns: str) -> Column:
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def dedup_exact(df: DataFrame, key: str, order: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per key value, the one least in ``order`` (then by a hash of the whole row); rows without a key all stay.

    Rows are named by 128 bits of all their columns, and keys by their SHA-256 if they are texts. Only these names are grouped, joined and
    sorted, and copies collapse on the map side; then the rows that go, or are there several times alike, are taken out of
    the table by name. Maps cannot be hashed: a column with one is an error.
    """
    by = F.unhex(F.sha2(F.col(key), 256)) if dict(df.dtypes)[key] in ("string", "binary") else F.col(key)
    with Workspace(df.sparkSession) as work:
        names = df.filter(F.col(key).isNotNull()).select(by.alias("by"), F.struct(F.col(order).alias("order"), _name(*df.columns).alias("name")).alias("row"))
        names = names.groupBy("by", "row").agg(F.count(F.lit(1)).alias("copies"))
        # A minimum combines on the map side, and a join with one row a key can be split, so a key with very many rows is no hot one.
        least = names.groupBy("by").agg(F.min("row").alias("least"))
        touched = names.join(least, "by").filter("row <> least OR copies > 1").select("row.name.*", (F.col("row") == F.col("least")).alias("stays"))
        touched = work.result(touched, "touched")
    clear, rest = split_rows(df, _name(*df.columns), touched, most_broadcast)
    named = touched.select(F.struct("a", "b").alias("__name"), "stays")
    named = F.broadcast(named) if touched.count() <= most_broadcast else named
    # A key that is null never got a name, unless a row alike had one: names hold the key too.
    rest = rest.join(named, "__name", "left").filter("stays IS NULL OR stays")
    alone = rest.filter("stays IS NULL").select(*df.columns)
    alike = rest.filter("stays").groupBy("__name").agg(F.first(F.struct(*df.columns)).alias("row")).select("row.*")
    return clear.select(*df.columns).unionByName(alone).unionByName(alike)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per value of the keys; a key called ``n_rows`` is an error."""
    if "n_rows" in keys:
        raise ValueError("n_rows is the count")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def classify_counts(df: DataFrame, key: str, taxonomy: DataFrame, label: str) -> DataFrame:
    """Label rows through a taxonomy and count by label.

    Counting by key comes first: the join then sees one row per key, and a hot key costs nothing. A key or label called ``n_rows`` is an error.
    """
    if "n_rows" in (key, label):
        raise ValueError("n_rows is the count")
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_key.join(taxonomy.select(key, label), key).groupBy(label).agg(F.sum("n_rows").alias("n_rows"))


def _runs(units: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` units."""
    of = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))
    # Inside transform the units are a variable, so they are worked out once and not for every run.
    return F.get(F.transform(F.array(units), lambda w: F.when(F.size(w) >= n, of(w))), 0)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def exclude_contained(df: DataFrame, probes: DataFrame, text: str, probe_text: str, gram: int = 3, most_broadcast: int = 1_000_000) -> DataFrame:
    """Rows whose text contains none of the probe texts verbatim.

    A probe's words but its first and last must occur as whole words, so an inner run of ``gram`` words is an
    equi-join key: of its runs the one that the fewest texts have. A probe too short for that goes by its first run of three characters (or all, if
    it has fewer). Texts are taken apart to hashes alone, 24 bytes a run with two 64-bit hashes of the text; only texts
    that share the run with a probe are read again, moved and compared. The probes' runs are broadcast if there are
    ``most_broadcast`` or fewer (8 bytes each), else shuffled. Empty and null probes are contained in nothing, null
    texts contain nothing. Every row is judged by its text, whatever its other columns are.
    """
    p = probes.select(F.col(probe_text).alias("probe")).filter(F.length("probe") > 0).distinct()
    w = words(F.col("probe"))
    inner = lambda w: F.transform(F.sequence(F.lit(2), F.size(w) - gram), lambda i: F.xxhash64(F.slice(w, i, gram)))
    letters = F.least(F.char_length("probe"), F.lit(3))
    start = F.xxhash64(_letters(F.substr("probe", F.lit(1), letters)))
    long = F.size(w) >= gram + 2
    runs = F.when(long, F.array_distinct(F.get(F.transform(F.array(w), lambda x: F.when(F.size(x) >= gram + 2, inner(x))), 0))).otherwise(F.array(start))
    keyed = p.select("probe", F.when(long, 0).otherwise(letters).alias("kind"), F.explode(runs).alias("run"))
    with Workspace(df.sparkSession) as work:
        keyed = work.keep(keyed, "runs")
        kinds = {r["kind"]: r["count"] for r in keyed.groupBy("kind").count().collect()}  # four rows at most
        if not kinds:
            return df
        rows = df.select(F.col(text).alias("text")).filter("text IS NOT NULL").withColumn("name", _name("text"))

        def near(kind: int) -> DataFrame:
            apart = _runs(words(F.col("text")), gram) if kind == 0 else _runs(_letters(F.col("text")), kind)
            names = keyed.filter(F.col("kind") == kind).select("run").distinct()
            found = rows.select("name", F.explode(apart).alias("run")).join(F.broadcast(names) if kinds[kind] <= most_broadcast else names, "run", "left_semi")
            return found.withColumn("kind", F.lit(kind))

        found = work.keep(reduce(DataFrame.unionByName, [near(k) for k in sorted(kinds)]).distinct(), "found")
        # Runs without any text keep their probe from being looked for at all.
        counts = found.groupBy("kind", "run").agg(F.count(F.lit(1)).alias("n"))
        best = keyed.join(counts, ["kind", "run"], "left").groupBy("probe", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("b")).filter("b.n > 0")
        pairs = work.keep(found.join(best.select("kind", F.col("b.run").alias("run"), "probe"), ["kind", "run"]).select("name", "probe").distinct(), "pairs")
        _, some = split_rows(rows.select("text"), _name("text"), pairs.select("name.*").distinct(), most_broadcast)
        hits = some.join(pairs.withColumnRenamed("name", "__name"), "__name").filter(F.contains("text", "probe")).select("__name.*").distinct()
        hits = work.result(hits, "hits")
    return without_rows(df, _name(text), hits, most_broadcast)
