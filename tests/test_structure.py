"""Keys and inclusions against plain loops."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.operators import structure


@pytest.mark.parametrize("most", [1, 2, 3])
def test_candidate_keys(spark, monkeypatch, most):
    monkeypatch.setattr(structure, "AT_ONCE", 2)
    rng = random.Random(most)
    rows = [(i, i // 7, i % 7, rng.randrange(30), rng.choice("ab"), None if i == 3 else i, "x") for i in range(70)]
    names = ["id", "d", "m", "r", "s", "hole", "one"]
    df = spark.createDataFrame(rows, "id int, d long, m int, r int, s string, hole long, one string").repartition(3)
    keys = []
    for size in range(1, most + 1):
        for s in combinations(range(7), size):
            values = [tuple(r[i] for i in s) for r in rows]
            if not any(set(k) <= set(s) for k in keys) and len(set(values)) == 70 and not any(None in v for v in values):
                keys.append(s)
    got = op.candidate_keys(df, names, most).collect()
    assert sorted((r.columns, r.size) for r in got) == sorted((",".join(names[i] for i in k), len(k)) for k in keys)
    assert op.candidate_keys(df.unionByName(df), names, most).count() == 0
    assert op.candidate_keys(df.limit(0), names, most).count() == 0


def test_only_keys_have_all_their_values_shuffled(spark, monkeypatch):
    looked, repeating = [], structure._repeating
    monkeypatch.setattr(structure, "_repeating", lambda df, sets, part: looked.append((part, list(sets))) or repeating(df, sets, part))
    df = spark.range(20_000).select("id", (F.col("id") % 9000).alias("d"), F.greatest("id", F.lit(1)).alias("nearly"), (F.col("id") % 100).alias("m"))
    assert [r.columns for r in op.candidate_keys(df, df.columns).collect()] == ["id", "d,nearly", "nearly,m"]
    # A column with a single repeat passes the first look and is found out by the second.
    assert looked[1][0] == looked[3][0] == 1 and {("id",), ("nearly",)} <= set(looked[1][1]) and ("d",) not in looked[1][1]
    assert looked[3][1] == [("d", "nearly"), ("nearly", "m")]


def test_inclusions(spark):
    a = spark.createDataFrame([(1, "x", 1.5, None), (2, "y", 2.0, None), (2, None, 2.0, None)], "k int, s string, f double, none int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "1")], "id long, t string").withColumn("list", F.array("t"))
    got = sorted(tuple(r) for r in op.inclusions(spark, {"a": a, "b": b, "c": b.limit(0)}).collect())
    assert got == [("a.k", "b.id", 2), ("a.s", "b.t", 2)]
    assert op.inclusions(spark, {}).count() == 0 == op.inclusions(spark, {"c": b.select("list")}).count()
