"""Each step on hand-made rows: null keys, repeated keys on both sides, empty inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import operators as op
from millrace.sources import read_table, write_table
from millrace.streaming import curate_available


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, data=((1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, None))):
    return spark.createDataFrame(list(data), "k long, v string")


def test_membership_and_overlap(spark):
    other = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert rows(op.verify_membership(items(spark), other, "k")) == [(1, "a"), (1, "b")]
    assert rows(op.exclude_overlap(items(spark), other, "k")) == sorted([(2, "a"), (None, "c"), (None, None)], key=repr)
    assert rows(op.exclude_overlap(items(spark, ()), other, "k")) == []
    assert len(rows(op.exclude_overlap(items(spark), other.limit(0), "k"))) == 5


def test_dedup_exact(spark):
    assert rows(op.dedup_exact(items(spark), "v", "k")) == sorted([(1, "a"), (1, "b"), (None, "c"), (None, None)], key=repr)
    assert op.dedup_exact(items(spark, ()), "v", "k").columns == ["k", "v"]


def test_annotate_integrate_counts(spark):
    notes = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, note string")
    assert len(rows(op.annotate(items(spark), notes, "k"))) == 7
    clash = op.annotate(items(spark), notes.withColumnRenamed("note", "v"), "k")
    assert clash.columns == ["k", "v", "v_noted"] and clash.count() == 7
    both = op.integrate([items(spark), notes])
    assert both.columns == ["k", "v", "note"] and both.count() == 8
    assert rows(op.count_by(items(spark), "k")) == sorted([(1, 2), (2, 1), (None, 2)], key=repr)
    assert rows(op.classify_counts(items(spark), "k", notes.limit(3).dropDuplicates(["k"]).withColumn("note", F.lit("n")), "note")) == [("n", 2)]


def test_identify_and_profile(spark):
    assert rows(op.identify(items(spark), F.col("k") > 1)) == [(2, "a")]
    assert rows(op.profile(items(spark), ["k", "v"])) == [("k", 5, 2, 2, "1", "2"), ("v", 5, 1, 3, "a", "c")]
    assert rows(op.profile(items(spark, ()), ["k"])) == [("k", 0, 0, 0, None, None)]


def test_exclude_contained(spark):
    five = "one two three four five"
    docs = spark.createDataFrame([(1, "xx " + five + "yy"), (2, "one two\nthree four five"), (3, "a hi b"), (4, None), (5, ""), (None, five), (None, "clean"), (6, five), (6, "clean too"), (7, "a z"), (8, "aé😀x"), (9, "one  two"), (10, "x one two")], "id long, text string")
    probes = spark.createDataFrame([(five,), (five,), ("hi",), ("",), (None,), ("z",), ("é😀",), ("one two",)], "t string")
    want = sorted([(2,), (4,), (5,), (None,), (6,), (9,)], key=repr)
    clash = docs.withColumn("__run", F.lit(1)).withColumn("t", F.lit("hi"))
    for most in (1_000_000, 0):
        out = op.exclude_contained(clash, probes, "text", "t", most_broadcast=most)
        assert out.columns == clash.columns
        got = out.collect()
        # 2 has another white space inside; 10 and 1 contain a probe; of the rows with one key, or none, only those that contain one go.
        assert sorted(((r.id,) for r in got), key=repr) == sorted([w for w in want if w != (2,)], key=repr)
        assert {r.text for r in got if r.id in (None, 6)} == {"clean", "clean too"}
    assert op.exclude_contained(docs, probes.limit(0), "text", "t").count() == docs.count()
    assert op.exclude_contained(docs.limit(0), probes, "text", "t").count() == 0


def moved(df, but="no such node"):
    """Columns that Sort and Exchange nodes of the plan carry, outside of nodes of a kind."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    out, todo = set(), [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Sort" or node.nodeName().startswith("Exchange"):
            out |= {a.name() for a in (node.output().apply(i) for i in range(node.output().size()))}
        todo += [] if but in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_plans(spark, tmp_path):
    """Texts that stay are in no Sort and no Exchange, also if nothing may be broadcast but names."""
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "one two three four five six")], "id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert "Expand" not in docs._jdf.queryExecution().toString()
    assert "Expand" not in op.profile(docs, ["id", "text"])._jdf.queryExecution().toString()
    probes = docs.select(F.col("text").alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (op.exclude_contained(docs, probes, "text", "t"), op.exclude_similar(docs, probes, "text", "t")):
            assert moved(out) <= {"__name", "a", "b"} and "NestedLoop" not in out._jdf.queryExecution().toString()
        # Only where rows alike are put together, by an aggregate over just these, are texts moved.
        out = op.dedup_exact(docs, "text", "id")
        assert moved(out, "Aggregate") <= {"__name", "a", "b", "stays"}
        assert "stays" in str(out._jdf.queryExecution().optimizedPlan()).split("Aggregate")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedup_of_rows_alike(spark):
    rows = [(1, "a", 5), (1, "a", 5), (1, "a", 4), (2, "a", 0), (3, "b", 1), (3, "b", 1), (None, "c", 1), (None, "c", 2), (0, None, 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "k long, v string, n int").withColumn("__name", F.lit("x")).repartition(3)
    for most in (1_000_000, 0):
        out = op.dedup_exact(df, "v", "k", most)
        assert out.columns == df.columns
        got = sorted(((r.k, r.v, r.n) for r in out.collect()), key=repr)
        assert sorted((r[:2] for r in got), key=repr) == sorted([(1, "a"), (3, "b"), (None, "c"), (0, None), (0, None)], key=repr)
        assert all(r in rows for r in got)


def test_predict(spark):
    out = op.predict(items(spark), lambda: lambda x: pd.Series(x["k"].fillna(0) * 2.0), ["k"], "p", T.DoubleType())
    assert sorted(r.p for r in out.collect()) == [0.0, 0.0, 2.0, 2.0, 4.0]
    assert op.predict(items(spark, ()), lambda: lambda x: x["k"] * 1.0, ["k"], "p", T.DoubleType()).count() == 0
    for bad in (lambda: op.predict(items(spark), lambda: None, ["k"], "v", T.DoubleType()), lambda: op.count_by(items(spark).withColumnRenamed("k", "n_rows"), "n_rows"), lambda: op.classify_counts(items(spark), "k", items(spark), "n_rows")):
        with pytest.raises(ValueError):
            bad()


def test_files_and_streams(spark, tmp_path):
    src, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    write_table(items(spark), src)
    for _ in range(2):  # the second run has nothing new
        curate_available(spark, src, "k long, v string", lambda s: op.identify(s, F.col("k") == 1), sink, f"{tmp_path}/cp")
    assert rows(read_table(spark, sink, "k long, v string")) == [(1, "a"), (1, "b")]
