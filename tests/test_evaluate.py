"""Folds, ranking metrics, as-of and interval joins against plain loops."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import operators as op
from millrace.operators import evaluate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- folds


def test_folds_keep_groups_and_spread_labels(spark):
    rng = random.Random(1)
    data = []
    for g in range(900):
        # A few groups hold a third of all rows; the rare label is one in twenty.
        for _ in range(rng.choice((1, 1, 2, 3)) if g > 12 else 60):
            data.append((g, int(rng.random() < 0.05), len(data)))
    data += [(None, 1, -1), (None, 0, -2), (7, None, -3)]
    df = spark.createDataFrame(data, "group_id long, y int, id long").repartition(4)
    out = op.split_folds(df, "group_id", "y", 5)
    assert out.columns == ["group_id", "y", "id", "fold"]
    got = out.collect()
    assert sorted((r.id for r in got)) == sorted(r[2] for r in data)
    folds = defaultdict(set)
    for r in got:
        folds[r.group_id].add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    for y, least in ((0, 0.15), (1, 0.08)):
        n = Counter(r.fold for r in got if r.y == y)
        assert all(n[i] > least * sum(n.values()) for i in range(5)), n
    # Small groups keep their folds when rows come.
    more = op.split_folds(df.unionByName(spark.createDataFrame([(5000 + i, 0, i) for i in range(400)], df.schema)), "group_id", "y", 5).collect()
    small = {r.group_id: r.fold for r in more}
    assert all(small[g] == next(iter(f)) for g, f in folds.items() if g is not None and g > 12)


def test_folds_of_odd_inputs(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0)], "group_id long, fold int")
    with pytest.raises(ValueError):
        op.split_folds(df, "group_id", "fold", 2)
    assert op.split_folds(df.limit(0), "group_id", "fold", 2, "part").count() == 0
    monkeypatch.setattr(evaluate, "MOST_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        op.split_folds(df.unionByName(df.withColumn("fold", F.lit(1))), "group_id", "fold", 2, "part")


# -- metrics


def plain_metrics(data):
    data = [(s, bool(y)) for s, y in data if s is not None and not math.isnan(s) and y is not None]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    v = lambda a, b: (a > b) + (a == b) / 2
    ap, up = 0.0, 0
    for t in sorted(set(pos), reverse=True):
        up = sum(s >= t for s in pos)
        ap += sum(s == t for s in pos) / len(pos) * up / (up + sum(s >= t for s in neg))
    bins = defaultdict(list)
    for s, y in data:
        bins[min(max(math.floor(s * 10), 0), 9)].append(s - y)
    error = sum(abs(sum(b)) for b in bins.values()) / len(data) if data else None
    if not pos or not neg:
        return len(pos), len(neg), None, None, None, ap if pos else None, error
    of_pos, of_neg = [sum(v(a, b) for b in neg) / len(neg) for a in pos], [sum(v(a, b) for a in pos) / len(pos) for b in neg]
    auc = sum(of_pos) / len(pos)
    var = (sum(x * x for x in of_pos) / len(pos) - auc**2) / len(pos) + (sum(x * x for x in of_neg) / len(neg) - auc**2) / len(neg)
    half = 1.959963984540054 * math.sqrt(max(var, 0))
    return len(pos), len(neg), auc, max(0, auc - half), min(1, auc + half), ap, error


@pytest.mark.parametrize("cells", [1, 3, 1024])
def test_ranking_metrics(spark, cells):
    rng = random.Random(cells)
    data = [(rng.choice((rng.random(), rng.randrange(10) / 10, -1.0, 2.0)), rng.choice((0, 1, 1))) for _ in range(250)]
    data += [(None, 1), (math.nan, 0), (0.5, None), (0.5, 1)]
    df = spark.createDataFrame(data, "score double, y int").withColumn("pos", F.lit("clash")).repartition(3)
    got = op.ranking_metrics(df, "score", "y", cells).first()
    assert got.asDict().keys() == dict.fromkeys(["n_pos", "n_neg", "auc", "auc_low", "auc_high", "average_precision", "calibration_error"]).keys()
    assert tuple(got) == pytest.approx(plain_metrics(data), abs=2e-9)


@pytest.mark.parametrize("data", [[], [(0.1, 1)], [(0.1, 0), (0.2, 0)], [(0.9, 1), (0.1, 0)], [(0.5, 1), (0.5, 0)]])
def test_ranking_metrics_of_few_rows(spark, data):
    got = tuple(op.ranking_metrics(spark.createDataFrame(data, "score double, y int"), "score", "y").first())
    want = plain_metrics(data)
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], abs=2e-9)


# -- joins


def moment(s):
    return None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize(("slice_seconds", "tolerance"), [(1, None), (50, None), (50, 30), (10**6, 0)])
def test_as_of(spark, slice_seconds, tolerance):
    rng = random.Random(slice_seconds)
    time = lambda: rng.choice((None, *range(-300, 300)))
    left = [(i, rng.choice((1, 1, 1, 2, None)), time()) for i in range(120)] + [(0, 1, 5), (0, 1, 5)]
    right = [(rng.choice((1, 1, 1, 3, None)), time(), rng.randrange(5)) for _ in range(60)] + [(1, 5, 9), (1, 5, 1), (1, 5, None)]
    a = spark.createDataFrame([(i, k, moment(t)) for i, k, t in left], "id long, k int, ts timestamp_ntz")
    b = spark.createDataFrame([(k, moment(t), v) for k, t, v in right], "k int, ts timestamp_ntz, v int").repartition(3)
    got = op.as_of(a, b, "ts", ["k"], slice_seconds, tolerance)
    assert got.columns == ["id", "k", "ts", "ts_right", "v_right"]
    want = []
    for i, k, t in left:
        found = max(((u, v is not None, v or 0, v) for q, u, v in right if None not in (k, t, q, u) and q == k and u <= t and (tolerance is None or t - u <= tolerance)), default=None, key=lambda x: x[:3])
        want.append((i, k, moment(t), moment(found[0]) if found else None, found[3] if found else None))
    assert rows(got) == sorted(want, key=repr)
    assert op.as_of(a.limit(0), b, "ts", ["k"], 5).count() == 0
    assert all(r.v_right is None for r in op.as_of(a, b.limit(0), "ts", ["k"], 5).collect())
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="already"):
        op.as_of(a.withColumn("v_right", F.lit(1)), b, "ts", ["k"], 5)


@pytest.mark.parametrize("bins", [1, 4, 300, 2000])
def test_in_interval(spark, bins):
    rng = random.Random(bins)
    points = [(i, rng.choice((1, 2, None)), rng.choice((None, rng.uniform(-5, 105), float(rng.randrange(100))))) for i in range(300)]
    spans = [(i, rng.choice((1, 2, None)), float(rng.randrange(100)), None) for i in range(80)]
    spans = [(i, k, lo, rng.choice((None, lo, lo - 1, lo + rng.choice((0.5, 1, 3, 40, 200))))) for i, k, lo, _ in spans] + [(99, 1, None, 5.0), (100, 1, -1e9, 1e9)]
    a = spark.createDataFrame(points, "p long, k int, x double")
    b = spark.createDataFrame(spans, "s long, k int, lo double, hi double")
    got = op.in_interval(a, b, "x", "lo", "hi", ("k",), bins)
    inside = lambda x, lo, hi: None not in (x, lo, hi) and lo <= x < hi
    assert rows(got.select("p", "s")) == sorted(((p, s) for p, k, x in points for s, q, lo, hi in spans if k is not None and k == q and inside(x, lo, hi)), key=repr)
    assert set(got.columns) == {"k", "p", "x", "s", "lo", "hi"}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    everything = op.in_interval(a.drop("k"), b.drop("k"), "x", "lo", "hi", (), bins)
    assert rows(everything.select("p", "s")) == sorted(((p, s) for p, _, x in points for s, _, lo, hi in spans if inside(x, lo, hi)), key=repr)
    assert op.in_interval(a.limit(0), b, "x", "lo", "hi", ("k",)).count() == 0 == op.in_interval(a, b.limit(0), "x", "lo", "hi", ("k",)).count()
    with pytest.raises(ValueError, match="both sides"):
        op.in_interval(a, b, "x", "lo", "hi")


# -- a model


def test_linear_model(spark, tmp_path):
    rng = random.Random(3)
    data = [(1e6 + rng.random(), rng.randrange(5), 7.0) for _ in range(200)]
    data = [(a, b, c, 3 * a - 2 * b + 5) for a, b, c in data] + [(None, 1, 7.0, 1.0), (1e6, 1, math.nan, 1.0)]
    df = spark.createDataFrame(data, "a double, b int, c double, y double").repartition(4)
    model = op.fit_linear(df, ["a", "b", "c"], "y")
    assert model["weights"] == pytest.approx([3, -2, 0], abs=1e-4)
    op.save_model(spark, model, f"{tmp_path}/model")
    assert op.load_model(spark, f"{tmp_path}/model") == model
    out = op.predict(df, op.linear_model(model), ["a", "b", "c"], "p", T.DoubleType()).collect()
    assert all(r.p == pytest.approx(r.y, abs=1e-2) for r in out if r.a is not None and r.c is not None) and sum(r.p is None for r in out) == 2
    assert op.fit_linear(df.limit(0), ["a", "b"], "y") == {"inputs": ["a", "b"], "weights": [0.0, 0.0], "bias": 0.0}


@pytest.mark.parametrize("cells", [1, 5, 1024])
def test_interval_summary(spark, cells):
    import random

    from millrace.operators import interval_summary

    rng = random.Random(cells)
    points = [(i, rng.choice((float(rng.randrange(40)), rng.random() * 900))) for i in range(700)] + [(-1, None), (-2, float("nan"))]
    rng.shuffle(points)
    ends = [None, float("nan"), 0.0, 3.0, 3.5, 17.0, -5.0, 2000.0] + [rng.random() * 900 for _ in range(20)]
    intervals = [(k, rng.choice(ends), rng.choice(ends)) for k in range(200)]
    out = interval_summary(spark.createDataFrame(points, "i long, v double").repartition(5), spark.createDataFrame(intervals, "k long, a double, b double"), "v", "i", "a", "b", cells)
    inside = lambda a, b: [i for i, v in points if None not in (a, b, v) and a <= v < b]
    got = {r.k: (r.n_points, r.least_point) for r in out.collect()}
    assert got == {k: (len(inside(a, b)), min(inside(a, b), default=None)) for k, a, b in intervals}
    # Every point lies in every interval: pairs would be 2.5e9.
    many = interval_summary(spark.range(50_000).select("id", F.col("id").alias("v")), spark.range(50_000).select("id", (-F.col("id")).alias("a"), (F.col("id") + 50_000).alias("b")).withColumnRenamed("id", "k"), "v", "id", "a", "b", cells)
    assert many.agg(F.min("n_points"), F.max("n_points"), F.max("least_point"), F.count("k")).first() == (50_000, 50_000, 0, 50_000)
