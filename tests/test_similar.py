"""Similarity joins and redundancy removal against brute force: every pair compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import exclude_similar, representatives, similar
from millrace.sources import Workspace


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(seed, n, vocabulary=40):
    """Families of close texts, repeated words, short ones, copies, and texts of frequent words alone."""
    rng = random.Random(seed)
    word = lambda: "w%d" % min(rng.randrange(vocabulary), rng.randrange(vocabulary))
    out = []
    while len(out) < n:
        first = [word() for _ in range(rng.choice((1, 2, 5, 12, 20, 40)))]
        for _ in range(rng.choice((1, 1, 2, 6, 15))):
            own = list(first)
            for _ in range(rng.randint(0, max(1, len(own) // 6))):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice((0, 0, 1, 1))] = [word()] if rng.random() < 0.6 else []
            out.append(rng.choice((" ", "  ", "\n")).join(own))
    return out[:n]


def test_edits_equal_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(400):
        a = rng.integers(0, 4, rng.integers(0, 14))
        b = a.copy() if rng.random() < 0.3 else rng.integers(0, 4, rng.integers(0, 14))
        want = distance(a.tolist(), b.tolist())
        for most in (0, 1, 3, 20):
            assert similar.edits(a, b, most) == min(want, most + 1)


@pytest.mark.parametrize("percent", [80, 50, 100])
@pytest.mark.parametrize("cell", [3, 1 << 12])
def test_exclude_similar(spark, monkeypatch, percent, cell):
    monkeypatch.setattr(similar.split_join, "__defaults__", (cell,))
    monkeypatch.setattr(similar, "FREQUENT", 10 if cell == 3 else 1 << 16)
    rows = [*enumerate(texts(percent, 220)), (None, "w1 w2"), (5, None), (6, ""), (7, " \n"), (5, "w9 w9 w8")]
    others = texts(percent, 260)[150:] + [None, "", " ", "w8 w9"]
    sets = [set(t.split()) for t in others if t and t.split()]
    near = lambda t: any(100 * len(s & set((t or "").split())) >= percent * len(s | set((t or "").split())) for s in sets) and bool((t or "").split())
    df = spark.createDataFrame(rows, "k long, text string").withColumn("id", F.lit("clash")).withColumn("tokens", F.lit(1)).withColumn("__l", F.lit(2))
    other = spark.createDataFrame([(t,) for t in others], "t string")
    for most in (1_000_000, 0):
        out = exclude_similar(df, other, "text", "t", percent, most)
        assert out.columns == df.columns
        assert sorted(((r.k, r.text) for r in out.collect()), key=repr) == sorted(((k, t) for k, t in rows if not near(t)), key=repr)


def test_exclude_similar_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k long, text string")
    assert exclude_similar(df, df.limit(0), "text", "text").count() == 2
    assert exclude_similar(df.limit(0), df, "text", "text").count() == 0
    with pytest.raises(ValueError):
        exclude_similar(df, df, "text", "text", 0)


def greedy(rows, percent):
    """Keys of the representatives, longest first."""
    close = lambda a, b: 100 * (max(len(a), len(b)) - distance(a, b)) >= percent * max(len(a), len(b))
    out = []
    for _, t in sorted({(k, tuple((t or "").split())) for k, t in rows if (t or "").split()}, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        if not any(close(t, o) for _, o in out):
            out.append((_, t))
    return out


@pytest.mark.parametrize(("percent", "rounds"), [(90, 3), (75, 3), (75, 0), (50, 1), (100, 3)])
def test_representatives(spark, monkeypatch, percent, rounds):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    rows = [*enumerate(texts(percent + rounds, 150)), (None, "w1 w2 w3"), (None, "w3 w1 w7 w7 w7 w7"), (900, None), (901, ""), (None, " ")]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).repartition(7)
    out = representatives(df, "k", "text", percent)
    assert out.columns == ["k", "representative", "identity"]
    got = out.collect()
    want = greedy(rows, percent)
    with_words = [(k, tuple(t.split())) for k, t in rows if t and t.split()]
    assert len(got) == len(rows)
    by_key = {k: t for k, t in with_words if k is not None}
    reps = {k for k, _ in want}
    assert {r.representative for r in got if r.k is None or r.k in by_key} - {None} == reps - {None}
    for r in got:
        if r.k is None:
            continue
        if r.k not in by_key:
            assert r.representative == r.k and r.identity == 1.0
        elif r.representative is not None:
            a, b = by_key[r.k], by_key[r.representative]
            assert r.representative in reps and r.identity == pytest.approx(1 - distance(a, b) / max(len(a), len(b))) and 100 * r.identity >= percent - 1e-9
    assert all(r.representative == r.k for r in got if r.k in reps and r.k is not None)


def test_representatives_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "k long, text string")
    assert representatives(df.limit(0), "k", "text").count() == 0
    assert sorted(map(tuple, representatives(df, "k", "text").collect())) == [(1, 1, 1.0), (1, 1, 1.0), (2, 2, 1.0)]


def test_a_workspace_clears_up(spark):
    from pathlib import Path

    df = spark.range(3)
    with pytest.raises(RuntimeError), Workspace(spark) as work:
        work.keep(df, "gone")
        path = Path(work._paths[0].removeprefix("file://"))
        assert path.exists()
        raise RuntimeError
    assert not path.exists()
    with Workspace(spark) as work:
        kept = work.result(work.keep(df, "gone").filter("id > 0"), "stays")
    assert kept.count() == 2
    with Workspace(spark) as work:
        early, late = work.keep(df, "early"), work.keep(df, "late")
        path = Path(work._paths[0].removeprefix("file://"))
        work.drop(early)
        assert not path.exists() and late.count() == 3


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(60)] + [(None, 1)], "k long, a long")
    right = spark.createDataFrame([(i % 4, i) for i in range(40)] + [(None, 2)], "k long, b long")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert sorted(map(tuple, similar.split_join(left, right, ["k"], 4).select("k", "a", "b").collect())) == want


@pytest.mark.parametrize("percent", [80, 60])
def test_similar_groups(spark, percent):
    data = [*enumerate(texts(percent + 1, 200)), (None, "w1 w2 w3"), (900, None), (901, ""), (None, " ")]
    data += [(1000 + i, data[0][1]) for i in range(40)]
    df = spark.createDataFrame(data, "k long, text string").withColumn("group_id", F.lit("clash")).repartition(6)
    out = similar.similar_groups(df, "k", "text", percent)
    assert out.columns == ["k", "group_id"]
    sets = [(k, frozenset((t or "").split())) for k, t in data]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, s) in enumerate(sets):
        if s and k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    want = [(k, least.get(root(i)) if s else k) for i, (k, s) in enumerate(sets)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert similar.similar_groups(df.limit(0), "k", "text").count() == 0


def test_only_prefixes_of_sets_are_written(spark, monkeypatch):
    # Words of one text alone are in no prefix row, so what is written is a fraction of the words.
    rng = random.Random(4)
    data = [(i, " ".join("w%d" % (rng.randrange(300) if j % 4 == 0 else 1000 * (i + 1) + j) for j in range(200))) for i in range(60)]
    data += [(100 + i, t.replace(" ", "  ", 3) + " more") for i, t in data[:6]]
    kept, keep = [], Workspace.keep

    def noted(self, df, name):
        out = keep(self, df, name)
        kept.append((name, sum(out.select(F.sum(F.size(c))).first()[0] or 0 for c, kind in out.dtypes if kind == "array<bigint>")))
        return out

    monkeypatch.setattr(Workspace, "keep", noted)
    got = {r.k: r.group_id for r in similar.similar_groups(spark.createDataFrame(data, "k long, text string"), "k", "text", 80).collect()}
    assert got == {k: k - 100 if k >= 100 else k for k, _ in data}
    assert sum(n for _, n in kept) < 0.5 * sum(len(set(t.split())) for _, t in data)


def scattered(n=150, words=30, pool=400):
    """Texts that have a word in common with many others, and a few near copies of the first ones."""
    rng = random.Random(11)
    data = [(i, " ".join("p%d" % w for w in rng.sample(range(pool), words))) for i in range(n)]
    return data + [(1000 + i, t + " more%d" % i) for i, t in data[:5]]


def counted_pairs(monkeypatch):
    """Numbers of different pairs that go to the comparison."""
    got, bounded = [], similar._bounded

    def noted(work, pairs, *more):
        got.append(pairs.select("x_id", "y_id").distinct().count())
        return bounded(work, pairs, *more)

    monkeypatch.setattr(similar, "_bounded", noted)
    return got


@pytest.mark.parametrize("query", ["similar_groups", "exclude_similar", "representatives"])
def test_texts_with_one_word_in_common_make_no_pair(spark, monkeypatch, query):
    got, data = counted_pairs(monkeypatch), scattered()
    df = spark.createDataFrame(data, "k long, text string").repartition(3)
    near = {k: k - 1000 if query == "similar_groups" else k for k, _ in data if k >= 1000}
    if query == "similar_groups":
        out = {r.k: r.group_id for r in similar.similar_groups(df, "k", "text", 80).collect()}
        assert out == {k: near.get(k, k) for k, _ in data}
    elif query == "representatives":
        out = {r.k: r.representative for r in representatives(df, "k", "text", 90).collect()}
        assert out == {k: k + 1000 if k < 5 else k for k, _ in data}
    else:
        out = exclude_similar(df.filter("k < 1000"), df.filter("k >= 20"), "text", "text", 80)
        assert sorted(r.k for r in out.collect()) == list(range(5, 20))
    assert sum(got) <= 150


def test_bands_that_are_wrong_change_nothing(spark, monkeypatch):
    # Every text is put aside with the one before it if they are close, whether that one becomes a representative or not.
    monkeypatch.setattr(similar, "_in_bands", lambda x, y, measure, percent: x.select(F.col("id").alias("x_id"), (F.col("id") - 1).alias("y_id"), F.lit(0).alias("need")).filter("y_id >= 0"))
    words = ["a%d" % i for i in range(20)]
    chain = [" ".join(["b%d" % i for i in range(step)] + words[step:]) for step in range(0, 9)]
    data = [*enumerate(chain), *((100 + i, t) for i, t in enumerate(texts(3, 60)))]
    out = representatives(spark.createDataFrame(data, "k long, text string").coalesce(1), "k", "text", 90).collect()
    assert {r.representative for r in out} == {k for k, _ in greedy(data, 90)}


def test_tokens_of_many_rows_are_met_in_cells(spark, monkeypatch):
    data = [*enumerate(texts(8, 120, 12))]
    df = spark.createDataFrame(data, "k long, text string")
    want = sorted(map(tuple, similar.similar_groups(df, "k", "text", 70).collect()))
    seen, split = [], similar.split_join

    def noted(left, right, on, **more):
        out = split(left, right, on, 4, **more)
        seen.append((out.count(), left.alias("l").join(right.alias("r"), on).count(), left.filter(more["often"][0]).count()))
        return out

    monkeypatch.setattr(similar, "CELL", 4)
    monkeypatch.setattr(similar, "split_join", noted)
    assert sorted(map(tuple, similar.similar_groups(df, "k", "text", 70).collect())) == want
    assert all(a == b for a, b, _ in seen) and sum(n for *_, n in seen)


@pytest.mark.parametrize("query", ["evaluation_split", "evaluate_model"])
def test_queries_on_groups_make_few_pairs(spark, monkeypatch, tmp_path, query):
    from millrace.plans import QUERIES

    data = scattered()
    docs = [(k, t, "en", "web", len(t)) for k, t in data]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k, _ in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = counted_pairs(monkeypatch)
    out = QUERIES[query](spark, str(tmp_path)).collect()
    if query == "evaluation_split":
        fold = {r.doc_id: r.fold for r in out}
        assert len(fold) == len(data) and all(fold[k] == fold[k - 1000] for k in fold if k >= 1000)
    else:
        assert len(out) == 1 and out[0].n_pos and out[0].n_neg
    assert sum(got) <= 150
