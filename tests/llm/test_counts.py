"""Phrases, token counts and clustering against brute force and the library."""

import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import centroids, phrases, queries, token_counts

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.Counter(MODEL)


# -- token counts

FREE = st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aetinsrothe=-_01日é😀'"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(FREE, max_size=5))
def test_counts_equal_the_library(texts):
    assert COUNTER.count(texts).tolist() == [len(x) for x in LIBRARY.encode(texts)]


def test_counts_of_odd_texts(monkeypatch):
    rng = random.Random(5)
    odd = ["", " ", "  ", "a▁b", "<s>x</s><unk>", "\x00", " " * 400, "=-" * 900, "日" * 700, "x" * 3000, "<0x41>", "﻿bom", "1" * 257, "a" * 256]
    odd += ["".join(rng.choice("etaoinshrldcum") for _ in range(n)) for n in (255, 256, 257, 4000)]
    odd += ["".join(rng.choice("=-_*#. /") for _ in range(200)) for _ in range(50)]
    want = [len(x) for x in LIBRARY.encode(odd)]
    assert COUNTER.count(odd).tolist() == want
    # Long texts go in parts, and a full memory starts anew.
    monkeypatch.setattr(token_counts, "PIECE", 8)
    monkeypatch.setattr(token_counts, "REMEMBERED", 4)
    texts = [*odd, "some words in a longer text, cut at will. " * 20, " " * 50 + "end"]
    assert token_counts.Counter(MODEL).count(texts).tolist() == [*want, *(len(x) for x in LIBRARY.encode(texts[-2:]))]


def test_a_long_pre_token_goes_the_same_way_by_rounds_and_by_heap(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("etaoinshr=-") for _ in range(rng.randint(2, 200))) for _ in range(200)]
    by_rounds = COUNTER.count(texts).tolist()
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert token_counts.Counter(MODEL).count(texts).tolist() == by_rounds == [len(x) for x in LIBRARY.encode(texts)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        token_counts.Merger(str(tmp_path / "m.model"))


def test_token_counts_of_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x y z"), (2, None), (3, ""), (4, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("key", F.lit(0))
    got = token_counts.count_tokens(df, "doc_id", "text", MODEL, 4096)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(df.limit(0), "doc_id", "text", MODEL, 4096).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_token_counts_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: (len(r.text.encode()), n := len(LIBRARY.encode(r.text)), n > 4096) for r in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, SF).collect()} == want


# -- phrases


def brute_phrases(rows, least, longest, most):
    words, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                words[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in words.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most])]
    return sorted(out)


def made_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "B", "x\x00y", "日本", "x\x1cy", "q\x85r", "l'a", "aa"]
    joints = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", "\x0b", ";"]
    texts = ["".join(rng.choice(vocabulary[: rng.choice((4, 8, 17))]) + rng.choice(joints) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "en", "en", "de", "und", None, ""]), t) for t in texts] + [("en", None), (None, ""), ("fr", " .\n, "), ("hot", "a a a a a a a a " * 40)] + [("cp", "one two three four five six")] * 30


@pytest.mark.parametrize(("least", "longest", "most"), [(3, 5, 2000), (8, 4, 7), (300, 2, 10)])
def test_phrases(spark, least, longest, most):
    rows = made_texts(least, 150)
    df = spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(1))
    got = phrases.collocations(df, "lang", "text", least, longest, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, least, longest, most)
    assert sorted(map(tuple, got.collect())) == want
    assert want or least == 300


def test_phrases_of_small_blocks_sketches_and_automata(spark, monkeypatch):
    """Everything collides, every text is cut, every automaton is full: the result is the same."""
    rows = made_texts(1, 60)
    sketches = phrases.sketches

    def tiny(*args):
        monkeypatch.setattr(phrases, "SMALLEST", 2)
        monkeypatch.setattr(phrases, "LARGEST", 2)
        return sketches(*args)

    monkeypatch.setattr(phrases, "sketches", tiny)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, "lang", "text", 3, 5, 50).collect())) == brute_phrases(rows, 3, 5, 50)
    text = "aa bb, cc aa bb aa bb. aa bb cc"
    monkeypatch.setattr(phrases, "AUTOMATON", 1)
    block = phrases.Block("en", [np.frombuffer(text.encode(), np.uint8)])
    guarded, _, _ = block.guarded()
    assert guarded == b" aa bb \n cc aa bb aa bb \n aa bb cc \n"
    assert phrases.count_matches(guarded.decode(), [" aa bb ", " aa ", " bb aa bb ", " a "]).tolist() == [4, 4, 1, 0]
    monkeypatch.setattr(phrases, "BLOCK", 7)
    parts = [p.tobytes().decode() for p in phrases._cut(np.frombuffer(text.encode(), np.uint8))]
    assert len(parts) > 1 and re.split(r"[.,]", text) == [x for p in parts for x in re.split(r"[.,]", p)]


def test_sketch_is_an_upper_bound():
    rng = np.random.default_rng(2)
    hashes = phrases.mix(rng.integers(0, 3000, 60_000).astype(np.uint64))
    sketch = phrases.Sketch(8, 15)
    for part in np.array_split(hashes, 7):
        sketch.add(part)
    values, n = np.unique(hashes, return_counts=True)
    assert sketch.passes(values[n >= 15]).all() and sketch.cells.max() == 15


def test_phrases_of_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty, "lang", "text").count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b"), (None, None)], empty.schema), "lang", "text", 2).count() == 0


def test_scores_are_exact(spark):
    """Products of more than 64 bits."""
    big = spark.createDataFrame([(10**13 + 7, 3 * 10**14 + 1, 10**13 + 9, 10**13 + 7)], "a long, n long, l long, r long")
    wide = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    assert big.select(F.call_function("div", wide("a", 17) * (wide("n", 17) * F.lit(1000).cast("decimal(4,0)")), wide("l", 19) * wide("r", 19)).alias("s")).first().s == 1000 * (10**13 + 7) * (3 * 10**14 + 1) // ((10**13 + 9) * (10**13 + 7))


# -- clustering


def brute_lloyd(rows, size, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (brute.sha(f"{seed}:{'' if r[0] is None else r[0]}"), np.array(r[1], "<i4").tobytes()))
    centers = [list(v) for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds if centers else 0):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for j, m in members.items():
            centers[j] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), brute.sha(",".join(map(str, centers[c])))) for i, c, d in out), key=repr)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(0, 1, 4) + 3 * (i % 3)).tolist()) for i in range(n)]
    same = [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (None, [0.0, -0.0, 1e-9, -1e-9])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, math.nan, 2.0, 3.0]), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [0.0] * 5)]
    return rows + same + odd + [(1000 + i, [7.0, 7.0, 7.0, 7.0]) for i in range(n // 2)]


@pytest.mark.parametrize(("n", "k"), [(60, 5), (3, 8), (2, 2)])
def test_clusters(spark, n, k):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("whole", F.lit(1)).repartition(5)
    got = centroids.with_inertia(*centroids.cluster(df, "vec_id", "embedding", 4, k, 4, 16, 3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lloyd(rows, 4, k, 4, 16, 3)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.with_inertia(*centroids.cluster(empty, "vec_id", "embedding", 4)).count() == 0
    assert centroids.with_inertia(*centroids.cluster(empty.limit(0), "vec_id", "embedding", 4)).count() == 0
    large = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(large, "vec_id", "embedding", 2)


def test_nearest_takes_the_lowest_number():
    best, distance = centroids.nearest(np.array([[0, 0], [4, 0], [2, 0]]), np.array([[4, 0], [0, 0], [0, 0]]))
    assert best.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 4]
