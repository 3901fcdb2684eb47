"""The pipeline's stages, each on its own input, against brute force; and all together."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_texts import EDGE, family, fixture
from test_tokens import check_packed

from millrace.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with near copies, passages, nulls in every column, repeated rows and a clashing column."""
    made = family(1, 20, 80) + [t for _, t in fixture(3) if t]
    rows = [(10_000 + i, t, "en", "made", len(t)) for i, t in enumerate(made)] + [(20_000 + i, t, None, None, None) for i, t in EDGE]
    rows += [(30_000, made[0], None, "x", 1)] * 2 + [(None, "a text without a key", "en", None, None)]
    own = spark.read.parquet(f"{SF}/documents.parquet")
    return own.unionByName(spark.createDataFrame(rows, own.schema)).withColumn("key", F.lit("clash")).withColumn("kept", F.lit(1)).cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "packing"]


def test_quality_rules(spark, docs):
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    model = quality.fit(docs.select("doc_id", "text"), "doc_id", "text", spark.read.parquet(f"{SF}/labels.parquet"), F.col("quality") == 1)
    want = []
    scored = {}
    for r in quality.score(docs, {"doc_id": F.col("doc_id"), "body": F.col("text")}, "text", model).collect():
        scored[(r.doc_id, r.body)] = r.score
    for r in docs.select(*corpus_pipeline.COLUMNS).collect():
        n = brute.quality_counts(r.text)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and scored[(r.doc_id, r.text)] >= model.threshold:
            want.append(tuple(r))
    assert as_rows(out) == sorted(want, key=repr)


def test_near_duplicates(spark, docs):
    docs = docs.filter("doc_id IS NOT NULL AND doc_id <> 30000")
    want = brute.near_duplicates(pairs(docs), 5, 80)
    got = as_rows(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert got == as_rows(docs.filter(F.col("doc_id").isin([i for i, (_, c) in want.items() if c == i])))


def test_near_duplicates_of_rows_alike(spark, docs):
    some = docs.filter("doc_id = 30000 OR doc_id IS NULL")
    out = corpus_pipeline.near_duplicates(spark, some.unionByName(some), SF).collect()
    assert sorted((str(r.doc_id), r.text[:6]) for r in out) == sorted({("30000", r.text[:6]) for r in out if r.doc_id} | {("None", "a text")}) and len(out) == 2


def test_substring_dedup(spark, docs):
    docs = docs.filter("doc_id IS NOT NULL AND doc_id <> 30000")
    out = corpus_pipeline.substring_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id, brute.sha(" ".join(brute.WORDS.findall(r.text or "")))) for r in out) == [(i, s) for i, _, _, s in brute.repeated_words(pairs(docs), 20)]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_packing(spark, docs):
    docs = docs.filter("doc_id IS NOT NULL AND doc_id <> 30000")
    assert check_packed(corpus_pipeline.pack(spark, docs, SF).collect(), pairs(docs), 4096) < 0.1


def test_run_from_end_to_end(spark):
    """The packed tokens are those of the texts that brute force leaves, stage after stage."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = dict(pairs(table))
    model = quality.fit(table.select("doc_id", "text"), "doc_id", "text", spark.read.parquet(f"{SF}/labels.parquet"), F.col("quality") == 1)
    scores = {r.doc_id: r.score for r in quality.score(table, {"doc_id": F.col("doc_id")}, "text", model).collect()}
    counts = {i: brute.quality_counts(t) for i, t in docs.items()}
    good = {i for i, n in counts.items() if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and scores[i] >= model.threshold}
    alone = {i for i, (_, c) in brute.near_duplicates([(i, docs[i]) for i in good], 5, 80).items() if c == i}
    left = brute.without_repeated_words([(i, docs[i]) for i in alone], 20)
    assert 0 < len(alone) < len(good) < len(docs) and left != {i: docs[i] for i in alone}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check_packed(rows, sorted(left.items()), 4096) < 0.1
    assert {r.doc_id for r in rows} == alone


def test_every_stage_on_an_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
