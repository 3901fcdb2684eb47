"""Quality rules: counts that a rule can look at, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over
the buckets are estimated: one from every document of the corpus, one from trusted
documents. A document's score is the log-likelihood ratio of its n-grams, divided by
their number; it is kept if the score reaches a threshold, which is a fixed function of the
scores of labelled documents. Nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.hashing import U, gram_hashes, word_bounds, word_hashes
from millrace.llm.repeats import split_by, text_key
from millrace.llm.tables import pieces
from millrace.llm.tables import keep as keep_table

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BITS = 16
_PIECE = 1 << 20


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a run of texts' words, then of their pairs; a bucket of -1 for pairs over the end of a text."""
    one = (words >> U(64 - BITS)).astype(np.int64)
    two = (gram_hashes(words, 2) >> U(64 - BITS)).astype(np.int64)
    ends = first[1:-1] - 1
    two[ends[(ends >= 0) & (ends < len(two))]] = -1
    return one, np.append(two, -1)[: len(words)]


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lo, hi, first = word_bounds(data, at)
    return lo, hi, first, word_hashes(data, lo, hi)


def gram_counts(df: DataFrame, text: str) -> np.ndarray:
    """Count of each bucket over all texts. A task sends on one row per bucket at most; 2**BITS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, data, at in pieces(batch, "text", _PIECE):
                _, _, first, words = _hashed(data, at)
                one, two = grams(words, first)
                total += np.bincount(one, minlength=1 << BITS) + np.bincount(two[two >= 0], minlength=1 << BITS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


@dataclass
class LikelihoodRatio:
    """Log-ratio of each bucket and the least score that is kept."""

    ratio: np.ndarray
    threshold: float

    @staticmethod
    def of(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
        p, q = target + smooth, raw + smooth
        return np.log(p / p.sum()) - np.log(q / q.sum())

    @staticmethod
    def scores(ratio: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean log-ratio of each text's n-grams; 0 without words."""
        one, two = grams(words, first)
        each, out = ratio[one] + np.where(two >= 0, ratio[two], 0.0), np.zeros(len(first) - 1)
        full = np.flatnonzero(np.diff(first))
        if len(full):  # each text is summed up by itself, so its score does not depend on its neighbours
            start = first[full]
            out[full] = np.add.reduceat(each, start) / np.add.reduceat(1 + (two >= 0), start)
        return out


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, good: Column, most_broadcast: int = 1_000_000) -> LikelihoodRatio:
    """The model: raw counts from all of ``df``, target counts from all trusted documents of one half, the threshold from all labelled documents of the other.

    ``labels`` has the key and whatever ``good`` looks at; a key with several labels is good if all are. The key's hash deals labels to
    halves, so no document is scored by its own counts. Texts of the first half's good keys are found through a bit filter and a
    join, which broadcasts the labels if there are ``most_broadcast`` or fewer, else shuffles these texts. Those of the second half are found alike, scored, and counted by score. Without
    good labels the target is the raw corpus, and every score is 0 and kept.

    The threshold: between the scores of good and other documents, the one that makes the sum of
    the two error rates least, with an error on good documents counted ten times.
    """
    raw = gram_counts(df, text)
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(good.cast("int")).alias("good"))
    known = keep_table(known.withColumn("half", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(2))).withColumn("tie", F.lit(0)).withColumn("id", text_key()), "labels")
    rows = df.select(F.col(key).alias("key"), F.lit(0).alias("tie"), F.col(text).alias("text"))

    def texts(wanted: DataFrame) -> DataFrame:
        inside, _ = split_by(rows, wanted)
        named = wanted.select("key", "good")
        return inside.join(F.broadcast(named) if wanted.count() <= most_broadcast else named, "key").select("text", "good")

    target = gram_counts(texts(known.filter("good = 1 AND half = 0")), "text")
    if not target.sum():
        return LikelihoodRatio(np.zeros(1 << BITS), 0.0)
    ratio = LikelihoodRatio.of(target.astype(float), raw.astype(float))
    held = score(texts(known.filter("half = 1")), {"good": F.col("good")}, "text", LikelihoodRatio(ratio, 0.0)).filter("n_words > 0").select("good", "score")
    return LikelihoodRatio(ratio, _threshold(keep_table(held, "held")))


def _threshold(held: DataFrame, cells: int = 1024) -> float:
    """The best cut between different scores of rows (good: 1 or 0, score); of equally good ones the lowest.

    Rows are counted by score first. Scores are dealt to ``cells`` by quantiles, whose totals are summed up from the lowest, and only within a cell
    are scores sorted: a row for each cell and the best cut reach the driver.
    """
    each = keep_table(held.groupBy("score").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")), "scores")
    all_ = each.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("score").alias("least"), F.percentile_approx("score", [i / cells for i in range(1, cells)], 10_000).alias("cuts")).first()
    if not all_.g or not all_.b:
        return -np.inf if all_.least is None else all_.least - 1.0
    cuts = sorted(set(all_.cuts or []))
    line = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = each.withColumn("cell", F.size(F.filter(line, lambda x: x < F.col("score"))))
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # over ``cells`` rows at most
    totals = placed.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("score").alias("last"))
    totals = totals.select("cell", *[F.coalesce(f.over(before), o).alias(n) for n, f, o in (("g0", F.sum("g"), F.lit(0)), ("b0", F.sum("b"), F.lit(0)), ("below0", F.max("last"), F.lit(None)))])
    own = W.partitionBy("cell").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda n: F.col(f"{n}0") + F.coalesce(F.sum(n).over(own), F.lit(0))
    # A cut lies before each score, between it and the one below.
    cuts = placed.join(F.broadcast(totals), "cell").select("score", upto("g").alias("lost"), upto("b").alias("out"), F.coalesce(F.max("score").over(own), "below0").alias("below"))
    cost = 10 * F.col("lost") / F.lit(float(all_.g)) + (F.lit(float(all_.b)) - F.col("out")) / F.lit(float(all_.b))
    best = cuts.agg(F.min(F.struct(cost.alias("cost"), "score", "below")).alias("m")).first().m
    return ((best.score - 1.0 if best.below is None else best.below) + best.score) / 2


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(df: DataFrame, keep: dict[str, Column], text: str, model: LikelihoodRatio) -> DataFrame:
    """One row per document: the columns of ``keep``, the counts of a whole text, and ``score``.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of SYMBOLS; ``n_dup_lines``: lines
    with a word that equal an earlier line; ``n_repeat_words``: words in 3-word windows that the text has
    twice or more, the first included. Null texts have no words; repeated rows are scored each for itself.
    """
    rows = df.select(*[v.alias(k) for k, v in keep.items()], F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model.ratio)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for part, data, at in pieces(batch, "text", _PIECE):
                lo, hi, first, words = _hashed(data, at)
                out = [pa.array(c, pa.int64()) for c in (np.diff(first), *_counts(data, at, lo, hi, first, words))]
                out.append(pa.array(LikelihoodRatio.scores(ratio, words, first)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + out, names=[*names, *_COUNTS, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, ", ".join([kinds, *(f"{c} long" for c in _COUNTS), "score double"]))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])


def _counts(data, at, lo, hi, first, words):
    lead = (data & 0xC0) != 0x80
    blank = np.zeros(256, bool)
    blank[[0x20, 9, 10, 11, 12, 13]] = True
    word_chars = _sums(lead & ~blank[data], at)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = _sums(symbol[data], at)
    return word_chars, n_symbols, _dup_lines(data, at, lo), _repeat_words(words, first)


def _repeats(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over (owner, key) rows in order: equal to an earlier one; equal to any other one."""
    order = np.lexsort((keys, owner))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return later, twice


def _dup_lines(data, at, lo):
    """Lines are what stands between line feeds; they count if a word begins in them."""
    cut = np.union1d(np.flatnonzero(data == 10) + 1, at[:-1])
    cut = cut[cut < len(data)]
    if not len(cut):
        return np.zeros(len(at) - 1, np.int64)
    end = np.append(cut[1:], len(data))
    end = end - ((data[end - 1] == 10) & (end > cut))
    full = np.searchsorted(lo, end) > np.searchsorted(lo, cut)
    cut, end = cut[full], end[full]
    owner = np.searchsorted(at, cut, "right") - 1
    later, _ = _repeats(owner, word_hashes(data, cut, end))
    return np.bincount(owner[later], minlength=len(at) - 1)


def _repeat_words(words, first):
    g = gram_hashes(words, 3)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(owner[2:] == owner[:-2]) if len(g) else np.empty(0, np.int64)
    _, twice = _repeats(owner[start], g[start])
    hit = np.zeros(len(words), bool)
    for j in range(3):
        hit[start[twice] + j] = True
    return np.bincount(owner[hit], minlength=len(n))


def base_failed() -> Column:
    """Too short, or mostly repeated words."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(df: DataFrame, keep: dict[str, Column], text: str, model: LikelihoodRatio) -> DataFrame:
    """:func:`score` with ``base_failed`` and ``kept``: false if the base fails, else whether the score reaches the threshold."""
    out = score(df, keep, text, model).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
