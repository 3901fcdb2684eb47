"""Repeated windows across all documents: what substring dedup and suffix arrays share.

A window is ``width`` consecutive units (words or bytes) of one text. Of the grams of a quarter of that
length in a window, the one with the least hash is its anchor (the first of several), so equal
windows have equal anchors at equal places. The windows of a text that share an anchor
stand together; with their units they make a segment, and every window is in exactly one segment.

1. Segments are found where the texts are. A window can only repeat if its anchor does, so
   segments whose anchor occurs once anywhere are done. An anchor that a task has met before
   goes into the count twice at most, so a frequent one is no hot key.
2. Equal segments (by 128 bits) are put together, combined on the map side: each distinct one goes on with its
   number and its first and last place.
3. What the windows of the distinct segments have in common is the caller's work.

Every row is a document of its own; ``key`` and ``tie`` (:func:`millrace.llm.tables.identified`) name it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.hashing import U, KeySet, digests, mix, prefix, ragged, spans
from millrace.llm.tables import keep, key_filter, may_have, pieces

#: A place: bits of the first window's number, of how many windows, and of how far the anchor is from the first window's start.
_AT, _N, _LEAD = 36, 13, 14
#: Units that are looked at together: their numbers stand in the low bits of a hash.
_RUN = 1 << 27
#: The largest width: places have room for it.
WIDEST = 1 << 12
#: Parts that a key with many rows is dealt to.
SALTS = 64
PLACE = ("at", "n", "lead")


def place_columns() -> list[Column]:
    """tie, and the parts of the column ``place``."""
    p = F.col("place")
    return [F.col("tie"), F.shiftright(p, _N + _LEAD).alias("at"), F.shiftright(p, _LEAD).bitwiseAND((1 << _N) - 1).alias("n"), p.bitwiseAND((1 << _LEAD) - 1).alias("lead")]


@dataclass(frozen=True)
class Segments:
    """Of a run of texts: anchor hash, two segment hashes, number of the text, first window, how many, and where the anchor is from there."""

    anchor: np.ndarray
    whole: np.ndarray
    also: np.ndarray
    text: np.ndarray
    at: np.ndarray
    n: np.ndarray
    lead: np.ndarray


def segments(values: np.ndarray, units: np.ndarray, first: np.ndarray, width: int, gram_size: int, run: int = _RUN) -> Segments:
    """``values``: a hash of each unit, for the choice of anchors; ``units``: rows that tell units apart; ``first``: offsets of the texts in them (n + 1). ``at`` counts from the text's start.

    Texts of more than ``run`` units together are looked at one by one, and a longer one in runs that overlap by a window less one unit.
    """
    if len(values) > run:
        parts = []
        for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            step = run - width + 1
            for a in range(lo, max(lo + 1, hi - width + 1), step):
                b = min(hi, a + run)
                s = segments(values[a:b], units[a:b], np.array([0, b - a]), width, gram_size, run)
                parts.append(Segments(s.anchor, s.whole, s.also, s.text + i, s.at + (a - lo), s.n, s.lead))
        return Segments(*[np.concatenate([getattr(p, f) for p in parts]) for f in Segments.__dataclass_fields__])
    k = gram_size
    span = width - k + 1
    windows = np.maximum(np.diff(first) - width + 1, 0)
    starts = ragged(first[:-1], windows)
    if not len(starts):
        e = np.empty(0, np.int64)
        return Segments(e.astype(U), e.astype(U), e.astype(U), e, e, e, e)
    pre = prefix(values)
    grams = np.arange(len(values) - k + 1)
    gram = spans(pre, grams, grams + k)
    low = (gram & ~U(_RUN - 1)) | grams.astype(U)
    have, least = 1, low
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    chosen = (least[starts] & U(_RUN - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]) | np.append(True, starts[1:] != starts[:-1] + 1))
    at, anchor = starts[new], chosen[new]
    n = np.diff(np.append(new, len(starts)))
    lead = anchor - at
    end = at + n - 1 + width
    # The anchor's place is part of a segment's identity.
    whole, also = (mix(d + lead.astype(U)) for d in digests(units, at, end))
    text = np.searchsorted(first, at, "right") - 1
    return Segments(gram[anchor], whole, also, text, at - first[text], n, lead)


_FOUND = ("anchor", "whole", "also", "key", "tie", "place", "known")


def _find(df: DataFrame, units: Callable, width: int, gram_size: int, piece: int) -> DataFrame:
    """Segments of all texts. ``known``: the task has met the anchor before; such rows go on in any case. A row without ``place`` only counts."""
    kind = dict(df.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = KeySet()
        for batch in batches:
            for rows, data, at in pieces(batch, "text", piece):
                s = segments(*units(data, at), width, gram_size)
                if not len(s.anchor):
                    continue
                keys, head, back = np.unique(s.anchor, return_index=True, return_inverse=True)
                seen = np.zeros(len(keys), bool)
                fresh_mark = []
                for lo in range(0, len(keys), 1 << 19):
                    slot, old = met.slots(keys[lo : lo + (1 << 19)])
                    seen[lo : lo + len(slot)] = old
                    again = old | (np.bincount(back, minlength=len(keys))[lo : lo + len(slot)] > 1)
                    fresh_mark.append(keys[lo : lo + len(slot)][again & ~met.flags[slot]])
                    met.flags[slot[again]] = True
                known = np.ones(len(s.anchor), bool)
                known[head[~seen]] = False
                take = pa.array(s.text)
                place = (((s.at << _N) | s.n) << _LEAD) | s.lead
                yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in (s.anchor, s.whole, s.also)], rows.column(0).take(take), rows.column(1).take(take), pa.array(place), pa.array(known)], names=_FOUND)
                mark = np.concatenate(fresh_mark)
                if len(mark):
                    none = pa.nulls(len(mark), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), none, none, pa.nulls(len(mark), rows.column(0).type), none, none, pa.array(np.zeros(len(mark), bool))], names=_FOUND)

    return df.select("key", "tie", "text").mapInArrow(run, f"anchor long, whole long, also long, key {kind}, tie long, place long, known boolean")


def repeated(rows: DataFrame, by: list[str], spread: list[str], first: bool = False, least: int = 2) -> DataFrame:
    """Rows whose ``by`` occurs ``least`` times or more, with that number as ``total``; no task sees all rows of one ``by``.

    Rows of one ``by`` are dealt to SALTS parts by the columns ``spread``; parts are counted (combined on the map side), and a window
    over at most SALTS counts adds them up. ``first`` adds the least struct of ``spread`` among the rows of one ``by``.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    over = W.partitionBy(*by)
    parts = salted.groupBy(*by, "__salt").agg(F.count(F.lit(1)).alias("__c"), *([F.min(F.struct(*spread)).alias("__f")] if first else []))
    total = parts.withColumn("total", F.sum("__c").over(over))
    total = total.withColumn("first", F.min("__f").over(over)).drop("__f") if first else total
    return salted.join(total.filter(F.col("total") >= least).drop("__c"), [*by, "__salt"]).drop("__salt")


@dataclass(frozen=True)
class Repeats:
    """``rows``: every segment whose anchor repeats; ``distinct``: each different one of them, with ``copies``, its
    ``first`` and its ``last`` place (key, tie, place)."""

    rows: DataFrame
    distinct: DataFrame


SEGMENT = ["anchor", "whole", "also"]


def find_repeats(df: DataFrame, units: Callable, width: int, gram_size: int, piece: int = 1 << 19, last: bool = True) -> Repeats:
    """``df`` has key, tie and text. ``units``: from bytes and offsets of a run of texts to a hash of each unit, rows that tell units apart, and the texts' offsets. Without ``last`` the last places are left out."""
    if not 0 < width <= WIDEST:
        raise ValueError(f"a window has 1 to {WIDEST} units")
    found = _find(df, units, width, gram_size, piece)
    # Rows that go on in any case stay with their text, so their keys compress; one that meets an anchor there by chance only goes on as well.
    by = F.when(F.col("known"), F.col("tie")).otherwise(F.col("anchor"))
    met = F.count(F.lit(1)).over(W.partitionBy("by"))
    rows = keep(found.withColumn("by", by).withColumn("__n", met).filter("place IS NOT NULL AND (known OR __n > 1)").drop("by", "__n", "known"), "repeats")
    where = F.struct("key", "tie", "place")
    distinct = rows.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("copies"), F.min(where).alias("first"), *([F.max(where).alias("last")] if last else []))
    return Repeats(rows, keep(distinct, "segments"))


def text_key(key: str = "key", tie: str = "tie") -> Column:
    return F.xxhash64(key, tie)


def with_texts(wanted: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` (key, tie, text) for which ``wanted`` has rows, with lists of these under ``items``. Only texts that pass a filter are shuffled."""
    lists = wanted.groupBy("key", "tie").agg(F.collect_list(F.struct(*columns)).alias("items"))
    lists = keep(lists.withColumn("id", text_key()), "lists")
    some, _ = split_by(df, lists)
    return _join(some, lists, "inner")


def _join(df: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    right = lists.select(F.col("key").alias("__k"), F.col("tie").alias("__t"), "items")
    return df.join(right, df["key"].eqNullSafe(right["__k"]) & (df["tie"] == right["__t"]), how).drop("__k", "__t")


def split_by(df: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may be in ``lists`` (by key and tie), and those that surely are not."""
    shared = df.sparkSession.sparkContext.broadcast(key_filter(lists, "id"))
    rows = df.withColumn("id", text_key())
    at = rows.columns.index("id")

    def pick(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_have(shared.value, batch.column(at).to_numpy()) == inside))

        return rows.mapInArrow(run, rows.schema).drop("id")

    return pick(True), pick(False)


def join_lists(df: DataFrame, lists: DataFrame) -> DataFrame:
    """All rows of ``df``, with ``items`` (null without any). Texts that surely have none are not shuffled."""
    inside, outside = split_by(df, lists)
    return _join(inside, lists, "left").unionByName(outside.withColumn("items", F.lit(None).cast(dict(lists.dtypes)["items"])))


def window_lists(windows: DataFrame) -> DataFrame:
    """Lists of (at, n) by key and tie: a text has as many as it has windows at most."""
    lists = windows.groupBy("key", "tie").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))).alias("items"))
    return keep(lists.withColumn("id", text_key()), "windows")


def flat(items: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number of each item of a list column, and its fields."""
    rows = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy(zero_copy_only=False))
    inner = items.flatten()
    return rows, [inner.field(inner.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def inside(at: np.ndarray, end: np.ndarray, units: np.ndarray | int) -> None:
    """Windows must lie in their texts; if they do not, the input gave other rows when it was read again."""
    if (at < 0).any() or (end > units).any():
        raise ValueError("a window is not in its text: the input does not give the same rows each time")


def covered(items: list[dict] | None, units: int, width: int) -> np.ndarray:
    """Mask of the units that the windows cover."""
    if not items:
        return np.zeros(units, bool)
    at = np.array([i["at"] for i in items], np.int64)
    end = at + np.array([i["n"] for i in items], np.int64) - 1 + width
    inside(at, end, units)
    step = np.bincount(at, minlength=units + 1) - np.bincount(end, minlength=units + 1)
    return np.cumsum(step[:units]) > 0
