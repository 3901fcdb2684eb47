"""Substring dedup by level-wise doubling of word windows.

Lengths double up to the wanted one: 5, 10, 20 words for windows of 20. At each length only windows that
repeat go on to the next; the loop ends early when none is left.

- First length: each window of 20 is tested by the one gram of 5 words in it with the least hash (:mod:`millrace.llm.repeats`).
  Equal windows have it at the same place, so a window that repeats always passes; testing one gram of
  a window instead of all costs an eighth of the rows.
- Next lengths: that gram is extended to twice its length, to the right where the window has room, else to the left.
- Last length: the windows themselves. Each goes by the first place where its words start.

A segment that occurs twice as a whole passes all lengths by itself; of its places only the first goes through the loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import digests, ragged, word_bounds, word_hashes
from millrace.llm.repeats import PLACE, SEGMENT, covered, find_repeats, flat, inside, join_lists, place_columns, repeated, window_lists, with_texts
from millrace.llm.tables import identified, keep, pieces


def _words(data: np.ndarray, at: np.ndarray):
    lo, hi, first = word_bounds(data, at)
    one = word_hashes(data, lo, hi)
    return one, np.stack([one, word_hashes(data, lo, hi, 1)], 1), first


def lengths(width: int, least: int = 5) -> list[int]:
    """The levels: each twice the one before or one less, the last the width."""
    out = [width]
    while out[0] > least or len(out) == 1 and width > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def extend(at: np.ndarray, n: np.ndarray, lead: np.ndarray, have: int, want: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From windows ``at`` to ``at + n - 1`` with a gram of ``have`` units at ``at + lead`` to windows with one of ``want`` that has it inside.

    Returns the row of each result, its ``at``, ``n`` and ``lead``. The gram grows to the right where the window has room, else to the left.
    """
    gram = at + lead
    right = np.maximum(at, np.minimum(at + n, gram + want - width))  # the first window with room on the right
    rows = np.arange(len(at))
    out_at, out_n = np.concatenate([at, right]), np.concatenate([right - at, at + n - right])
    start = np.concatenate([gram + have - want, gram])
    some = out_n > 0
    return np.concatenate([rows, rows])[some], out_at[some], out_n[some], (start - out_at)[some]


def _level(windows: DataFrame, df: DataFrame, have: int, want: int, width: int) -> DataFrame:
    """Windows with grams of ``want`` words and their two hashes, of windows with grams of ``have``."""
    kind = dict(df.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at_ in pieces(batch, "text", 1 << 19):
                _, words, begin = _words(data, at_)
                row, (at, n, lead) = flat(part.column(3), PLACE)
                inside(at, at + n - 1 + width, np.diff(begin)[row])
                if want == width:
                    owner, at, n, lead = np.repeat(row, n), ragged(at, n), np.ones(n.sum(), np.int64), np.zeros(n.sum(), np.int64)
                else:
                    back, at, n, lead = extend(at, n, lead, have, want, width)
                    owner = row[back]
                lo = begin[owner] + at + lead
                hashes = [pa.array(d.view(np.int64)) for d in digests(words, lo, lo + want)]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*hashes, part.column(0).take(take), part.column(1).take(take), pa.array(at), pa.array(n), pa.array(lead)], names=["hash", "also", "key", "tie", *PLACE])

    texts = with_texts(windows, df, list(PLACE)).select("key", "tie", "text", "items")
    return keep(texts.mapInArrow(run, f"hash long, also long, key {kind}, tie long, at long, n long, lead long"), "level")


def repeated_windows(df: DataFrame, width: int) -> DataFrame:
    """(key, tie, at, n): runs of windows whose words also start earlier (smaller key, then tie, or earlier in the text). ``df``: key, tie, text."""
    have, *levels = lengths(width)
    found = find_repeats(df, _words, width, have, last=False)
    # Every place of a segment but the first: all its windows start earlier.
    where: Column = F.struct("key", "tie", "place")
    first = found.distinct.filter("copies > 1").select(*SEGMENT, "first")
    later = found.rows.join(first, SEGMENT).filter(~where.eqNullSafe(F.col("first"))).select("key", *place_columns()).drop("lead")

    # First places of different segments with one anchor: what they have in common, by longer and longer grams.
    several = repeated(found.distinct.select("anchor", "first.*"), ["anchor"], ["key", "tie", "place"])
    left = several.select("key", *place_columns())
    for want in levels or [width]:
        level = _level(left, df, have, want, width)
        if want == width:
            again = repeated(level, ["hash", "also"], ["key", "tie", "at"], first=True).filter(~F.struct("key", "tie", "at").eqNullSafe(F.col("first")))
            return later.unionByName(again.select("key", "tie", "at", "n"))
        left = keep(repeated(level, ["hash", "also"], ["key", "tie", "at"]).select("key", "tie", *PLACE), "survivors")
        if left.isEmpty():
            break
        have = want
    return later


def remove_repeats(df: DataFrame, key: str, text: str, width: int = 20, others: list[str] | None = None) -> DataFrame:
    """Remove every word that is covered by a window of ``width`` words which also starts earlier.

    Earlier: in a text with a smaller key (null keys first; rows that share a key in the fixed order of a hash of their place in
    the file), or before in the same text; windows are judged on the input. Returns the key, ``others``, ``n_words``, ``n_removed``,
    ``kept_words`` (joined by one space) and ``kept_text``: the text with its white space, each removed run cut
    from its first word to the next kept one; unchanged if nothing goes. Null texts have no words and stay
    null. Texts shorter than a window stay. Every row is a document, also if it is alike in key and text with another one:
    all but the first of these lose what they share. An empty table gives an empty table. Other columns are dropped, so none can clash.
    """
    others = others or []
    rows = identified(df, key=F.col(key), text=F.col(text), more=F.struct(F.lit(0).alias("_"), *others))
    plain = rows.select("key", "tie", "text")
    lists = window_lists(repeated_windows(plain, width))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text", 1 << 19):
                raw = data.tobytes()
                out = []
                for i, (items, null) in enumerate(zip(part.column(3).to_pylist(), part.column(1).is_null().to_pylist(), strict=True)):
                    own = raw[at[i] : at[i + 1]]
                    words = own.split()  # for bytes, white space is exactly that of words
                    gone = covered(items, len(words), width) if items else np.zeros(0, bool)
                    if not gone.any():
                        out.append((len(words), 0, b" ".join(words).decode(), None if null else own.decode()))
                        continue
                    lo, _, _ = word_bounds(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    bounds = np.append(lo, len(own))[edge]
                    cut = np.concatenate(([0], bounds, [len(own)])).reshape(-1, 2)
                    text_ = b"".join(own[a:b] for a, b in cut.tolist())
                    out.append((len(words), int(gone.sum()), b" ".join(compress(words, (~gone).tolist())).decode(), text_.decode()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["key", "more", "n_words", "n_removed", "kept_words", "kept_text"])

    joined = join_lists(rows, lists).select("key", "text", "more", "items")
    done = joined.mapInArrow(run, f"key {kinds['key']}, more {kinds['more']}, n_words long, n_removed long, kept_words string, kept_text string")
    return done.select(F.col("key").alias(key), *[F.col(f"more.`{c}`").alias(c) for c in others], "n_words", "n_removed", "kept_words", "kept_text")
