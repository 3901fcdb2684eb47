"""Packing documents into token sequences: first-fit decreasing in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import keep, pieces
from millrace.llm.wordbpe import PIECE, coder


class BinTree:
    """A tournament tree over the room left in bins: each inner node has the larger of its two; the first bin with enough room is a walk down."""

    def __init__(self, capacity: int, bins: int):
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin that has room; its number, and the room it had."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        had = room[at]
        room[at] = had - need
        bin_ = at - self.size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each item; items are none longer than the capacity; equal lengths go in the order given."""
    order = np.argsort(-lengths, kind="stable")
    tree = BinTree(capacity, len(lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def token_pieces(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, add ``end_id``, cut the ids at multiples of ``capacity``.

    ``key``, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``; ``with_ids`` adds ``ids`` (little-endian
    unsigned 32-bit). Null texts are empty: one piece with just the end id. Repeated rows are cut each for itself.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in pieces(batch, "text", 4 * PIECE):
                ids, at = coder(tokenizer).encode(part.column(1).to_pylist())
                whole = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                total = np.diff(at)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lo = at[row] + nth * capacity
                hi = np.minimum(lo + capacity, at[row + 1])
                raw = whole.tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                cols = [part.column(0).take(pa.array(row)), pa.array(nth * capacity, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(total[row], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(cut, pa.binary())] if with_ids else []), names=["key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    out = rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("key", key)


def pack(items: DataFrame, length: str, capacity: int, group_items: int = 4096, seed: int = 4) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items of at most ``capacity``: first-fit decreasing in each random group.

    A hash of the whole item picks its group, about ``group_items`` to a group, so groups neither follow the order of
    the input nor grow with it, and each is packed by itself. ``offset`` has no gaps in a sequence. Ids
    of sequences are group * 2**32 + bin. Zero lengths take no room; null or too long ones are an
    error. Repeated items are packed each for itself; an empty table stays empty.
    """
    items = keep(items, "items")
    groups = max(1, -(-items.count() // group_items))
    # A number for each row of the kept table spreads even items that are all alike.
    rows = items.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *items.columns, F.lit(seed)), F.lit(groups)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c in g.columns if g[c].dtype.kind in "iuf"], kind="stable")
        lengths = g[length].to_numpy(np.int64)
        if len(lengths) and (lengths.max() > capacity or lengths.min() < 0):
            raise ValueError("an item does not fit")
        bins, offsets = first_fit_decreasing(lengths, capacity)
        return g.drop(columns="__group").assign(sequence_id=(g["__group"].to_numpy(np.int64) << 32) + bins, offset=offsets)

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return rows.groupBy("__group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
