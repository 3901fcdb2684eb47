"""Repeated byte strings through suffix arrays.

Segments whose anchor gram repeats (:mod:`millrace.llm.repeats`) are dealt by anchor, so equal strings
meet, and are put together to shards of about a million bytes. A segment goes in once; one that occurs several times as a
whole goes in twice, with the bytes of its first and its last place. Where nothing else has its anchor, neighbours of such segments with the
same first and last texts go in as one long string, so their bytes are sorted once. Each shard is sorted as a
suffix array by Larsson and Sadakane's refinement, with Kasai's common prefixes; strings that repeat are
read off the array. An anchor with more segments than a shard holds is split over several shards; what repeats between them is
found by merging the sorted runs of their strings (128-bit hashes) by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.hashing import U, digests, ragged
from millrace.llm.repeats import SEGMENT, WIDEST, covered, find_repeats, flat, inside, join_lists, place_columns, repeated, window_lists, with_texts
from millrace.llm.tables import identified, keep, pieces, text_bytes

#: Bytes of a suffix array at most: three numbers below it fit in 63 bits.
LONGEST = 1 << 21
#: Bytes of a shard, with room for a last segment's two strings; the arrays of a shard of half the longest size stay nearer to the processor.
SHARD = LONGEST // 2 - 4 * WIDEST
#: Bytes of text whose segments are found together, for the same reason.
FOUND_TOGETHER = 1 << 17
#: Strings of split anchors that are merged at a time.
MERGED = 1 << 11
#: Windows of a long string, about.
LONG = 1 << 16


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at most LONGEST bytes in order, and the rank of each.

    Larsson and Sadakane: suffixes that agree in their first h bytes are a group, whose rank is the place of its
    last; a round sorts within groups by the rank h bytes on, which orders 2 h bytes, and
    groups of one are never looked at again. A round is one sort of packed numbers (group, rank h bytes on, position).
    """
    n = len(data)
    if n > LONGEST:
        raise ValueError("a shard is too long")
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    here = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.int64)
    code[here] = np.arange(1, len(here) + 1)  # 0: past the end
    bits = int(len(here)).bit_length()
    h = max(1, 42 // bits)
    coded = np.concatenate([code[data], np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | coded[j : j + n]
    key = np.sort((key << 21) | np.arange(n))
    order = key & (LONGEST - 1)
    key >>= 21
    last = np.append(key[1:] != key[:-1], True)  # of its group
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    places = np.arange(n)
    ends = np.flatnonzero(last)
    rank[order] = np.repeat(ends, np.diff(ends, prepend=-1))
    alone = last & np.append(True, last[:-1])
    places = places[~alone]
    while len(places):
        at = order[places]
        # Ranks h bytes on, plus one: the end of the text comes before all else.
        key = np.sort((rank[at] << 42) | ((rank[np.minimum(at + h, n)] + 1) << 21) | at)
        at = key & (LONGEST - 1)
        key >>= 21
        order[places] = at
        last = np.append(key[1:] != key[:-1], True)
        ends = np.flatnonzero(last)
        rank[at] = np.repeat(places[ends], np.diff(ends, prepend=-1))
        places = places[~(last & np.append(True, last[:-1]))]
        h *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, up to ``most`` (0 for the first).

    Kasai: from one position to the next the prefix shrinks by one at most. Positions are cut into
    lanes that go on side by side, each from nothing; eight bytes are compared at once.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    eight = np.zeros(len(padded) - 7, U)
    for j in range(8):
        eight = (eight << U(8)) | padded[j : len(padded) - 7 + j]
    steps = U(1) << (U(8) * np.arange(1, 8, dtype=U))
    start = np.arange(0, n, lane)
    h = np.zeros(len(start), np.int64)
    for t in range(lane):
        i = start + t
        if i[-1] >= n:
            i, h = i[:-1], h[:-1]
            start = start[:-1]
            if not len(i):
                break
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        h = np.maximum(h - 1, 0)
        h[r == 0] = 0
        go = np.flatnonzero((r > 0) & (h < most))
        while len(go):
            gi, gj = i[go] + h[go], j[go] + h[go]
            x = eight[gi] ^ eight[gj]
            equal = 8 - np.where(x == 0, 0, np.searchsorted(steps, x, "right") + 1)
            # Not past the end of the text.
            equal = np.minimum(equal, n - np.maximum(gi, gj))
            h[go] += equal
            go = go[(equal == 8) & (h[go] < most)]
        out[r] = h
    return np.minimum(out, most)


def repeated_in_shard(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each of the ``starts`` (whose strings of ``width`` bytes lie in the data) a class: equal strings have equal classes, and no others."""
    order, rank = suffix_array(data)
    lcp = common_prefixes(data, order, rank, width)
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    # A class ends where a prefix shorter than the width comes between two neighbours.
    group = np.cumsum(lcp < width)
    return group[rank[starts]]


_STRING = "anchor long, salt int, whole long, also long, key {kind}, tie long, at long, many boolean, bytes binary"
#: What a sorted shard sends on. 0: windows that repeat (key, tie, at, n). 1: a segment (x, y, z: anchor and hashes) whose first and
#: last place agree. 2: one of each string of a split anchor (x, y: hashes, z: shard; n: 1 if only lone in its shard).
_FOUND = "what int, key {kind}, tie long, at long, n long, x long, y long, z long"


def _shards(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.Table]:
    """Whole groups of (anchor, salt), as many as fit in a shard; a group that batches or a full shard would cut waits for its rest.

    Only a group that is longer than a shard by itself becomes several, and then between two segments. It is one of a split anchor:
    others have at most ``shard / (4 * width)`` segments, two strings each and each shorter than twice the width.
    """
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += int(text_bytes(batch.column(8))[1][-1])
        if size <= split:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        ends = text_bytes(rows.column(8))[1][1:]
        names = np.stack([rows.column(i).to_numpy() for i in range(4)])
        new = names[:, 1:] != names[:, :-1]
        groups, segments = (np.append(0, 1 + np.flatnonzero(new[:k].any(0))) for k in (2, 4))
        lo, done = 0, 0
        while ends[-1] - done > split:
            hi = max(lo + 1, int(np.searchsorted(ends, done + split, "right")))
            # Back to where a group begins, else a segment, if it is not the one that the shard begins with; else on to the next segment.
            back = lambda begins: int(begins[np.searchsorted(begins, hi, "right") - 1])  # noqa: B023, E731
            if back(groups) > lo:
                hi = back(groups)
            elif back(segments) > lo:
                hi = back(segments)
            else:
                after = segments[segments > lo]
                if not len(after):
                    break  # the rest of the segment is in the next batch
                hi = int(after[0])
            yield pa.Table.from_batches([rows.slice(lo, hi - lo)])
            lo, done = hi, int(ends[hi - 1])
        waiting, size = [rows.slice(lo)] if lo < rows.num_rows else [], int(ends[-1]) - done
    if waiting and any(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def _runs(alone: DataFrame) -> DataFrame:
    """Segments that are the only ones with their anchor, each with the run (``r1``, ``r2``, ``run``) of neighbours that have the same two texts.

    The window is over the segments of one text.
    """
    segs = alone.select(*SEGMENT, "first.*", F.col("last.key").alias("last_key"), F.col("last.tie").alias("last_tie"), F.col("last.place").alias("last_place"))
    segs = segs.select(*SEGMENT, "key", *place_columns(), "last_key", "last_tie", F.col("last_place").alias("place"))
    segs = segs.select(*SEGMENT, "key", "tie", "at", "n", "last_key", "last_tie", place_columns()[1].alias("last_at"))
    own = W.partitionBy("key", "tie").orderBy("at")
    before = F.lag(F.struct(F.col("at") + F.col("n"), "last_key", "last_tie", F.col("last_at") + F.col("n"), F.floor(F.col("at") / LONG))).over(own)
    follows = before.eqNullSafe(F.struct("at", "last_key", "last_tie", "last_at", F.floor(F.col("at") / LONG)))
    run = F.sum(F.when(follows, 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))
    return segs.withColumn("run", run).withColumn("r1", F.xxhash64("key", "tie", "run")).withColumn("r2", F.xxhash64(F.lit(1), "tie", "key", "run"))


def repeated_strings(df: DataFrame, width: int, shard_bytes: int = SHARD) -> DataFrame:
    """(key, tie, at, n): runs of positions whose strings of ``width`` bytes also start anywhere else. ``df``: key, tie, text."""

    def units(data: np.ndarray, at: np.ndarray):
        return data.astype(U) + U(1), data, at

    found = find_repeats(df, units, width, max(1, width // 4), FOUND_TOGETHER)
    kind = dict(df.dtypes)["key"]
    most = max(1, shard_bytes // (4 * width))
    parts = F.ceil(F.col("total") / most).cast("int")
    salt = F.when(parts > 1, F.pmod(F.col("whole"), parts) + 1).otherwise(0).cast("int")
    kinds = keep(repeated(found.distinct, ["anchor"], ["whole"], least=1).withColumn("salt", salt).withColumn("many", F.col("copies") > 1), "kinds")
    columns = ["anchor", "salt", "whole", "also", "many"]
    mixed = kinds.filter("total > 1")
    places = mixed.select(*columns, F.explode(F.when(F.col("many"), F.array("first", "last")).otherwise(F.array("first"))).alias("p")).select(*columns, "p.*")
    runs = keep(_runs(kinds.filter("total = 1")), "runs")
    joined = runs.groupBy("r1", "r2", "run").agg(F.min(F.struct("at", "key", "tie")).alias("first"), F.min(F.struct("last_at", "last_key", "last_tie")).alias("last"), F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct("first.at", "first.key", "first.tie"), F.struct(F.col("last.last_at").alias("at"), F.col("last.last_key").alias("key"), F.col("last.last_tie").alias("tie")))).alias("p")
    long = joined.select("n", F.col("r1").alias("anchor"), F.lit(0).alias("salt"), F.col("r2").alias("whole"), F.col("run").alias("also"), F.lit(True).alias("many"), both)
    wanted = places.select("key", *place_columns(), *columns).drop("lead").unionByName(long.select("p.key", "p.tie", "p.at", "n", *columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text", 1 << 19):
                raw = data.tobytes()
                row, (a, n, anchor, salt_, whole, also, many) = flat(part.column(3), ("at", "n", *columns))
                lo = at[row] + a
                hi = lo + n - 1 + width
                inside(lo, hi, at[row + 1])
                take = pa.array(row)
                strings = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                cols = [pa.array(anchor), pa.array(salt_.astype(np.int32)), pa.array(whole), pa.array(also), part.column(0).take(take), part.column(1).take(take), pa.array(a), pa.array(many.astype(bool)), strings]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "salt", "whole", "also", "key", "tie", "at", "many", "bytes"])

    strings = with_texts(wanted, df, ["at", "n", *columns]).select("key", "tie", "text", "items").mapInArrow(cut, _STRING.format(kind=kind))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in enumerate(_shards(batches, shard_bytes)):
            shard = shard.combine_chunks().to_batches()[0]
            data, at = text_bytes(shard.column(8))
            n = np.diff(at) - width + 1
            starts, owner = ragged(at[:-1], n), np.repeat(np.arange(len(n)), n)
            classes = repeated_in_shard(data, starts, width)
            size = np.bincount(classes)
            again, many = size[classes] > 1, shard.column(7).to_numpy(zero_copy_only=False)
            if not again[many[owner]].all():
                raise ValueError("two different segments have one hash")
            hit = np.flatnonzero(again & ~many[owner])
            yield from _intervals(shard, owner[hit], starts[hit] - at[owner[hit]])
            yield _sent(1, shard, np.flatnonzero(many), *[shard.column(i).to_numpy()[many] for i in (0, 2, 3)])
            # Strings of split anchors: one of each class goes on, under its hashes; only lone ones need an answer.
            rest = np.flatnonzero(shard.column(1).to_numpy()[owner] > 0)
            if len(rest):
                rest = rest[np.unique(classes[rest], return_index=True)[1]]
                one, two = (d.view(np.int64) for d in digests(data, starts[rest], starts[rest] + width))
                mark = int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=7).digest(), "little") + number
                yield _sent(2, shard, owner[rest], one, two, np.full(len(rest), mark), starts[rest] - at[owner[rest]], (~again[rest]).astype(np.int64))

    # The sort puts groups together; it has nothing to do with suffixes.
    dealt = strings.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "whole", "also")
    done = keep(dealt.mapInArrow(sort, _FOUND.format(kind=kind)), "sorted")
    alike = done.filter("what = 1").select(F.col("x").alias("anchor"), F.col("y").alias("whole"), F.col("z").alias("also")).distinct()
    of_runs = runs.join(alike.toDF("r1", "r2", "run"), ["r1", "r2", "run"]).select(*SEGMENT)
    plain = found.rows.join(alike.unionByName(of_runs), SEGMENT, "left_semi").select("key", *place_columns()).drop("lead")

    def merge(bucket: pa.Table) -> pa.Table:
        """A range of hashes from all shards. Each shard's part is a run; a string of one run is looked for in all runs together."""
        names = np.stack([bucket.column(f"{c}").to_numpy().astype(">i8") for c in "xy"], 1)
        names, shard = np.frombuffer(np.ascontiguousarray(names).tobytes(), "S16"), bucket.column("z").to_numpy()
        runs = np.sort(names)
        lone = np.flatnonzero(bucket.column("n").to_numpy() == 1)
        hits = [np.empty(0, np.int64)]
        for mark in np.unique(shard[lone]):
            own = lone[shard[lone] == mark]
            hits.append(own[np.searchsorted(runs, names[own], "right") - np.searchsorted(runs, names[own], "left") > 1])
        return bucket.take(pa.array(np.concatenate(hits))).select(["key", "tie", "at", "n"])

    across = done.filter("what = 2")
    buckets = max(1, -(-across.count() // MERGED))
    across = across.withColumn("bucket", F.pmod(F.shiftright("x", 7), F.lit(buckets))).groupBy("bucket").applyInArrow(merge, f"key {kind}, tie long, at long, n long")
    return plain.unionByName(done.filter("what = 0").select("key", "tie", "at", "n")).unionByName(across)


def _sent(what: int, shard: pa.RecordBatch, rows: np.ndarray, x=None, y=None, z=None, offset=0, n=None) -> pa.RecordBatch:
    take, none = pa.array(rows), pa.nulls(len(rows), pa.int64())
    at = shard.column(6).to_numpy()[rows] + offset
    cols = [pa.array(np.full(len(rows), what, np.int32)), shard.column(4).take(take), shard.column(5).take(take), pa.array(at), *[none if c is None else pa.array(c) for c in (n, x, y, z)]]
    return pa.RecordBatch.from_arrays(cols, names=["what", "key", "tie", "at", "n", "x", "y", "z"])


def _intervals(shard: pa.RecordBatch, owner: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(owner):
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)))
        yield _sent(0, shard, owner[new], offset=offset[new], n=np.diff(np.append(new, len(owner))))


def remove_strings(df: DataFrame, key: str, text: str, width: int = 200, shard_bytes: int = SHARD) -> DataFrame:
    """Remove every byte that is covered by a string of ``width`` bytes which also starts anywhere else, in any text or the same.

    Strings never cross texts and are judged on the input. Returns the key, ``n_bytes``, ``n_removed``,
    ``spans`` (list of start and end of each maximal removed run, in bytes) and ``kept`` (the remaining bytes;
    they need not be UTF-8). Null texts are empty. Texts shorter than the width stay. Every row is a text of its own: two
    alike in key and text lose what they share. An empty table gives an empty table. Other columns are dropped, so none can clash.
    """
    rows = identified(df, key=F.col(key), text=F.col(text))
    lists = window_lists(repeated_strings(rows.select("key", "tie", "text"), width, shard_bytes))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text", 1 << 19):
                out = []
                for i, items in enumerate(part.column(3).to_pylist()):
                    own = data[at[i] : at[i + 1]]
                    gone = covered(items, len(own), width) if items else None
                    if gone is None or not gone.any():
                        out.append((len(own), 0, [], own.tobytes()))
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                    out.append((len(own), int(gone.sum()), [{"start": a, "end": b} for a, b in edge.tolist()], own[~gone].tobytes()))
                spans_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), spans_, pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", "n_bytes", "n_removed", "spans", "kept"])

    joined = join_lists(rows, lists).select("key", "text", "tie", "items")
    out = joined.mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("key", key)
