"""Near-duplicate documents by SuperMinHash.

1. Each text becomes the set of its word shingles, a SuperMinHash signature and a digest of the set.
2. Texts with equal sets are put together at once; only one of each goes on.
3. Bands of the signature are buckets. In a bucket, texts are compared with the most central ones,
   first with one, then with more, as long as they are not yet connected. In a small bucket that is every pair.
4. What is not connected then in a large bucket is compared in full with the bucket's texts, in bounded cells.
5. A pair is a link if the full sets, made anew from the texts, are similar enough. Before that, counts of shingles in
   256 bins give an upper bound of what two sets have in common; a pair below the threshold by that bound is none.
6. Links are put together by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.hashing import U, gram_hashes, mix, prefix, ragged, spans, word_bounds, word_hashes
from millrace.llm.repeats import repeated, split_by
from millrace.llm.tables import identified, keep, pieces

SIGNATURE, BAND = 128, 4
#: Bins of the upper bound, and how many shingles a set may have for it: counts have 16 bits.
BINS, COUNTED = 256, (1 << 16) - 1
#: How many of a bucket's most central texts are compared with the others, round by round: all in a small
#: bucket (as many as the last round has, or less), one in a large one.
ROUNDS = (1, 4, 24)
#: Shingles of the texts that ask, and of those that are asked, in a cell of large buckets.
LINE, COLUMN = 1 << 15, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def in_order(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by owner (below 65,536) and hash: one sort of packed numbers, and a slower one if these do not settle it."""
    packed = (owner.astype(U) << U(48)) | (hashes >> U(16))
    order = np.argsort(packed)
    p, h = packed[order], hashes[order]
    return np.lexsort((hashes, owner)) if ((p[1:] == p[:-1]) & (h[1:] != h[:-1])).any() else order


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, in order) of each text, one after another, and n + 1 offsets; 65,536 texts at most."""
    data = _LOWER[data]
    lo, hi, first = word_bounds(data, at)
    words = word_hashes(data, lo, hi)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, 0)
    starts = ragged(first[:-1], n)
    owner = np.repeat(np.arange(len(n)), n)
    hashes = gram_hashes(words, k)[starts] if len(starts) else np.empty(0, U)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        whole = spans(prefix(words), first[few], first[few + 1])
        owner, hashes = np.concatenate([owner, few]), np.concatenate([hashes, whole])
    order = in_order(owner, hashes)
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) if len(owner) else np.empty(0, bool)
    return hashes[new], np.searchsorted(owner[new], np.arange(len(at)))


def superminhash(elements: np.ndarray, first: np.ndarray, m: int = SIGNATURE) -> np.ndarray:
    """Signatures (texts by m, 64 bits) of sets of hashes.

    Each element walks through the m places in a random order of its own (a shuffle, one swap a round); in round j it
    offers j plus a random fraction, so a text is finished as soon as every place has less
    than the next round's least offer. Long texts are finished after one or two rounds.
    """
    n = len(first) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, U)
    owner = np.repeat(np.arange(n), np.diff(first))
    active = np.arange(len(elements))
    order = None
    for j in range(m):
        if not len(active):
            break
        x = mix(elements[active] + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (U(j) << U(32)) | (x >> U(32))
        k = j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if order is None:
            place = k
        else:
            rows = np.arange(len(active))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(sig, owner[active] * m + place, value)
        open_ = sig.reshape(n, m).max(1) >= (U(j + 1) << U(32))
        stay = open_[owner[active]]
        if order is None:
            active = active[stay]
            order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(active), m)).copy()
            order[np.arange(len(active)), k[stay]] = 0
        elif stay.sum() < 0.7 * len(active):
            active, order = active[stay], order[stay]
        elif not stay.any():
            break
    return sig.reshape(n, m)


def _sketches(df: DataFrame, k: int) -> DataFrame:
    """key, tie, number of shingles, two sums (128 bits) that identify the set, and the signature with 16 bits to a place."""
    kind = dict(df.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 15):
                for part, data, at in pieces(batch.slice(lo, 1 << 15), "text", 1 << 19):
                    sets, first = shingle_sets(data, at, k)
                    one, two = (np.append(U(0), np.cumsum(mix(sets ^ U(c)), dtype=U)) for c in (0x51ED270B, 0xA3C59AC2B7D6F01))
                    sig = (mix(superminhash(sets, first)) >> U(48)).astype(np.uint16)
                    raw = sig.tobytes()
                    cols = [pa.array(np.diff(first)), *[pa.array((c[first[1:]] - c[first[:-1]]).view(np.int64)) for c in (one, two)]]
                    width = 2 * SIGNATURE
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], names=["key", "tie", "n_shingles", "one", "two", "signature"])

    return df.select("key", "tie", "text").mapInArrow(run, f"key {kind}, tie long, n_shingles long, one long, two long, signature binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = SIGNATURE // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), U).reshape(-1, bands)
        hashed = mix(sig ^ mix(np.arange(1, bands + 1, dtype=U)))
        yield pa.RecordBatch.from_arrays([pa.array(hashed.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["bucket", "node"])


def binned(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingles of each text in each of BINS bins by their low bits, COUNTED at most."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    count = np.bincount(owner * BINS + (sets & U(BINS - 1)).astype(np.int64), minlength=n * BINS)
    return np.minimum(count, COUNTED).astype(np.uint16).reshape(n, BINS)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """False where two sets surely have too little in common: what they share in a bin is the lesser count at most."""
    common = np.minimum(a, b).sum(1, dtype=np.int64)
    return (100 * common >= percent * (n_a + n_b - common)) | (np.maximum(n_a, n_b) > COUNTED)


def _likely(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs that :func:`possible` does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 3))
                n_a, n_b = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                yield batch.filter(pa.array(possible(a, b, n_a, n_b, percent))).select([0, 1])

    sides = [texts.select(F.col("node").alias(x), F.col("bins").alias(f"bins_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    # Sets of too different sizes are ruled out before their bins are looked at.
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "bins_a", "bins_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs for which 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in pieces(batch, "text_a", 1 << 20):
                for lo in range(0, part.num_rows, 1 << 13):
                    some = part.slice(lo, 1 << 13)
                    sides = []
                    for c in ("text_a", "text_b"):
                        for whole, raw, to in pieces(some.select([c]), c, 1 << 62):
                            sides.append(shingle_sets(raw, to, k))
                    owner = np.concatenate([np.repeat(np.arange(some.num_rows), np.diff(f)) for _, f in sides])
                    hashes = np.concatenate([s for s, _ in sides])
                    order = in_order(owner, hashes)
                    owner, hashes = owner[order], hashes[order]
                    common = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])], minlength=some.num_rows)
                    union = np.diff(sides[0][1]) + np.diff(sides[1][1]) - common
                    yield some.filter(pa.array(100 * common >= percent * union)).select(["a", "b"])

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _with_sets(texts: DataFrame, k: int, name: str) -> DataFrame:
    """``texts`` (node, text) with how many shingles they have (``n``) and, by ``name``, the text and its ``bins``, or the ``set`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 15):
                for part, data, at in pieces(batch.slice(lo, 1 << 15), "text", 1 << 19):
                    sets, first = shingle_sets(data, at, k)
                    n = pa.array(np.diff(first))
                    if name == "bins":
                        raw = binned(sets, first)
                        cols = [part.column(1), pa.array([r.tobytes() for r in raw], pa.binary())]
                    else:
                        raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((8 * first).astype(np.int64).tobytes()), pa.py_buffer(sets.tobytes())])
                        cols = [raw.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column(0), n, *cols], names=["node", "n", *(["text"] if name == "bins" else []), name])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, text string, bins binary" if name == "bins" else "node long, n long, set binary")


def links_in_cell(asks: np.ndarray, n: np.ndarray, first: np.ndarray, tokens: np.ndarray, roots: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that ask and rows that do not (``asks``: 1 and 0): a spanning forest of those between different roots, so fewer than there are roots."""
    owner = np.repeat(np.arange(len(n)), n)
    there = asks[owner] == 0
    order = np.argsort(tokens[there], kind="stable")
    index, whose = tokens[there][order], owner[there][order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out: list[tuple[int, int]] = []
    for q in np.flatnonzero(asks == 1).tolist():
        own = tokens[first[q] : first[q + 1]]
        lo = np.searchsorted(index, own, "left")
        common = np.bincount(whose[ragged(lo, np.searchsorted(index, own, "right") - lo)], minlength=len(n))
        hit = np.flatnonzero((common > 0) & (100 * common >= percent * (n + n[q] - common)) & (roots != roots[q]))
        for j in hit[np.unique(roots[hit], return_index=True)[1]].tolist():
            a, b = root(int(roots[q])), root(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((q, j))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _rest(members: DataFrame, roots: DataFrame | None, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between texts of one large bucket that are not connected yet; full sets are compared, and none is left out.

    Large buckets with the same largest component are a family. Its texts outside that component are the ones that
    ask; they are compared with all texts of the family, in cells of some askers by some texts, each
    of a bounded number of shingles. A cell looks shingles up in an index and returns links alone.
    """
    placed = members.filter(F.col("size") > ROUNDS[-1]).select("bucket", "node")
    placed = placed.withColumn("root", F.col("node")) if roots is None else placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = keep(placed, "placed")
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("family"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    # Written first, so the join below is nothing but a join, which Spark splits where a bucket is large.
    family = keep(placed.join(keep(largest, "largest"), "bucket").select("family", "node", "root").distinct(), "families")
    sets = keep(_with_sets(texts.join(family.select("node").distinct(), "node", "left_semi"), k, "set"), "rest")
    asks = F.col("root") != F.col("family")
    blocks = lambda n, most: F.ceil(n / F.lit(float(most))).cast("int")
    sizes = family.join(sets.select("node", "n"), "node").groupBy("family").agg(blocks(F.sum("n"), COLUMN).alias("columns"), blocks(F.sum(F.when(asks, F.col("n")).otherwise(0)), LINE).alias("lines"))
    rows = family.join(sizes, "family")
    spread = lambda own, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(own)
    mine = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    data = rows.select("family", "node", "root", F.lit(0).alias("asks"), mine("columns", 1).alias("column"), spread("line", "lines"))
    askers = rows.filter(asks).select("family", "node", "root", F.lit(1).alias("asks"), mine("lines", 2).alias("line"), spread("column", "columns"))
    cells = data.unionByName(askers).join(sets, "node").select("family", "line", "column", "node", "root", "asks", "n", "set")

    def run(cell: pa.Table) -> pa.Table:
        node, root, ask, n = (cell.column(i).to_numpy() for i in range(3, 7))
        tokens = np.frombuffer(b"".join(cell.column(7).to_pylist()), U)
        a, b = links_in_cell(ask, n, np.append(0, np.cumsum(n)), tokens, root, percent)
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    return cells.groupBy("family", "line", "column").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Words are lower-cased in A to Z; a text's set has its distinct shingles of ``k`` words, or its whole
    sequence if it has fewer; without words, or null, the set is empty and the row stands
    alone. Texts are linked if 100 * intersection >= ``percent`` * union; ``component_id`` is the least key that a
    row reaches (its own included; null only if there is no other). ``kept`` is true for one row of each component: the one with
    the least key (nulls last), of several in the fixed order of a hash of their place in the file. Rows with equal sets are
    linked, however many they are. Rows that share a key are judged each for itself. An empty table gives an empty table. Other columns are dropped.

    32 bands of 4 find a pair at a similarity of 0.8 with a chance of 1 - 5e-8; nothing else loses a link. Shingles are 64-bit hashes, sets are
    told apart by 128 bits. Buckets of any size are searched in full: up to 24 different texts pair by pair as far
    as they are not connected yet, beyond that by :func:`_rest`.
    """
    out = resolve(identified(df, key=F.col(key), text=F.col(text)), k, percent)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def resolve(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` of rows that have key, tie and text already; with key and tie."""
    sketches = keep(_sketches(rows, k), "sketches")
    name = F.struct(F.col("key").isNull().alias("none"), "key", "tie")
    sets = sketches.filter("n_shingles > 0").groupBy("one", "two").agg(F.min(name).alias("first"), F.first("signature").alias("signature"))
    sets = keep(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    bands = sets.select("node", "signature").mapInArrow(_bands, "bucket long, node long")
    members = keep(repeated(bands, ["bucket"], ["node"]).withColumnRenamed("total", "size"), "members")
    # Central: in large buckets, and in many of them.
    central = keep(members.groupBy("node").agg(F.sum("size").alias("score")), "central")
    scored = members.join(central, "node")
    small = F.col("size") <= ROUNDS[-1]
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("score"), "node"))  # of a small bucket, so of few rows
    top = scored.filter(~small).groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("hub"), F.lit(1).alias("rank"))
    hubs = keep(scored.filter(small).select("bucket", F.col("node").alias("hub"), rank.alias("rank")).unionByName(top), "hubs")

    some = keep(sets.join(central.select("node"), "node", "left_semi").select("node", "first.key", "first.tie").withColumn("id", F.xxhash64("key", "tie")), "some")
    inside, _ = split_by(rows.select("key", "tie", "text"), some)
    right = some.select(F.col("key").alias("__k"), F.col("tie").alias("__t"), "node")
    texts = inside.join(right, F.col("key").eqNullSafe(F.col("__k")) & (F.col("tie") == F.col("__t"))).select("node", "text")
    texts = keep(_with_sets(texts, k, "bins"), "texts")

    links, roots, last = None, None, 0
    for most in (*ROUNDS, None):
        if most is None:
            found = keep(_rest(members, roots, texts, k, percent), "links")
        else:
            new = hubs.filter((F.col("rank") > last) & (F.col("rank") <= most)).select("bucket", "hub")
            all_ = members.select("bucket", "node")
            if roots is None:
                pairs = all_.join(new, "bucket").filter("node <> hub")
            else:
                # Only what is not connected yet.
                all_ = all_.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                new = new.join(roots.toDF("hub", "hub_root"), "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
                pairs = all_.join(new, "bucket").filter("root <> hub_root AND node <> hub")
            pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            last = most
            likely = keep(_likely(pairs, texts, percent), "likely")
            found = keep(_confirm(likely, texts, k, percent), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = components(links)

    placed = sets.select("one", "two", "node", "first")
    if roots is None:
        placed = placed.withColumn("head", F.col("first"))
    else:
        linked = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = linked.groupBy("root").agg(F.min("first").alias("head"))
        placed = linked.join(heads, "root")
    out = sketches.select("key", "tie", "n_shingles", "one", "two").join(placed.select("one", "two", "head"), ["one", "two"], "left")
    alone = F.col("n_shingles") == 0
    own = F.when(alone, F.col("key")).otherwise(F.col("head.key"))
    kept = alone | (F.col("head.key").eqNullSafe(F.col("key")) & (F.col("head.tie") == F.col("tie")))
    return out.select("key", "tie", "n_shingles", own.alias("component_id"), kept.alias("kept"))
