"""Similar texts: exclusion by the words that two texts share, and redundancy removal by alignment.

Both find candidates by prefix filtering. Tokens have one order, rare ones first; two sets that share enough have SHARED tokens (or all that
they need) in common among the first few of each, with enough tokens behind them. How rare a token is comes from a sketch of counts over all texts, which decides the order
only: any order gives the same pairs. A token whose cell was counted once is in one set alone, so it is left out. Pairs with
enough common tokens are ruled out by an upper bound of what they share, and those left are compared in
full, so nothing is lost and nothing is guessed. A token with many rows is split into cells by both sides' rows, and
groups of copies collapse first: equal sets are one, and families of close ones, found by least hashes (bands), are settled by one of them before pairs are made.
Bands need not find all of a family: what they miss is compared like all the rest.

Texts are words between ASCII white space, and stay where they are: what is written of each is its prefix, its bands and 128 bytes of counts, and only
texts in pairs that pass the bound are read again, found by a hash of the whole text, and moved. Tokens are 64-bit hashes of words; texts, sets and sequences are told apart by 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import words
from millrace.operators.curate import split_rows, without_rows
from millrace.sources import Workspace

#: Cells of the sketch of counts at most, a byte each where it is broadcast.
FREQUENT = 1 << 24
#: Cells that go on together.
PAGE = 1 << 16
#: Cells of a set's counts, for the upper bound of what two sets share.
BOUND = 128
#: Items (8 bytes each) that are broadcast for the comparison of pairs.
SMALL = 1 << 21
#: Rows of one token, on either side, that are joined in one cell.
CELL = 1 << 12
#: Tokens that two prefixes have in common, if so many are needed at all.
SHARED = 2
#: Bands of a set, and least hashes in each.
BANDS, BAND_ROWS = 8, 4
#: Rounds in which a family is settled by its first row.
ROUNDS = 2
#: Rows that are broadcast.
FEW = 1_000_000


def _ceil(a: Column, b: int) -> Column:
    """The quotient of two whole numbers, up."""
    return F.call_function("div", a + (b - 1), F.lit(b)).cast("int")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(_hashes(text)))


def _place(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _few(t: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it has FEW rows at most."""
    return F.broadcast(t) if t.count() <= FEW else t


def _identity(items: Column) -> Column:
    # Inside transform the items are a variable, so they are worked out once and not for every hash.
    return F.get(F.transform(F.array(items), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))), 0)


def _mixed(flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words of sequences as sets, in order by owner: the first occurrence keeps the word's hash, further ones are mixed with their number, one to one."""
    flat = flat[np.lexsort((flat, owner))]
    new = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))[: len(flat)]
    start = np.flatnonzero(new)
    number = np.arange(len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat))))
    mixed = flat.view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(number > 0, (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), mixed).view(np.int64)


def _tokens(column: pa.Array, bags: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a list column, the row of each, and how many each row has."""
    flat, size = column.flatten().to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    return (_mixed(flat, owner) if bags else flat), owner, size


def _cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    return (tokens.view(np.uint64) % np.uint64(cells)).astype(np.int64)


def _rarity(items: list[DataFrame], bags: bool) -> np.ndarray:
    """A byte for each cell of a sketch of all tokens: 0 for none, 1 for one, then steps of an eighth of a doubling. FREQUENT bytes reach the driver at most.

    Tasks count in 16 bits and send compressed pages on; a cell that is full there stays so, which changes no order of rare ones.
    """
    cells = min(FREQUENT, 1 << max(16, (256 * sum(t.count() for t in items)).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.uint16)
        for batch in batches:
            at, n = np.unique(_cell(_tokens(batch.column(0), bags)[0], cells), return_counts=True)
            own[at] = np.minimum(own[at] + n, 65535)
        for page, lo in enumerate(range(0, cells, PAGE)):
            if own[lo : lo + PAGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zlib.compress(own[lo : lo + PAGE].tobytes(), 1)], pa.binary())], names=["page", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[page] = total.get(page, 0) + np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
        for page, n in total.items():
            byte = np.where(n > 0, np.minimum(1 + np.floor(8 * np.log2(np.maximum(n, 1))), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([byte.tobytes()], pa.binary())], names=["page", "counts"])

    kind, pages = "page int, counts binary", None
    for t in items:
        part = t.select("items").mapInArrow(count, kind)
        pages = part if pages is None else pages.unionAll(part)
    out = np.zeros(cells, np.uint8)
    for r in pages.repartition("page").mapInArrow(add, kind).toLocalIterator():
        out[r.page * PAGE : r.page * PAGE + len(r.counts)] = np.frombuffer(r.counts, np.uint8)
    return out


def _bands(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """BANDS hashes of each row's tokens: rows with nearly the same tokens agree in some, most likely."""
    out = np.zeros((len(size), BANDS), np.uint64)
    if len(flat):
        some = size > 0
        start = (np.cumsum(size) - size)[some]
        numbers = np.random.default_rng(7).integers(1 << 62, size=(BANDS, BAND_ROWS, 2), dtype=np.uint64)
        for band in range(BANDS):
            own = np.full(len(start), band, np.uint64)
            for a, b in numbers[band]:
                own = (own ^ np.minimum.reduceat((flat.view(np.uint64) ^ a) * (b | np.uint64(1)), start)) * np.uint64(0x9E3779B97F4A7C15)
                own ^= own >> np.uint64(31)
            out[some, band] = own
    return out.view(np.int64)


def _need(measure: str, percent: int, x: Column | None = None, y: Column | None = None) -> Column:
    """The least number of tokens that sets of x and y tokens must share."""
    x, y = F.col("x_n") if x is None else x, F.col("y_n") if y is None else y
    return _ceil((x + y) * percent, 100 + percent) if measure == "jaccard" else _ceil(F.greatest(x, y) * percent, 100)


def _indexed(work: Workspace, tables: list[tuple[DataFrame, str, list[str]]], percent: int, bags: bool) -> list[DataFrame]:
    """Of tables (rows, text column, more columns) what is worked with, a row for each row: id, name of the set (or sequence), n, place (of the whole text), the columns, ``bands``, ``bound`` (counts of
    its tokens by cell), and of its prefix, the first n - ceil(percent * n / 100) + SHARED tokens, those that may be elsewhere: ``tokens`` with their places ``ats`` and whether they may be in more than CELL rows.
    Texts are read twice and not moved."""
    items = [df.select((_hashes if bags else _set)(F.col(text)).alias("items"), _place(F.col(text)).alias("place"), *more) for df, text, more in tables]
    shared, hot = items[0].sparkSession.sparkContext.broadcast(_rarity(items, bags)), 1 + int(8 * np.log2(CELL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            flat, owner, size = _tokens(batch.column(0), bags)
            by = rarity[_cell(flat, len(rarity))]
            order = np.lexsort((flat, by, owner))
            begin = np.append(0, np.cumsum(size))
            at = np.arange(len(flat)) - begin[owner]
            some = (at < (size - -(-size * percent // 100) + SHARED)[owner]) & (by[order] > 1)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[some], minlength=len(size)))).astype(np.int32))
            bound = np.bincount(owner * BOUND + (flat.view(np.uint64) >> np.uint64(57)).astype(np.int64), minlength=len(size) * BOUND)
            bound = pa.array([r.tobytes() for r in np.minimum(bound, 255).astype(np.uint8).reshape(-1, BOUND)], pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(_bands(flat, size).ravel()))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (flat[order][some], at[some].astype(np.int32), by[order][some] >= hot)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], bound, bands, *lists], names=[*batch.schema.names[1:], "bound", "bands", "tokens", "ats", "often"])

    out = []
    for t in items:
        t = t.select("items", _identity(F.col("items")).alias("name"), F.size("items").alias("n"), *t.columns[1:])
        kind = T.StructType(t.schema.fields[1:] + T._parse_datatype_string("bound binary, bands array<bigint>, tokens array<bigint>, ats array<int>, often array<boolean>").fields)
        out.append(work.keep(_numbered(t.mapInArrow(run, kind)), "rows"))
    return out


def _different(work: Workspace, rows: DataFrame) -> DataFrame:
    """One row for each different set that has words: the first. Those of copies are found by name; the rows themselves don't move."""
    names = rows.filter("n > 0").groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("name", "first")
    copies = work.keep(rows.select("id", "name").join(_few(work.keep(names, "names")), "name").filter("id <> first").select("id"), "copies")
    return rows.filter("n > 0").join(_few(copies), "id", "left_anti")


def _length_class(n: Column, percent: int) -> Column:
    """Lengths whose ratio is ``percent`` or more are of one class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else n.cast("int")


def _prefixes(sets: DataFrame, percent: int, full: tuple[int, ...], short: tuple[int, ...], *more: str) -> DataFrame:
    """(key, id, n, at, often, and more): a row for each token of a prefix that may be elsewhere, as it is met by sets of classes ``full`` away, and
    of classes ``short`` away with none of fewer words (at a Jaccard similarity), which need a shorter prefix."""
    rows = sets.select("id", "n", *more, _length_class(F.col("n"), percent).alias("class"), F.explode(F.arrays_zip("tokens", "ats", "often")).alias("t"))
    few = F.array(*[F.col("class") + s for s in full]) if full else F.array().cast("array<int>")
    if short:
        early = F.col("t.ats") < F.col("n") - _need("jaccard", percent, F.col("n"), F.col("n")) + SHARED
        few = F.when(early, F.array(*[F.col("class") + s for s in (*full, *short)])).otherwise(few)
    rows = rows.withColumn("class", F.explode(few))
    # Keys that agree by chance only bring more candidates.
    return rows.select(F.xxhash64("t.tokens", "class").alias("key"), "id", "n", F.col("t.ats").alias("at"), F.col("t.often").alias("often"), *more)


def split_join(left: DataFrame, right: DataFrame, on: list[str], most: int = CELL, *, often: tuple[str, str] | None = None) -> DataFrame:
    """Equi-join in which a key with more than ``most`` rows on a side is cut into cells: its rows are dealt to parts on their own side and copied to the parts of the other.

    ``often``: columns of either side that are true wherever a key may have so many rows, so that others need not be counted; they are dropped.
    """
    count = lambda t, c: (t.filter(c.replace("__", "__often_")) if often else t).groupBy(*on).agg(F.count(F.lit(1)).alias(c))
    parts = lambda c: F.ceil(F.col(c) / most).cast("int")
    if often:
        left, right = left.withColumnRenamed(often[0], "__often_l"), right.withColumnRenamed(often[1], "__often_r")
    hot = count(left, "__l").join(count(right, "__r"), on).filter((F.col("__l") > most) | (F.col("__r") > most)).select(*on, parts("__l").alias("__l"), parts("__r").alias("__r"))
    hot = F.broadcast(hot)  # a row for ``most`` rows at most

    def dealt(t: DataFrame, own: str, other: str, seed: int) -> DataFrame:
        seen = t.join(hot, on, "left")
        mine = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in t.columns]), F.coalesce(F.col(own), F.lit(1))).cast("int")
        return seen.select(*[c for c in t.columns if not c.startswith("__often_")], mine.alias(f"{own}_part"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(f"{other}_part"))

    return dealt(left, "__l", "__r", 1).join(dealt(right, "__r", "__l", 2), [*on, "__l_part", "__r_part"]).drop("__l_part", "__r_part")


def _possible(measure: str, percent: int) -> Column:
    """Lengths are close enough, and enough tokens follow the common one, if it is among the first SHARED of them."""
    short, long = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    room = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) + (SHARED - 1)
    return (short * 100 >= long * percent) & (room >= _need(measure, percent))


def _candidates(x: DataFrame, y: DataFrame, on: Column, measure: str, percent: int) -> DataFrame:
    """(x_id, y_id, need): pairs of prefix rows for which ``on`` holds, that have SHARED tokens in common where they need so many."""
    x, y = (t.select("key", *[F.col(c).alias(f"{s}_{c}") for c in t.columns if c != "key"]) for t, s in ((x, "x"), (y, "y")))
    met = split_join(x, y, ["key"], often=("x_often", "y_often")).filter(on & _possible(measure, percent))
    counted = met.groupBy("x_id", "y_id").agg(F.count(F.lit(1)).alias("shared"), F.max(_need(measure, percent)).alias("need"))
    return counted.filter(F.col("shared") >= F.least(F.lit(SHARED), F.col("need"))).select("x_id", "y_id", "need")


def _in_bands(x: DataFrame, y: DataFrame, measure: str, percent: int) -> DataFrame:
    """(x_id, y_id, need): of each band of a set of ``x``, the first set of ``y``, where lengths are close enough."""
    rows = lambda t: t.select("id", "n", F.explode("bands").alias("band"))
    first = rows(y).groupBy("band").agg(F.min(F.struct("id", "n")).alias("y"), F.count(F.lit(1)).alias("rows"))
    first = (first.filter("rows > 1") if x is y else first).select("band", F.col("y.id").alias("y_id"), F.col("y.n").alias("y_n"))
    pairs = rows(x).select("band", F.col("id").alias("x_id"), F.col("n").alias("x_n")).join(first, "band")
    close = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    return (pairs.filter("x_id <> y_id") if x is y else pairs).filter(close).select("x_id", "y_id", _need(measure, percent).alias("need")).distinct()


def _bounded(work: Workspace, pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs (x_id, y_id) that may share ``need``: sets share no more than the sum of the lesser counts of their cells. A full cell rules nothing out."""
    side = lambda t, s: t.select(F.col("id").alias(f"{s}_id"), F.col("bound").alias(f"{s}_bound"))
    both = work.keep(pairs, "candidates").join(side(x, "x"), "x_id").join(side(y, "y"), "y_id").select("x_id", "y_id", "need", "x_bound", "y_bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BOUND) for c in (3, 4))
                good = (np.minimum(a, b).sum(1, dtype=np.int64) >= batch.column(2).to_numpy()) | (np.maximum(a, b).max(1) == 255)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["x_id", "y_id"])

    return work.keep(both.mapInArrow(run, "x_id bigint, y_id bigint"), "pairs")


def _read_again(work: Workspace, texts: DataFrame, items: Column, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the sets ``ids``, from their texts (a column ``text``): they are found by a hash of the whole text, and only words of these are hashed and moved."""
    ids = work.keep(ids.distinct(), "ids")
    names = work.keep(sets.select("id", "place").join(_few(ids), "id", "left_semi"), "names")
    _, some = split_rows(texts, _place(F.col("text")), names.select("place.*"), FEW)
    found = some.select("text", "__name").join(_few(names.select("id", F.col("place").alias("__name"))), "__name").select("id", items.alias("items"))
    out = work.keep(found.dropDuplicates(["id"]), "items")
    work.drop(ids, names)
    return out


def _both(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs with the items of both. A side of SMALL items or fewer is broadcast, so pairs among few texts, however many, don't each move them."""
    for t, s in ((x, "x"), (y, "y")):
        few = (t.agg(F.sum(F.size("items"))).first()[0] or 0) <= SMALL
        t = t.toDF(f"{s}_id", f"{s}_items")
        pairs = pairs.join(F.broadcast(t) if few else t, f"{s}_id")
    return pairs


def _shared(work: Workspace, pairs: DataFrame, x: tuple[DataFrame, DataFrame], y: tuple[DataFrame, DataFrame], percent: int) -> DataFrame:
    """Pairs (x_id, y_id) that are similar by their full sets; ``x`` and ``y``: texts and sets of a side."""
    left, items = _bounded(work, pairs, x[1], y[1]), _set(F.col("text"))
    if x is y:
        full = _read_again(work, x[0], items, x[1], left.select(F.col("x_id").alias("id")).unionAll(left.select("y_id")))
        sides = (full, full)
    else:
        sides = (_read_again(work, x[0], items, x[1], left.select(F.col("x_id").alias("id"))), _read_again(work, y[0], items, y[1], left.select(F.col("y_id").alias("id"))))
    both = _both(left, *sides).withColumn("x_n", F.size("x_items")).withColumn("y_n", F.size("y_items"))
    out = work.keep(both.filter(F.size(F.array_intersect("x_items", "y_items")) >= _need("jaccard", percent)).select("x_id", "y_id"), "links")
    work.drop(left, *sides)
    return out


def _numbered(t: DataFrame) -> DataFrame:
    return t.select(F.monotonically_increasing_id().alias("id"), "*")


def similar_texts(df: DataFrame, other: DataFrame, text: str, other_text: str, percent: int, work: Workspace) -> DataFrame:
    """(a, b): places of the texts of ``df`` whose word sets have 100 * intersection >= percent * union for any set of ``other``.

    Sets that ``other`` has itself need no comparison. Of the rest each meets one set of ``other`` for each of its bands; only those without a match then meet all.
    """
    rows = _indexed(work, [(df, text, []), (other, other_text, [])], percent, False)
    sets = [_different(work, t) for t in rows]
    sides = [(t.select(F.col(c).alias("text")), s) for t, c, s in zip((df, other), (text, other_text), sets, strict=True)]
    x, y = sets
    found = work.keep(x.select("id", "name").join(y.select("name"), "name", "left_semi").select("id"), "similar")
    x = x.join(_few(found), "id", "left_anti")
    new = _shared(work, _in_bands(x, y, "jaccard", percent), *sides, percent)
    new = work.keep(new.select(F.col("x_id").alias("id")).distinct(), "similar")
    found, x = found.unionAll(new), x.join(_few(new), "id", "left_anti")
    # A set of y that has no more words than those of x, as it is one class up, is met by its shorter prefix.
    pairs = _candidates(_prefixes(x, percent, (0,), ()), _prefixes(y, percent, (-1, 0), (1,)), F.lit(True), "jaccard", percent)
    found = found.unionAll(_shared(work, pairs, *sides, percent).select(F.col("x_id").alias("id")).distinct())
    names = work.keep(sets[0].select("id", "name").join(_few(work.keep(found, "similar")), "id", "left_semi").select("name"), "names")
    return rows[0].select("name", "place").join(_few(names), "name", "left_semi").select("place.*").distinct()


def exclude_similar(df: DataFrame, other: DataFrame, text: str, other_text: str, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """Rows whose set of words is not similar to that of any row of another dataset: 100 * intersection < percent * union for all of them.

    Every row is judged by its text, whatever its other columns are; null and blank texts have no words and are similar to nothing. An
    empty ``other`` excludes nothing. Texts are read several times. Those that stay are not
    shuffled, unless they nearly match: ``most_broadcast`` excluded texts (16 bytes each) or fewer are broadcast, of more only their buckets.
    """
    if not 0 < percent <= 100:
        raise ValueError("a similarity is 1 to 100 per cent")
    with Workspace(df.sparkSession) as work:
        found = work.result(similar_texts(df, other, text, other_text, percent, work), "excluded")
    return without_rows(df, _place(F.col(text)), found, most_broadcast)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger: a column of the table is worked out at once, its steps up and down as the bits of two numbers (Myers 1999, Hyyrö 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lead = int(np.argmin(np.append(a[: len(b)] == b, False)))  # an equal beginning or end costs nothing
    a, b = a[lead:], b[lead:]
    tail = int(np.argmin(np.append(a[::-1][: len(b)] == b[::-1], False)))
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    n, m = len(a), len(b)
    if not m:
        return n
    at: dict[int, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << m) - 1
    last, up, down, score = 1 << (m - 1), every, 0, m
    for i, x in enumerate(a, 1):
        same = at.get(x, 0)
        steps = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(steps | up)), up & steps
        score += bool(more & last) - bool(less & last)
        if score - (n - i) > most:
            return most + 1
        more = (more << 1 | 1) & every
        up, down = (less << 1 & every) | (every & ~(same | down | more)), more & (same | down)
    return min(score, most + 1)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences share, repeated ones by their occurrence."""
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _aligned(work: Workspace, pairs: DataFrame, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x_id, y_id, identity): pairs with 100 * (longest - edits) >= percent * longest; the shared words are counted before sequences are aligned."""
    left = _bounded(work, pairs, sets, sets)
    full = _read_again(work, texts, _hashes(F.col("text")), sets, left.select(F.col("x_id").alias("id")).unionAll(left.select("y_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, identity = [], []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                long = max(len(a), len(b))
                most = (100 - percent) * long // 100
                e = edits(a, b, most) if _overlap(a, b) >= long - most else most + 1
                good.append(e <= most)
                identity.append((long - e) / long)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(identity, pa.float64()).filter(keep)], names=["x_id", "y_id", "identity"])

    out = work.keep(_both(left, full, full).select("x_id", "y_id", "x_items", "y_items").mapInArrow(run, "x_id bigint, y_id bigint, identity double"), "aligned")
    work.drop(left, full)
    return out


def representatives(df: DataFrame, key: str, text: str, percent: int = 90) -> DataFrame:
    """Each row's key, its ``representative`` (a key) and their ``identity``: redundancy removal, longest texts first.

    Taken by length in words, the longest first (then by key, nulls last, then by the words), a text becomes a representative unless it is as close
    as ``percent`` to one before it; then it belongs to one of these. Identity is 1 - edits / words of the longer text, by an
    alignment of words. So every row has a representative that close (itself included), no two representatives are that close, and which texts
    are representatives does not depend on how the table is stored. Rows with the same words have one representative, the least key among them. Rows without words stand for
    themselves. Rows that share a key are judged each by its text. An empty table gives an empty table. Other columns are dropped, so none can clash.

    Rounds: a text close to the first one of a band is put aside with it, if that one is not put aside itself. The others are compared pair by pair, and links are resolved in order. Texts that
    were put aside with one that is no representative then come back, until there are none: whoever is close to an earlier representative decides nothing about others.
    """
    if not 0 < percent <= 100:
        raise ValueError("an identity is 1 to 100 per cent")
    with Workspace(df.sparkSession) as work:
        return work.result(_representatives(df, key, text, percent, work), "representatives")


def _resolved(work: Workspace, texts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, to, identity) of ids that have all links (x_id, y_id, identity) to earlier ones: to itself, if it is linked to no earlier representative, or to the first of them."""
    left, decided = texts, None
    while not left.isEmpty():
        # Without a link to an undecided text before it, a text is a representative; what is linked to one is decided too.
        heads = work.keep(left.join(links.select(F.col("x_id").alias("id")).distinct(), "id", "left_anti"), "heads")
        found = links.join(heads.select(F.col("id").alias("y_id")), "y_id", "left_semi")
        found = found.groupBy("x_id").agg(F.min(F.struct("y_id", "identity")).alias("m")).select(F.col("x_id").alias("id"), F.col("m.y_id").alias("to"), "m.identity")
        new = work.keep(heads.select("id", F.col("id").alias("to"), F.lit(1.0).alias("identity")).unionAll(found), "members")
        decided = new if decided is None else decided.unionAll(new)
        left = work.keep(left.join(new, "id", "left_anti"), "undecided")
        gone = new.filter("id <> to").select("id")
        links = work.keep(links.join(gone, links.x_id == gone.id, "left_anti").join(gone, links.y_id == gone.id, "left_anti"), "links")
    return work.keep(decided if decided is not None else texts.select("id", F.col("id").alias("to"), F.lit(1.0).alias("identity")), "decided")


def _representatives(df: DataFrame, key: str, text: str, percent: int, work: Workspace) -> DataFrame:
    rows = _indexed(work, [(df.select(F.col(text).alias("text"), F.col(key).alias("key")), "text", ["key"])], percent, True)[0]
    texts = df.select(F.col(text).alias("text"))
    least = rows.filter("n > 0").groupBy("name").agg(F.min("id").alias("row"), F.min("n").alias("n"), F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("first"))
    # Numbers go up in the order in which texts are taken.
    turns = work.keep(_numbered(least.orderBy(F.desc("n"), "first.none", "first.key", "name")).select("id", "row", "name", F.col("first.key").alias("key")), "turns")
    sets = work.keep(rows.drop("name", "key").withColumnRenamed("id", "row").join(turns.select("id", "row"), "row").drop("row"), "sets")

    def compared(x: DataFrame, y: DataFrame) -> DataFrame:
        """Links of ``x`` to earlier ones among ``y``, which have as many words or more."""
        return _aligned(work, _candidates(_prefixes(x, percent, (0,), ()), _prefixes(y, percent, (-1, 0), ()), F.expr("y_id < x_id"), "edits", percent), texts, sets, percent)

    aside, rest = None, sets
    for _ in range(ROUNDS):
        near = _aligned(work, _in_bands(rest, rest, "edits", percent), texts, sets, percent)
        near = work.keep(near.join(near.select(F.col("x_id").alias("y_id")).distinct(), "y_id", "left_anti").groupBy("x_id").agg(F.min(F.struct("y_id", "identity")).alias("m")).select(F.col("x_id").alias("id"), F.col("m.y_id").alias("to"), "m.identity"), "aside")
        if near.isEmpty():
            break
        aside = near if aside is None else aside.unionAll(near)
        # A head may be close to another's head, but is not put aside, so it goes out of the next round.
        rest = rest.join(_few(work.keep(near.select("id").unionAll(near.select("to")).distinct(), "settled")), "id", "left_anti")
    left = sets if aside is None else sets.join(_few(work.keep(aside.select("id"), "aside")), "id", "left_anti")
    here = work.keep(left.select("id"), "undecided")
    links = compared(left, left)
    decided = _resolved(work, here, links)
    while aside is not None:
        back = work.keep(aside.join(decided.filter("id = to").select("to"), "to", "left_anti"), "back")
        if back.isEmpty():
            break
        new, old = (sets.join(_few(t), "id", "left_semi") for t in (back.select("id"), here))
        links = links.unionAll(compared(new, old)).unionAll(compared(old, new)).unionAll(compared(new, new))
        here = work.keep(here.unionAll(back.select("id")), "undecided")
        aside = work.keep(aside.join(back.select("id"), "id", "left_anti"), "aside")
        decided = _resolved(work, here, links)
    decided = decided if aside is None else decided.unionAll(aside.select(*decided.columns))
    placed = decided.join(turns.select(F.col("id").alias("to"), F.col("key").alias("representative")), "to").join(turns.select("id", "name"), "id").select("name", "representative", "identity")
    out = rows.select("key", "name").join(placed, "name", "left")
    alone = F.col("identity").isNull()
    return out.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("representative")).alias("representative"), F.coalesce("identity", F.lit(1.0)).alias("identity"))


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """(id, root) for every id with a link (x_id, y_id), root being the least id that it reaches.

    Alternating stars: neighbours that are larger, then all, move to the least neighbour, by minima per id (combined on the map side) and
    joins; links of one id are never gathered.
    """
    edges = work.keep(links.select(F.greatest("x_id", "y_id").alias("x"), F.least("x_id", "y_id").alias("y")).filter("x <> y").distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        edges = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = edges.groupBy("x").agg(F.min("y").alias("m"))
        moved = edges.join(low, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = work.keep(moved.unionAll(low.toDF("x", "y")).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
        if now == state:
            return edges.toDF("id", "root").unionAll(edges.select(F.col("y").alias("id"), F.col("y").alias("root")).distinct())
        state = now


def similar_groups(df: DataFrame, key: str, text: str, percent: int = 80) -> DataFrame:
    """Each row's key and its ``group_id``: the least key that it reaches over links between similar word sets (100 * intersection >= percent * union).

    Rows with the same words are linked, however many they are; a row without words, or null, is a group of its own. Rows that share a key
    are judged each by its text; null keys come after all others. An empty table gives an empty table. Other columns are dropped, so none can clash.

    First every set meets one set for each of its bands, which settles families of close texts; then only sets that are not
    connected yet are compared.
    """
    if not 0 < percent <= 100:
        raise ValueError("a similarity is 1 to 100 per cent")
    with Workspace(df.sparkSession) as work:
        rows = _indexed(work, [(df.select(F.col(text).alias("text"), F.col(key).alias("key")), "text", ["key"])], percent, False)[0]
        sets = _different(work, rows)
        side = (df.select(F.col(text).alias("text")), sets)
        links = _shared(work, _in_bands(sets, sets, "jaccard", percent), side, side, percent)
        roots = work.keep(components(work, links), "roots")

        def rooted(t: DataFrame) -> DataFrame:
            return t.join(_few(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))

        # The longer set of a pair is x, so y is of its class or the one before.
        apart = F.expr("x_root <> y_root AND (y_n < x_n OR y_n = x_n AND y_id < x_id)")
        x, y = (_prefixes(rooted(sets), percent, full, short, "root") for full, short in (((0,), ()), ((), (0, 1))))
        more = _shared(work, _candidates(x, y, apart, "jaccard", percent), side, side, percent)
        roots = roots if more.isEmpty() else work.keep(components(work, links.unionAll(more)), "roots")
        placed = rooted(sets.select("id", "name")).select("name", "root")
        own = rows.select("key", "name").join(placed, "name", "left")
        least = own.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("first"))
        out = own.join(least, "root", "left").select(F.col("key").alias(key), F.when(F.col("root").isNotNull(), F.col("first.key")).otherwise(F.col("key")).alias("group_id"))
        return work.result(out, "groups")
