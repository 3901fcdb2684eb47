"""Phrases whose words stand together more often than by chance.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and pieces into words; a phrase lies in one piece.
Three scans of the texts, each in bounded blocks of one language:

1. A sketch of words and of pairs of words: each task adds its counts to cells that two hashes name; cells stop at the
   least frequency wanted. A word's or phrase's lesser cell is an upper bound of its frequency.
2. A sketch of longer phrases, only of those whose pairs all pass the first one; and a filter of the words that are in such pairs.
3. The candidates of a block, whose upper bounds and those of their parts reach the frequency, go into an Aho-Corasick
   automaton; words stand between guards (one space each, pieces end in a line feed), so only whole words match. A scan counts all
   matches, overlaps included. Counts are sent on as pages, dealt by a hash of the phrase, and summed; only now the frequency is tested exactly.

So an error of the sketch costs time and changes no result. The sketches' size follows the size of the texts up to a fixed bound, and they are the only
thing that is broadcast. A block's candidates go into automata of a bounded size, one after another if need be.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.hashing import U, gram_hashes, mix, ragged, word_bounds, word_hashes
from millrace.llm.tables import keep, text_bytes

#: Bytes of a block of one language; a longer piece comes alone.
BLOCK = 1 << 23
#: Cells of a sketch: 2**SMALLEST to 2**LARGEST, one byte (or two) each.
SMALLEST, LARGEST = 16, 25
#: Cells that are summed up together.
STRIP = 1 << 14
#: Characters of the candidates in one automaton.
AUTOMATON = 1 << 23
#: Parts that a frequent word's rows are dealt to.
SALTS = 16
#: The characters that end a piece, and those between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\x20\x09"


def _table() -> bytes:
    out = bytearray(range(256))
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    for c in ENDS:
        out[c] = 0x0A
    for c in BLANKS:
        out[c] = 0x20
    return bytes(out)


_FOLD = np.frombuffer(_table(), np.uint8)


class Block:
    """Texts of one language: hashes of their words, and which words stand in one piece."""

    def __init__(self, lang: str, texts: list[np.ndarray]):
        line = np.array([0x0A], np.uint8)
        self.data = _FOLD[np.concatenate([x for t in texts for x in (t, line)])]
        self.lo, self.hi, _ = word_bounds(self.data, np.array([0, len(self.data)]))
        self.seed = mix(word_hashes(np.frombuffer(lang.encode() or b"\0", np.uint8), np.array([0]), np.array([max(1, len(lang.encode()))])))[0]
        self.piece = np.append(0, np.cumsum(self.data == 0x0A))[self.lo]
        self.words = word_hashes(self.data, self.lo, self.hi)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words of all phrases of ``k`` words, and the phrases' hashes (those of two languages differ)."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        at = np.flatnonzero(self.piece[k - 1 :] == self.piece[:n])
        hashes = self.words if k == 1 else gram_hashes(self.words, k)
        return at, mix(hashes[at] ^ self.seed)

    def guarded(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with a space before and after each (one between two), pieces ended by a line feed; where each word's first guard is, and where its last one ends."""
        n = self.hi - self.lo
        last = np.append(self.piece[1:] != self.piece[:-1], True)[: len(n)]
        size = 1 + n + 2 * last
        start = np.cumsum(size) - size
        out = np.full(int(size.sum()), 0x20, np.uint8)
        out[ragged(start + 1, n)] = self.data[ragged(self.lo, n)]
        out[(start + n + 2)[last]] = 0x0A
        return out.tobytes(), start, start + n + 2


def _cut(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of BLOCK bytes or a little more that end where a piece does."""
    lo = 0
    while len(text) - lo > BLOCK:
        for far in range(lo + BLOCK, len(text) + BLOCK, BLOCK):
            ends = np.flatnonzero(_FOLD[text[far : far + BLOCK]] == 0x0A)
            if len(ends):
                yield text[lo : far + int(ends[0])]
                lo = far + int(ends[0]) + 1
                break
        else:
            break
    yield text[lo:]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """Blocks of the rows' texts (lang, text) by language; all that wait together are about BLOCK bytes."""
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        data = data.copy()  # the batch goes before its texts do
        for lang, lo, hi in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            for part in _cut(data[lo:hi]):
                waiting.setdefault(lang, []).append(part)
                size += len(part)
                if size >= BLOCK:
                    yield from ((k, Block(k, v)) for k, v in waiting.items())
                    waiting, size = {}, 0
    yield from ((k, Block(k, v)) for k, v in waiting.items())


class Sketch:
    """Upper bounds of frequencies: the lesser of two cells, which count up to ``top`` and stop."""

    def __init__(self, bits: int, top: int, cells: np.ndarray | None = None):
        self.bits, self.top = bits, top
        self.cells = np.zeros(1 << bits, np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else np.int64) if cells is None else cells

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = U((1 << self.bits) - 1)
        return (hashes & low).astype(np.int64), ((hashes >> U(self.bits)) & low).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            at, n = np.unique(at, return_counts=True)
            self.cells[at] = np.minimum(self.cells[at] + n, self.top).astype(self.cells.dtype)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        one, two = self.places(hashes)
        return (self.cells[one] >= self.top) & (self.cells[two] >= self.top)


def _add_up(rows: DataFrame, bits: int, tops: list[int]) -> list[Sketch]:
    """Sum the tasks' sketches, strip by strip; each strip's partition takes them one after another. Sketches of a bounded size reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, have = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for which, strip, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                more = np.frombuffer(unzip.decompress(raw), Sketch(0, tops[which]).cells.dtype)
                old = have.get((which, strip))
                have[which, strip] = more if old is None else np.minimum(old.astype(np.int64) + more, tops[which]).astype(more.dtype)
        for (which, strip), cells in have.items():
            yield _strip(which, strip, cells.tobytes())

    out = [Sketch(bits, t) for t in tops]
    for row in rows.repartition("which", "strip").mapInArrow(run, _STRIPS).collect():
        cells = np.frombuffer(bytes(row.cells), out[row.which].cells.dtype)
        out[row.which].cells[row.strip * STRIP : row.strip * STRIP + len(cells)] = cells
    return out


_STRIPS = "which int, strip int, cells binary"


def _strip(which: int, strip: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([strip], pa.int32()), pa.array([raw], pa.binary())], names=["which", "strip", "cells"])


def _strips(sketches: list[Sketch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for which, sketch in enumerate(sketches):
        for lo in range(0, len(sketch.cells), STRIP):
            cells = sketch.cells[lo : lo + STRIP]
            if cells.any():
                yield _strip(which, lo // STRIP, zip_.compress(cells.tobytes()))


def sketches(rows: DataFrame, size: int, least: int, longest: int) -> tuple[Sketch, Sketch, Sketch]:
    """Sketches of words and pairs, and of the longer phrases whose pairs all pass the first; a filter of the words in pairs that pass. ``rows``: lang, text, of ``size`` bytes in all."""
    bits = min(LARGEST, max(SMALLEST, math.ceil(math.log2(size / 4 + 1))))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits, least)
        for _, block in blocks(batches):
            for k in (1, 2):
                own.add(block.phrases(k)[1])
        yield from _strips([own])

    first = _add_up(rows.mapInArrow(short, _STRIPS), bits, [least])[0]
    shared = rows.sparkSession.sparkContext.broadcast(first.cells)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, own, inside = Sketch(bits, least, shared.value), Sketch(bits, least), Sketch(bits, 1)
        for _, block in blocks(batches):
            at, hashes = block.phrases(2)
            good = np.zeros(len(block.words) + longest, bool)
            good[at[pairs.passes(hashes)]] = True
            _, words = block.phrases(1)
            inside.add(words[(good | np.append(False, good[:-1]))[: len(words)]])
            for k in range(3, longest + 1):
                at, hashes = block.phrases(k)
                ok = np.ones(len(at), bool)
                for j in range(k - 1):
                    ok &= good[at + j]
                own.add(hashes[ok])
        yield from _strips([own, inside])

    return first, *_add_up(rows.mapInArrow(long, _STRIPS), bits, [least, 1])


def candidates(block: Block, first: Sketch, second: Sketch, inside: Sketch, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of words of the block's distinct phrases (words too) whose upper bounds, and those of all their parts, reach the frequency."""
    before, found = None, []  # phrases of k - 1 words that pass, by their first words
    for k in range(1, longest + 1):
        at, hashes = block.phrases(k)
        ok = first.passes(hashes) & inside.passes(hashes) if k == 1 else before[at] & before[at + 1]
        at, hashes = at[ok], hashes[ok]
        if k > 1:
            ok = (first if k == 2 else second).passes(hashes)
            at, hashes = at[ok], hashes[ok]
        before = np.zeros(len(block.words) + longest, bool)
        before[at] = True
        _, one = np.unique(hashes, return_index=True)
        found.append((at[one], np.full(len(one), k)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def count_matches(guarded: str, phrases: list[str]) -> np.ndarray:
    """Occurrences of each guarded phrase, overlaps included, by automata of AUTOMATON characters at most (or one phrase)."""
    import ahocorasick

    out = np.zeros(len(phrases), np.int64)
    sizes = np.cumsum([len(p) for p in phrases])
    lo = 0
    while lo < len(phrases):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + AUTOMATON, "right")))
        automaton = ahocorasick.Automaton()
        for i in range(lo, hi):
            automaton.add_word(phrases[i], i)
        automaton.make_automaton()
        out += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(guarded)), np.int64), minlength=len(phrases))
        lo = hi
    return out


#: Ranges of phrases that pages are dealt by: one for so many bytes of text, within these bounds.
RANGE, FEWEST, MOST = 1 << 26, 64, 4096
#: Rows that a task sums up before it sends them on.
HELD = 1 << 19


def _pages(lang: str, names: list[str], counts: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """A block's counts in pages by range of phrases, compressed."""
    zip_ = zstandard.ZstdCompressor(level=3)
    parts: list[list[int]] = [[] for _ in range(ranges)]
    for i, p in enumerate(names):
        parts[zlib.crc32(p.encode()) % ranges].append(i)
    for r, rows in enumerate(parts):
        if rows:
            raw = zip_.compress("\n".join([names[i] for i in rows]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang], pa.string()), pa.array([raw], pa.binary()), pa.array([counts[rows].astype("<i8").tobytes()], pa.binary())], names=["range", "lang", "phrases", "counts"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages added up: a row for each language and phrase, or several if a task meets more than HELD of them."""
    unzip, held = zstandard.ZstdDecompressor(), {}

    def rows() -> pa.RecordBatch:
        langs, names = zip(*held, strict=True) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "phrase", "f"])

    for batch in batches:
        for _, lang, raw, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for p, n in zip(unzip.decompress(raw).decode().split("\n"), np.frombuffer(counts, "<i8").tolist(), strict=True):
                held[lang, p] = held.get((lang, p), 0) + n
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def frequent(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, f): exact frequencies of ``least`` or more of phrases of 2 to ``longest`` words and of the words in them; and one row a language with an empty phrase, whose f is the number of all its words. ``rows``: lang, text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST, max(FEWEST, size // RANGE))
    found = sketches(rows, size, least, longest)
    bits, shared = found[0].bits, rows.sparkSession.sparkContext.broadcast([(s.top, s.cells) for s in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, inside = (Sketch(bits, top, cells) for top, cells in shared.value)
        for lang, block in blocks(batches):
            at, k = candidates(block, first, second, inside, longest)
            guarded, start, end = block.guarded()
            names = [guarded[a:b].decode() for a, b in zip(start[at].tolist(), end[at + k - 1].tolist(), strict=True)]
            n = count_matches(guarded.decode(), names)
            yield from _pages(lang, [*(p[1:-1] for p in names), ""], np.append(n, len(block.words)), ranges)

    pages = rows.mapInArrow(run, "range int, lang string, phrases binary, counts binary")
    counts = pages.repartition("range").mapInArrow(_sums, "lang string, phrase string, f long")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def collocations(df: DataFrame, lang: str, text: str, least: int = 100, longest: int = 5, most: int = 2000, unknown: str = "und") -> DataFrame:
    """The first ``most`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A text is lower-cased in A to Z, cut at ``[.,;:!?\\\\x0A-\\\\x0D]`` into pieces and these into words ``[^\\\\x20\\\\x09]+``; null texts have none, a null language is
    ``unknown``. ``n``: all words of the language; f: occurrences within pieces, overlaps included. Candidates are phrases of 2 to ``longest`` words with
    a = f of ``least`` or more. A cut after the first k words has l and r, the frequencies of both parts, and the score floor(1000 * a * n / (l * r)), worked out in
    decimals of 38 digits, exact; the least score counts, of several the least k. A candidate whose words lie inside a longer candidate of the same
    frequency is dropped. Order: score and a from the greatest, then the phrase by its bytes. Rows are counted each, repeated or not; other columns
    are not read; an empty table, or one without candidates, gives an empty table.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    rows = df.select(F.coalesce(F.col(lang), F.lit(unknown)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = keep(frequent(rows, least, longest), "phrases")
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = counts.filter("phrase <> ''").withColumn("size", F.size(F.split("phrase", " ")))
    longer = counts.filter("size > 1")

    # Inside a longer one of the same frequency: then also inside one that has one word more, before or after.
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " ")))
    covered = longer.filter("size > 2").select("lang", "f", inner.alias("phrase")).distinct()
    left = longer.join(covered, ["lang", "phrase", "f"], "left_anti")

    # A frequent word is a part of very many phrases; its row is copied to SALTS parts.
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    parts = left.select("lang", "phrase", "size", F.col("f").alias("a"), cuts.alias("k"))
    words = F.split("phrase", " ")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    parts = parts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"), salt.alias("salt"))
    known = counts.select("lang", "phrase", "f", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"))
    for name, size, out in (("head", F.col("k"), "l"), ("tail", F.col("size") - F.col("k"), "r")):
        own = F.when(size == 1, F.col("salt")).otherwise(-1)
        parts = parts.withColumn("by", own).join(known.select("lang", F.col("phrase").alias(name), F.col("salt").alias("by"), F.col("f").alias(out)), ["lang", name, "by"]).drop("by")
    # One row a language; so few are surely small.
    parts = parts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", wide("a", 17) * (wide("n", 17) * F.lit(1000).cast("decimal(4,0)")), wide("l", 19) * wide("r", 19))
    scored = parts.withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*").drop("k")

    # First within each of many parts, then among the few that are left.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase", F.lit(1)), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select(F.col("lang").alias(lang), "rank", "phrase", "a", "l", "r", "n", "score")
