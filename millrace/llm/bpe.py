"""BPE encoding and decoding through a table of distinct words.

1. Each part of the input (some rows of a file, of bounded size) sends on its distinct words.
2. Dealt by word, each distinct word is encoded once.
3. The ids go back to the parts that have the word, as pages of a dictionary; dealt by part,
   the dictionary comes first and the texts after it, and ids are put in the words' positions.

What is shuffled for a word is one row per part that has it, however often it occurs,
so frequent words are no hot keys, and no dictionary of the whole corpus is ever in one place.
Decoding joins ids with the table of pieces: one row per id of the vocabulary, so its size is known, and it is broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.hashing import U, ragged
from millrace.llm.tables import keep, pieces, text_bytes
from millrace.llm.wordbpe import PIECE, WordCoder, word_key

_PAGE = 1 << 16
#: Bytes of texts in a part, or one longer text: what a part's dictionary and texts take in a task has a bound.
PART = 1 << 26


def _parts(df: DataFrame, key: str, text: str, rows: int = 12288) -> DataFrame:
    """key, text, and ``part``: which ``rows`` rows of which file a row is among; every scan says the same. Rows that come from no file are written to one first."""
    part = F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {rows}")).alias("part")
    mine = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    try:
        return df.select(*[F.col(c).alias(n) for c, n in ((key, "key"), (text, "text"))], part) if "_metadata" not in df.columns else keep(mine, "texts").select("key", "text", part)
    except AnalysisException:
        return keep(mine, "texts").select("key", "text", part)


class _Cut:
    """Parts of many rows become parts of PART bytes: a task cuts each where it passes a multiple of that (``most``). Each scan cuts alike, as its tasks see the same rows."""

    def __init__(self, most: int):
        self.most, self.mark, self.size = most, None, 0

    def __call__(self, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = marks.copy()
        for lo, hi in _same(marks):
            if marks[lo] != self.mark:
                self.mark, self.size = marks[lo], 0
            ends = self.size + np.cumsum(sizes[lo:hi])
            out[lo:hi] += (ends - sizes[lo:hi]) // self.most * -7046029254386353131
            self.size = int(ends[-1])
        return out


def distinct_words(parts: DataFrame, tokenizer: str, most: int = PART) -> DataFrame:
    """(word, part): the words that each part has, as the tokenizer splits them; a few repeats are possible. Texts that cannot be split have none."""

    return parts.select("text", "part").mapInArrow(lambda batches: _distinct(batches, tokenizer, most), "word string, part long")


def _distinct(batches: Iterator[pa.RecordBatch], tokenizer: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    seen, part, cut = WordCoder(tokenizer), None, _Cut(most)
    for batch in batches:
        for rows, _, at in pieces(batch, "text", PIECE):
            marks = cut(rows.column(1).to_numpy(zero_copy_only=False), np.diff(at))
            for lo, hi in _same(marks):
                if marks[lo] != part:
                    seen._clear()
                    part = marks[lo]
                ready = [seen._normal(t or "") or "" for t in rows.column(0).slice(lo, hi - lo).to_pylist()]
                joined, start, end, keys, first, whole = seen.words(ready)
                new = np.flatnonzero(seen._find(keys) < 0)
                new = new[np.unique(keys[new], return_index=True)[1]]
                if seen.n + len(new) > seen.keep_words:
                    seen._clear()
                while len(new) > seen.keep_words:  # one text with more words than there is room for
                    seen.grow()
                if len(new):
                    seen._add(keys[new], np.empty(0, np.int32), np.zeros(len(new), np.int32))
                    words = [joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.full(len(words), part))], names=["word", "part"])


def _same(marks: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.append(0, np.flatnonzero(marks[1:] != marks[:-1]) + 1) if len(marks) else np.empty(0, int)
    return zip(cut.tolist(), np.append(cut[1:], len(marks)).tolist(), strict=True)


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Deal by word, encode each distinct word once, and return pages of each part's dictionary: word keys, numbers of ids, and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = WordCoder(tokenizer), {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys, part = word_key(texts), batch.column(1).to_numpy()
            new = np.flatnonzero(held._find(keys) < 0)
            new = new[np.unique(keys[new], return_index=True)[1]]
            if held.n + len(new) > held.keep_words:
                held._clear()
                new = np.unique(keys, return_index=True)[1]
            while len(new) > held.keep_words:
                held.grow()
            held._add(keys[new], *held._library([texts[i] for i in new]))
            at = held._find(keys)
            order = np.argsort(part, kind="stable")
            for lo, hi in _same(part[order]):
                rows = order[lo:hi]
                n = held.lengths[at[rows]]
                page = waiting.setdefault(int(part[rows[0]]), [])
                page.append((keys[rows], n, held.pool[ragged(held.starts[at[rows]], n.astype(np.int64))]))
                if sum(len(x[0]) for x in page) >= _PAGE:
                    yield _page(int(part[rows[0]]), waiting.pop(int(part[rows[0]])))
            if sum(len(x[0]) for p in waiting.values() for x in p) > 1 << 20:
                for k in list(waiting):
                    yield _page(k, waiting.pop(k))
        for k, page in waiting.items():
            yield _page(k, page)

    return words.repartition("word").mapInArrow(run, "part long, keys binary, counts binary, ids binary")


def _page(part: int, page: list[tuple]) -> pa.RecordBatch:
    keys, counts, ids = (np.concatenate(c) for c in zip(*page, strict=True))
    small = _width(ids)
    return pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([x.tobytes()], pa.binary()) for x in (keys, counts.astype(_width(counts)), ids.astype(small))]], names=["part", "keys", "counts", "ids"])


def _width(values: np.ndarray) -> type:
    return np.uint16 if not len(values) or values.max() < 1 << 16 else np.int32


def _turn(page: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, raw = np.frombuffer(page[0], U), page[2]
    counts = np.frombuffer(page[1], np.int32 if len(page[1]) == 4 * len(keys) else np.uint16).astype(np.int32)
    wide = len(raw) == 4 * int(counts.sum()) and len(raw) > 0
    return keys, np.frombuffer(raw, np.int32 if wide else np.uint16), counts


def encode(df: DataFrame, key: str, text: str, tokenizer: str, part_bytes: int = PART) -> DataFrame:
    """Ids of every whole text, as the tokenizers library gives them without special tokens added.

    Returns the key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit). Null texts are empty
    (no ids). Repeated rows and null keys stay; an empty table gives an empty table. Only the
    key and the text are read, so other columns cannot clash.
    """
    parts = _parts(df, key, text)
    kind = dict(parts.dtypes)["key"]
    pages = encode_words(distinct_words(parts, tokenizer, part_bytes), tokenizer)
    both = pages.select("part", F.lit(0).alias("kind"), F.lit(None).cast(f"array<{kind}>").alias("docs"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.col("ids").alias("c"))
    both = both.unionByName(_text_pages(parts, kind, part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, unzip = WordCoder(tokenizer), None, zstandard.ZstdDecompressor()
        for batch in batches:
            marks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                if marks[i] != part:
                    words._clear()
                    part = marks[i]
                a, b = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                if kinds[i] == 0:
                    keys, ids, counts = _turn((a, b, batch.column(5)[i].as_py()))
                    fresh = np.flatnonzero(words._find(keys) < 0)
                    fresh = fresh[np.unique(keys[fresh], return_index=True)[1]]
                    while words.n + len(fresh) > words.keep_words:
                        words.grow()
                    at = np.cumsum(counts, dtype=np.int64) - counts
                    words._add(keys[fresh], ids[ragged(at[fresh], counts[fresh].astype(np.int64))], counts[fresh])
                    continue
                at = np.append(0, np.cumsum(np.frombuffer(b, np.uint32), dtype=np.int64))
                raw = unzip.decompress(a, max_output_size=int(at[-1]) + 1)
                ids, to = words.put([raw[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                blob = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((to * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, pa.array(np.diff(to), pa.int64()), blob], names=["key", "n_tokens", "ids"])

    dealt = both.repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def _text_pages(parts: DataFrame, kind: str, most: int = PART) -> DataFrame:
    """About a megabyte of texts to a row, compressed: a third of what single rows take in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, cut = zstandard.ZstdCompressor(level=6), _Cut(most)
        for batch in batches:
            marks = cut(batch.column(2).to_numpy(), np.diff(text_bytes(batch.column(1))[1]))
            for lo, hi in _same(marks):
                for rows, data, at in pieces(batch.slice(lo, hi - lo), "text", 2 * PIECE):
                    docs = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array(marks[lo : lo + 1]), pa.array([1], pa.int32()), docs, *[pa.array([x], pa.binary()) for x in (zip_.compress(data.tobytes()), np.diff(at).astype(np.uint32).tobytes(), None)]], names=["part", "kind", "docs", "a", "b", "c"])

    return parts.select("key", "text", "part").mapInArrow(run, f"part long, kind int, docs array<{kind}>, a binary, b binary, c binary")


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the bytes that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    spec = json.loads(open(tokenizer, encoding="utf-8").read())
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level pieces can be joined")
    # The rule of byte-level pieces: a printable Latin-1 byte stands for itself, the others for 256, 257, ... in turn.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    rows = [(i, bytearray(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())) for piece, i in vocab.items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(df: DataFrame, ids: str, tokenizer: str, output: str = "decoded") -> DataFrame:
    """Add the text that a document's ids (little-endian unsigned 32-bit) stand for; special tokens are kept.

    The join with the table of pieces is a broadcast one: as an array over ids, it turns all ids of a batch into bytes at once.
    Null ids are empty. Bytes that are no UTF-8 become U+FFFD; an id without a piece is an error. A column of ``df`` called like
    ``output`` is an error.
    """
    if output in df.columns:
        raise ValueError(f"there is a column {output} already")
    table = piece_table(df.sparkSession, tokenizer).toArrow().sort_by("id")
    at = table.column("id").to_numpy()
    length = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.int64)
    length[at] = [len(x) for x in table.column("piece").to_pylist()]
    known = np.zeros(len(length), bool)
    known[at] = True
    shared = df.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table.column("piece").to_pylist()), np.uint8), np.append(0, np.cumsum(length)), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, bounds, there = shared.value
        for batch in batches:
            for rows, data, at in pieces(batch, ids, 4 * PIECE):
                each = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
                if len(each) and (each.max() >= len(there) or not there[each].all()):
                    raise ValueError("an id without a piece")
                n = bounds[each + 1] - bounds[each]
                text = pool[ragged(bounds[each], n)].tobytes()
                ends = np.append(0, np.cumsum(n))[at // 4]
                texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, output])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{output}` string")


__all__ = ["decode", "distinct_words", "encode", "encode_words", "piece_table"]
