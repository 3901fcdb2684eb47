"""Token ids in files of independent zstandard frames with a seek table at the end.

A file is in the public zstd seekable format: one frame per document; a skippable
frame with the documents' keys; and the seek table, again a skippable frame, with
the sizes and the checksum (low 32 bits of XXH64 of the content) of every frame. A
reader takes the table from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.tables import keep, new_path, pieces
from millrace.llm.wordbpe import PIECE, coder

#: Fixed values of the format: magic numbers of skippable frames (the seek table's has number 14) and of the table's end.
_KEYS_MAGIC, _TABLE_MAGIC, _END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class TokenWriter:
    """Writes one file; it appears under its name only when complete, so a task that runs twice does no harm."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.out, self.width = self.fs.open_output_stream(self.partial, compression=None, buffer_size=1 << 20), width
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.keys.append(key)

    def close(self) -> None:
        valid = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        content = self.zstd.compress(valid.tobytes() + keys.tobytes())
        content = struct.pack("<B", self.width) + content
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, _END_MAGIC)
        self.out.write(struct.pack("<II", _KEYS_MAGIC, len(content)) + content)
        self.out.write(struct.pack("<II", _TABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.partial, self.path)


class TokenReader:
    """Opens a file by its table; frames are read and checked one at a time."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _END_MAGIC or not flags & 0x80:
            raise ValueError(f"{path}: no seek table at its end")
        self.entries = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, size - 9 - n * _ENTRY.itemsize), _ENTRY)
        self.starts = np.append(0, np.cumsum(self.entries["packed"].astype(np.int64)))
        _, length = struct.unpack("<II", self.file.read_at(8, int(self.starts[-1])))
        content = self.file.read_at(length, int(self.starts[-1]) + 8)
        self.width = content[0]
        raw = zstandard.ZstdDecompressor().decompress(content[1:], max_output_size=9 * n + 1)
        self.valid, self.keys = np.frombuffer(raw[:n], np.uint8).astype(bool), np.frombuffer(raw[n:], "<i8")
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def tokens(self) -> np.ndarray:
        """How many ids each frame has, from the table alone."""
        return self.entries["size"].astype(np.int64) // self.width

    def _unpack(self, i: int, frame) -> np.ndarray:
        raw = self.zstd.decompress(frame, max_output_size=int(self.entries["size"][i]) + 1)
        if len(raw) != self.entries["size"][i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["checksum"][i]:
            raise ValueError(f"frame {i}: its checksum does not hold")
        return np.frombuffer(raw, f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self._unpack(i, self.file.read_at(int(self.entries["packed"][i]), int(self.starts[i])))

    def all(self, block: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every frame in turn, read by blocks of about ``block`` bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + block, "right")) - 1)
            data = memoryview(self.file.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i])))
            for k in range(i, j):
                yield k, self._unpack(k, data[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]])
            i = j


def write_tokens(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, path: str | None = None, width: int = 2, file_mb: int = 64) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending order of the key; returns their manifest.

    One shuffle deals rows by ranges of the key (ties by a hash of the text), each range becomes a file.
    Manifest: ``file``, ``part``, ``n_docs``, ``n_tokens``, ``start`` (ids in all files before it), ``least`` and
    ``most`` key. Null texts are empty: just the end id. Null keys come first.
    Repeated rows are written as often as they occur; an empty table gives an empty
    manifest. ``width``: bytes of an id (2 for vocabularies of 65,536 at most, else 4); too few are an error. Keys are integers. Other columns are not read.
    """
    spark = df.sparkSession
    if max(end_id + 1, coder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)) > 1 << (8 * width):
        raise ValueError(f"ids of this vocabulary need more than {width} bytes")
    if dict(df.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("keys must be integers")
    folder = path or new_path(spark, "tokens")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-total // (file_mb << 20)))
    dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, writer, count, keys = f"{folder}/part-{part:06d}.zst", None, 0, []
        for batch in batches:
            for rows_, _, _ in pieces(batch, "text", 4 * PIECE):
                ids, at = coder(tokenizer).encode(rows_.column(1).to_pylist())
                writer = writer or TokenWriter(name, width)
                for i, k in enumerate(rows_.column(0).to_pylist()):
                    writer.add(k, np.append(ids[at[i] : at[i + 1]], end_id))
                    keys.append(k)
                count += len(ids) + rows_.num_rows
        if writer:
            writer.close()
            known = [k for k in keys if k is not None]
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_docs": len(keys), "n_tokens": count, "least": min(known, default=None), "most": max(known, default=None)}], schema=out)

    out = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
    manifest = keep(dealt.mapInArrow(run, "file string, part int, n_docs long, n_tokens long, least long, most long"), "manifest")
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


_READ = "doc_id long, start long, n_tokens long, ids binary"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the files, in their order: ``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, block, size = TokenReader(row["file"]), [], 0
                before = row["start"] + np.append(0, np.cumsum(reader.tokens()))
                for i, ids in reader.all():
                    block.append((int(reader.keys[i]) if reader.valid[i] else None, int(before[i]), len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield _batch(block)
                        block, size = [], 0
                if block:
                    yield _batch(block)

    return manifest.select("file", "start").repartition(max(1, manifest.count()), "file").mapInArrow(run, _READ)


def read_documents(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """Only the documents with these keys: files by the manifest's ranges, frames by the seek tables."""
    wanted = sorted(set(keys))
    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("least") <= k) & (F.col("most") >= k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = TokenReader(row["file"])
                before = row["start"] + np.append(0, np.cumsum(reader.tokens()))
                at = np.flatnonzero(np.isin(reader.keys, wanted) & reader.valid)
                if len(at):
                    yield _batch([(int(reader.keys[i]), int(before[i]), len(x := reader.ids(i)), x.astype("<u4").tobytes()) for i in at])

    return manifest.filter(hit).select("file", "start").mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def token_crc(ids: str = "ids"):
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return F.crc32(F.col(ids))


__all__ = ["TokenReader", "TokenWriter", "read_documents", "read_tokens", "token_crc", "write_tokens"]
