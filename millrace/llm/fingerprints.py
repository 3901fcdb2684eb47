"""Canonical exact fingerprints of documents.

Canonical form: NFKC, case folding, NFKC again, white space runs as one space. Its XXH3 digest of
128 bits is the fingerprint; documents in one bucket are compared byte by byte, and should
two different canonical texts ever share a digest, a number after it tells them apart.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.tables import keep

#: Bits of the filter that says which digests may occur twice: 2 MB at most, whatever the input.
_FILTER_DIGITS = 6
_FILTER_BITS = 1 << (4 * _FILTER_DIGITS)


def canonical(text: str | None) -> bytes:
    """The canonical form in UTF-8; null is empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, digits: int = 32) -> str:
    return xxhash.xxh3_128_hexdigest(form)[:digits]


def _repeated_filter(table: DataFrame) -> np.ndarray:
    """One bit for the first digits of each digest that occurs twice or more."""
    at = F.conv(F.rpad(F.substr("digest", F.lit(1), F.lit(_FILTER_DIGITS)), _FILTER_DIGITS, "0"), 16, 10).cast("int")
    twice = table.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("at", at)
    words = twice.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits")).toPandas()
    out = np.zeros(_FILTER_BITS >> 5, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def ordinals(df: DataFrame, key: str, text: str, table: DataFrame, digits: int = 32) -> DataFrame | None:
    """Byte comparison inside equal buckets: (key, digest, tie, n) of the documents whose digest
    stands for several canonical texts, or None if there is none.

    Only canonical texts whose digest may repeat are shuffled, and least and greatest of a
    bucket combine on the map side, so a bucket of any size is a few rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(_repeated_filter(table))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            forms = [canonical(t) for t in batch.column(2).to_pylist()]
            digests = [digest(f, digits) for f in forms]
            at = np.array([int(d[:_FILTER_DIGITS].ljust(_FILTER_DIGITS, "0"), 16) for d in digests], np.int64)
            hit = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit)), pa.array([digests[i] for i in hit], pa.string()), pa.array([forms[i] for i in hit], pa.binary())], names=["key", "tie", "digest", "form"])

    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    forms = rows.mapInArrow(run, f"key {kind}, tie long, digest string, form binary")
    mixed = keep(forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).filter(F.col("least") != F.col("most")).select("digest"), "mixed")
    if mixed.isEmpty():
        return None
    several = keep(forms.join(mixed, "digest"), "several")
    rank = several.select("digest", "form").distinct().withColumn("n", F.row_number().over(W.partitionBy("digest").orderBy("form")) - 1)
    return several.join(rank, ["digest", "form"]).select("key", "tie", "digest", "n").distinct()


def fingerprints(df: DataFrame, key: str, text: str, digits: int = 32) -> DataFrame:
    """``key``, ``tie`` (hash of the text, for repeated keys) and ``fingerprint`` of each row.

    Equal canonical texts have equal fingerprints and others never do. Null texts are empty.
    Repeated rows stay; an empty table gives an empty table.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digest(canonical(t), digits) for t in batch.column(2).to_pylist()], pa.string())], names=["key", "tie", "digest"])

    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    table = keep(rows.mapInArrow(run, f"key {kind}, tie long, digest string"), "digests")
    out = _numbered(table, ordinals(df, key, text, table, digits))
    return out.select(F.col("key").alias(key), "tie", "fingerprint")


def _numbered(table: DataFrame, several: DataFrame | None) -> DataFrame:
    if several is None:
        return table.withColumn("fingerprint", F.concat("digest", F.lit("-0")))
    s = several.select(F.col("key").alias("__k"), F.col("tie").alias("__t"), "n")
    out = table.join(s, table["key"].eqNullSafe(s["__k"]) & (table["tie"] == s["__t"]), "left")
    return out.withColumn("fingerprint", F.concat("digest", F.lit("-"), F.coalesce("n", F.lit(0)).cast("string"))).drop("__k", "__t", "n")


def groups(prints: DataFrame, key: str) -> DataFrame:
    """``fingerprint``, number of documents and least key of each group of equal fingerprints; combines on the map side."""
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_docs"), F.min(key).alias("least"))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR = "n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double, form binary, edited_form binary"
_PAIR_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]


def _compare(text: str, form: bytes, following: str, next_form: bytes, digits: int) -> tuple:
    changed = edited(text, following)
    other = canonical(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(form, digits), digest(other, digits), float(form == other), float(form == next_form), *(hashlib.sha256(x).digest() for x in (form, other)))


def compare_with_next(df: DataFrame, key: str, text: str, digits: int = 32, part_mb: int = 48) -> DataFrame:
    """Fingerprint each text, its edited text (:func:`edited`) and compare with both.

    The following document is the next by ascending key (nulls first, ties by a hash of the
    text), after the last the first. Texts are dealt once by ranges of the key and read in order; the
    last row of a range meets the first of the next in a second small step. Returns the key,
    ``tie``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` (1 if the
    canonical bytes are equal, else 0). Documents with one digest are compared byte by byte; edited texts, which are not kept, by
    the SHA-256 of their canonical form, with documents and with each other. Null texts are empty.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-total // (part_mb << 20)))
    kind = dict(df.dtypes)[key]
    dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
    names = ["part", "edge", "text", "key", "tie", *[c.split()[0] for c in _PAIR.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        make = lambda head, keys, ties, pairs: pa.RecordBatch.from_arrays(
            [pa.array([h[i] for h in head], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))] + [keys, ties]
            + [pa.array([p[i] for p in pairs], t) for i, t in enumerate(_PAIR_KINDS)], names=names)
        none = (None,) * len(_PAIR_KINDS)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            forms = [canonical(t) for t in texts]
            if last is None:
                yield make([(part, "first", texts[0])], batch.column(0).slice(0, 1), batch.column(2).slice(0, 1), [none])
            else:
                yield make([(part, None, None)], last[2], last[3], [_compare(last[0], last[1], texts[0], forms[0], digits)])
            m = len(texts) - 1
            if m:
                yield make([(part, None, None)] * m, batch.column(0).slice(0, m), batch.column(2).slice(0, m), [_compare(texts[i], forms[i], texts[i + 1], forms[i + 1], digits) for i in range(m)])
            last = (texts[m], forms[m], batch.column(0).slice(m), batch.column(2).slice(m))
        if last is not None:
            yield make([(part, "last", last[0])], last[2], last[3], [none])

    done = keep(dealt.mapInArrow(run, f"part int, edge string, text string, key {kind}, tie long, {_PAIR}"), "compared")
    # As many rows as there are ranges: the next range that has rows, after the last the first.
    order = W.orderBy("part")
    firsts = done.filter("edge = 'first'").select("part", F.col("text").alias("following"))
    ranges = firsts.select("part").withColumn("to", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    ends = done.filter("edge = 'last'").select("part", "key", "tie", "text").join(ranges, "part").drop("part").join(firsts.withColumnRenamed("part", "to"), "to")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_compare(t, canonical(t), f, canonical(f), digits) for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array([p[i] for p in pairs], t) for i, t in enumerate(_PAIR_KINDS)], names=names[3:])

    ends = ends.select("key", "tie", "text", "following").mapInArrow(finish, f"key {kind}, tie long, {_PAIR}")
    table = done.filter("edge IS NULL").drop("part", "edge", "text").unionByName(keep(ends, "ends"))
    # Canonical texts of documents and edited texts that share a digest: the least and greatest of their SHA-256, as 64 bits, differ.
    both = table.select("digest", "form").unionByName(table.select(F.col("edited_digest").alias("digest"), F.col("edited_form").alias("form")))
    short = F.xxhash64("form")
    mixed = both.groupBy("digest").agg(F.min(short).alias("least"), F.max(short).alias("most")).filter("least <> most").select("digest")
    mixed = keep(mixed, "mixed")
    if ordinals(df, key, text, table, digits) is None and mixed.isEmpty():
        out = table.withColumn("n", F.lit(0)).withColumn("edited_n", F.lit(0))
    else:
        rank = both.join(mixed, "digest", "left_semi").distinct().withColumn("n", F.row_number().over(W.partitionBy("digest").orderBy("form")) - 1)
        out = table.join(rank, ["digest", "form"], "left").join(rank.toDF("edited_digest", "edited_form", "edited_n"), ["edited_digest", "edited_form"], "left")
    name = lambda d, n: F.concat(F.col(d), F.lit("-"), F.coalesce(F.col(n), F.lit(0)).cast("string"))
    return out.select(F.col("key").alias(key), "tie", "n_chars", "edited_sha256", name("digest", "n").alias("fingerprint"), name("edited_digest", "edited_n").alias("edited_fingerprint"), "near_edited", "near_next")
