"""BPE, packing, sharding and token files against the tokenizers library, and round trips."""

import functools
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, packing, sharding, token_files
from millrace.llm.wordbpe import WordCoder, word_key

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [
    None, "", " ", "\n", "a", "a  b\t\tc \n\n d", "it's we'll I'm THEY'RE 'sfoo ''s 's's x'", "don’t ’s", "<|endoftext|> and <|startoftext|>x", "12345 1a2b", "naïve É Σίσυφος ΣΑΣ ß ﬁ",
    "é ö Å", "日本語 テスト 中文", "😀 a😀b 👩‍👩‍👧", " x   y 　", "\x00\x01\x7f", "﻿bom", "a" * 300, "ab" * 4000, "x" * 70_000 + " y", "word " * 3000, " \r\n \x0b\x0c end  ", "͸ unassigned \U0001fae8",
]
FREE = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'’sdmtrevl 019aAÉéΣςßİıﬁ  　́日😀"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.mark.parametrize("name", [BYTES, WORDS])
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(FREE, max_size=4))
def test_coder_equals_library(name, texts):
    ids, at = coder(name).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


@functools.cache
def coder(name):
    return WordCoder(public_tokenizers.path(name), keep_words=500)


@functools.cache
def library(name):
    return brute.tokenizer(name)


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_coder_on_odd_texts(name):
    c = WordCoder(public_tokenizers.path(name), keep_words=16)  # less room than words
    ids, at = c.encode(ODD)
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == library(name).encode(t or "", add_special_tokens=False).ids, t


def test_word_keys_agree():
    c = WordCoder(public_tokenizers.path(BYTES))
    joined, lo, hi, keys, _, _ = c.words(["some words here", "x" * 500])
    assert (word_key([joined[a:b] for a, b in zip(lo, hi, strict=True)]) == keys).all()


def odd_docs(spark):
    """Every odd text, one twice with its key, and one without a key; columns with the operators' own names."""
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no key at all")]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.select("doc_id", F.lit("k").alias("key"), F.lit(1).alias("tie"), F.lit(2).alias("part"), "text", F.lit(3).alias("ids"), F.lit("s").alias("shard"), F.lit(4).alias("__key")), rows


def test_encode_and_decode(spark):
    df, rows = odd_docs(spark)
    path = public_tokenizers.path(BYTES)
    got = bpe.decode(bpe.encode(df, "doc_id", "text", path), "ids", path).collect()
    want = []
    for i, t in rows:
        ids = library(BYTES).encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.id_bytes(ids), library(BYTES).decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode(df.limit(0), "doc_id", "text", path).collect() == []


def test_decode_joins_any_ids(spark):
    path, rng = public_tokenizers.path(BYTES), np.random.default_rng(1)
    ids = [rng.integers(0, 50257, 50).tolist() for _ in range(20)] + [[]]
    df = spark.createDataFrame([(bytearray(brute.id_bytes(x)),) for x in ids] + [(None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(df, "ids", path).collect()] == [library(BYTES).decode(x, skip_special_tokens=False) for x in ids] + [""]


def test_more_words_than_room(spark, monkeypatch):
    """Tables of 16 words: texts with many more of them are encoded all the same, and a full table is an error, not a loop."""
    made = WordCoder.__init__
    monkeypatch.setattr(WordCoder, "__init__", lambda self, path, keep_words=16: made(self, path, 16))
    text = " ".join(f"word{i}" for i in range(700))
    path = public_tokenizers.path(BYTES)
    parts = bpe._parts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text")
    rows = [r.word for b in [parts.select("text", "part").toArrow().to_batches()] for x in bpe._distinct(iter(b), path) for r in x.to_pandas().itertuples()]
    assert len(rows) == len(set(rows)) > 700
    c = WordCoder(path)
    with pytest.raises(ValueError, match="no room"):
        c._slots(np.arange(1, 100, dtype=np.uint64), np.arange(99))
    ids, _ = c.encode([text])
    assert ids.tolist() == library(BYTES).encode(text, add_special_tokens=False).ids


def test_texts_with_new_characters_go_through_the_table():
    c = WordCoder(public_tokenizers.path(BYTES))
    texts = ["plain words", "emoji 🫨 here's one", "", "two \U0001fae8\U0001fae8  x\n\u0378y", "end"]
    _, lo, hi, _, first, whole = c.words(texts)
    assert not whole.any() and first.tolist() == np.append(0, np.cumsum([len(c.tokenizer.pre_tokenizer.pre_tokenize_str(t)) for t in texts])).tolist()
    assert (lo[1:] >= hi[:-1]).all()


def test_decode_errors(spark):
    df = spark.createDataFrame([(bytearray(brute.id_bytes([60_000])), "x")], "ids binary, decoded string")
    with pytest.raises(ValueError, match="already"):
        bpe.decode(df, "ids", public_tokenizers.path(BYTES))
    with pytest.raises(Exception, match="without a piece"):
        bpe.decode(df.drop("decoded"), "ids", public_tokenizers.path(BYTES)).collect()


def test_bin_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 333):
        lengths = rng.integers(0, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        used = []
        for i in np.argsort(-lengths, kind="stable"):
            b = next((b for b, u in enumerate(used) if u + lengths[i] <= 100), len(used))
            used += [0] * (b == len(used))
            assert (bins[i], offsets[i]) == (b, used[b])
            used[b] += lengths[i]


def check_packed(rows, docs, capacity):
    """Pieces cover each document's ids once, sequences have no gaps; returns the share that is padding."""
    ids = {i: library(WORDS).encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert set(pieces) == set(ids)
    copies = defaultdict(int)
    for i, _ in docs:
        copies[i] += 1
    for parts, end in [(sorted(p * 1 for p in v), len(ids[i])) for i, v in pieces.items() if copies[i] == 1] + [(sorted(v), None) for v in seqs.values()]:
        at = 0
        for start, n in parts:
            assert start == at
            at += n
        assert at == end if end is not None else at <= capacity
    return 1 - sum(r.length for r in rows) / (capacity * len(seqs))


def test_packing(spark):
    df, rows = odd_docs(spark)
    cut = packing.token_pieces(df, "doc_id", "text", public_tokenizers.path(WORDS), 2, 256)
    got = packing.pack(cut, "length", 256, group_items=40).collect()
    check_packed(got, rows, 256)
    assert len(got) == cut.count()
    assert packing.pack(cut.limit(0), "length", 256).collect() == []
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(cut, "length", 8).collect()


def test_packing_query(spark):
    from millrace.llm.queries import op4_packing

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert check_packed(op4_packing(spark, "/root/testdata/sf0.001").collect(), docs, 4096) < 0.06


def test_sharding(spark):
    keys = [*range(5000), *[7] * 3000, None, None]
    df = spark.createDataFrame([(k, "t" * (i % 9)) for i, k in enumerate(keys)], "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1))
    got = sharding.shard(df, "doc_id", 10, {"size": F.length("text").cast("long")}).collect()
    assert len(got) == len(keys)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 10)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(10))
    assert all(len(v) == 1 for v in of.values())
    moved = sum(next(iter(v))[1] == 10 for v in of.values()) / len(of)
    assert abs(moved - 1 / 11) < 0.02
    # Any number of shards: a key moves only into what is new.
    walk = spark.range(300).select(sharding.jump_shard(F.col("id"), *range(1, 33)).alias("s")).collect()
    for r in walk:
        assert r.s[0] == 0 and all(b in (a, n) for n, (a, b) in enumerate(zip(r.s, r.s[1:]), 1))
    assert sharding.shard(df.limit(0), "doc_id", 10, {"size": F.lit(1)}).collect() == []


def test_walks_are_jump_hashing(spark):
    """A plain walk, one key after another, gives the same shards, also where the first fold is too short for it."""
    import hashlib
    import math

    def plain(key, n):
        at, i = 0, 1
        while True:
            u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:8], 16) + 1) / 2**32
            to = math.floor((at + 1) / u)
            if to >= n:
                return at
            at, i = to, i + 1

    keys = [*range(200), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for steps in (None, 2):
        got = df.select("k", sharding.jump_shard(F.col("k"), 40, 41, 1000, most_steps=steps).alias("s")).collect()
        assert all(r.s == [plain("" if r.k is None else r.k, n) for n in (40, 41, 1000)] for r in got) and len(got) == 201


def test_token_files_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    path = public_tokenizers.path(BYTES)
    with pytest.raises(ValueError, match="more than 1 bytes"):
        token_files.write_tokens(df, "doc_id", "text", path, 0, width=1)
    with pytest.raises(ValueError, match="more than 2 bytes"):
        token_files.write_tokens(df, "doc_id", "text", path, 1 << 16)
    with pytest.raises(ValueError, match="integers"):
        token_files.write_tokens(df.select(F.col("doc_id").cast("string"), "text"), "doc_id", "text", path, 0)


def test_token_files(spark, tmp_path):
    df, rows = odd_docs(spark)
    path = public_tokenizers.path(BYTES)
    manifest = token_files.write_tokens(df, "doc_id", "text", path, 0, path=f"file://{tmp_path}/t")
    got = token_files.read_tokens(manifest).withColumn("crc", token_files.token_crc()).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(BYTES).encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.crc) for r in got), key=lambda r: r[1]) == want
    some = token_files.read_documents(manifest, [3, 6, 999]).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some) == [w[:3] for w in want if w[0] in (3, 6)]
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), "doc_id", "text", path, 0)).collect() == []


def test_token_file_checksums(tmp_path):
    w = token_files.TokenWriter(f"{tmp_path}/x.zst", 2)
    w.add(5, np.arange(1000))
    w.add(None, np.arange(10))
    w.close()
    r = token_files.TokenReader(f"{tmp_path}/x.zst")
    assert len(r) == 2 and r.ids(0).tolist() == list(range(1000)) and r.ids(1).tolist() == list(range(10)) and r.valid.tolist() == [True, False]
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    table = len(raw) - 9 - 2 * 12
    raw[table + 8] ^= 1  # the checksum of the first frame
    (tmp_path / "y.zst").write_bytes(raw)
    bad = token_files.TokenReader(f"{tmp_path}/y.zst")
    assert bad.ids(1).tolist() == list(range(10))
    with pytest.raises(ValueError, match="checksum"):
        bad.ids(0)
    (tmp_path / "z.zst").write_bytes(raw[:-1])
    with pytest.raises(ValueError, match="seek table"):
        token_files.TokenReader(f"{tmp_path}/z.zst")


def test_token_queries(spark):
    from millrace.llm import queries

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    one, eight, start = [], [], 0
    for i, t in sorted(docs):
        ids = library(BYTES).encode(t or "", add_special_tokens=False).ids
        one.append((i, len(ids), brute.sha(brute.id_bytes(ids)), brute.sha(library(BYTES).decode(ids, skip_special_tokens=False))))
        eight.append((i, start, len(ids) + 1, brute.crc([*ids, 0])))
        start += len(ids) + 1
    assert sorted(tuple(r)[:4] for r in queries.op1_bpe(spark, d).collect()) == one
    assert sorted(tuple(r)[:4] for r in queries.op8_token_files(spark, d).collect()) == eight
    five = queries.op5_sharding(spark, d).collect()
    text = dict(docs)
    assert all((r.size, r.text_crc32, r.law) == (len((text[r.doc_id] or "").encode()) + 16, zlib.crc32((text[r.doc_id] or "").encode()), "key") for r in five) and len(five) == len(docs)


def test_parts_are_cut_by_bytes(spark, tmp_path):
    """A few very long texts make several parts, and the ids stay the library's."""
    texts = [f"{i} " + "long words of many kinds " * 400 + f"{i * 7}" for i in range(9)] + ["short", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    cut = bpe._Cut(25_000)
    assert len(set(cut(np.full(9, 5), np.array([len(t) for t in texts[:9]])).tolist())) == 4
    name = public_tokenizers.path(BYTES)
    parts = bpe._parts(docs, "doc_id", "text")
    rows = bpe._text_pages(parts, "bigint", 25_000).collect()
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(docs, "doc_id", "text", name, 25_000).collect()}
    assert got == {i: brute.id_bytes(library(BYTES).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    words = {r.part for r in bpe.distinct_words(parts, name, 25_000).collect()}
    assert len(words) >= 4 and {r.part for r in rows} == words
