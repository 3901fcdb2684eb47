"""Texts made to have equal sums of powers: every operator tells them apart as brute force does."""

import brute
import numpy as np
import public_tokenizers
import pytest
from crafted import ASCII, CHINESE, LETTERS

from millrace.llm import bpe, hashing, neardup, phrases, quality, substrings, suffixes, token_counts
from millrace.llm.wordbpe import WordCoder

PAIRS = [CHINESE, LETTERS, ASCII]


def test_the_pairs_have_equal_sums():
    for a, b in PAIRS:
        values = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64) for w in (a, b)]
        assert a != b and len(a) == len(b) < 256
        for which in (0, 1):
            one, two = (hashing.spans(hashing.prefix(v, which), np.array([0]), np.array([len(v)]), which) for v in values)
            assert one == two


@pytest.mark.parametrize("which", [0, 1])
def test_words_have_different_hashes(which):
    words = [w.encode() for p in PAIRS for w in p]
    data = np.frombuffer(b" ".join(words), np.uint8)
    h = hashing.word_hashes(data, *hashing.word_bounds(data, np.array([0, len(data)]))[:2], which)
    assert len(set(h.tolist())) == len(words)


def test_short_words_of_one_length_never_agree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        words = np.unique(rng.integers(97, 123, (20_000, n), np.uint8), axis=0)
        lo = np.arange(len(words)) * n
        assert len(np.unique(hashing.word_hashes(words.ravel(), lo, lo + n))) == len(words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_coder(name):
    texts = [w for p in PAIRS for w in p]
    ids, at = WordCoder(public_tokenizers.path(name)).encode(texts)
    library = brute.tokenizer(name)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def rows():
    """Each document is words of a family of its own, but for the pairs."""
    out = []
    for i, (a, b) in enumerate(PAIRS):
        for j, w in enumerate((a, b)):
            out.append((10 * i + j, " ".join(f"{w}" if k % 3 else w + "x" for k in range(24))))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string")


def test_operators(spark, frame):
    want = brute.near_duplicates(rows(), 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, "doc_id", "text", 4, 80).collect()}
    assert got == want
    got = substrings.remove_repeats(frame, "doc_id", "text", 20).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_words)) for r in got) == brute.repeated_words(rows(), 20)
    got = suffixes.remove_strings(frame, "doc_id", "text", 100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in got) == brute.repeated_bytes(rows(), 100)
    name = "byte_bpe_50k.json"
    library = brute.tokenizer(name)
    got = bpe.encode(frame, "doc_id", "text", public_tokenizers.path(name)).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: brute.id_bytes(library.encode(t, add_special_tokens=False).ids) for i, t in rows()}


def test_lines_and_counts():
    text = "\n".join(w for p in PAIRS for w in p)
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(data)])
    lo, hi, first, words = quality._hashed(data, at)
    assert [int(c[0]) for c in quality._counts(data, at, lo, hi, first, words)] == list(brute.quality_counts(text)[1:])
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [w for p in PAIRS for w in p]
    assert token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model")).count(texts).tolist() == [len(x) for x in library.encode(texts)]
    block = phrases.Block("en", [np.frombuffer(" ".join(texts).encode(), np.uint8)])
    assert len(set(block.phrases(1)[1].tolist())) == len({w.translate(brute.LOWER) for t in texts for w in brute.re.findall(r"[^.,;:!?\n\x0b\x0c\r \t]+", t)})
