"""BPE by distinct words: texts are cut into words with numpy, and each word that is new goes through the tokenizer once.

The tokenizers library gives the ids of a word; what is worked out here is only where words
begin and end. Two splits are known: byte-level BPE with its own pattern, and a lower-casing split with
word ends. Where a text has characters that are newer than Unicode 3.2 (whose classes differ between
libraries), the library's own split says where its words are. Other tokenizers, texts with an added token's string in them, and such
texts under the lower-casing split go through the library as whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterable

import numpy as np

from millrace.llm.hashing import U, ragged, word_hashes

OTHER, LETTER, NUMBER, BLANK, END, UNSURE = range(6)
#: White space of Unicode 3.2 as patterns with \\s know it.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The pattern of the lower-casing split.
_CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at once; a longer text comes alone.
PIECE = 1 << 19


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point; UNSURE where Unicode 3.2 has none."""
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, UNSURE, np.uint8)
    for cp in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        then, now = old(c), unicodedata.category(c)
        if then != "Cn" and then[0] == now[0]:
            out[cp] = LETTER if now[0] == "L" else NUMBER if now[0] == "N" else OTHER
        elif then != "Cn" and then[0] not in "LN" and now[0] not in "LN":
            out[cp] = OTHER
    out[_BLANKS] = BLANK
    return out


class WordCoder:
    """Encodes texts with the tokenizer in a file; keeps the ids of ``keep_words`` distinct words at most."""

    def __init__(self, path: str, keep_words: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.lower = False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.split = _split_byte_level
        elif [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == _CLIP_PATTERN and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.split, self.lower = _split_lower, True
        else:
            self.split = None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.keep_words = keep_words
        self._clear()

    def _clear(self) -> None:
        size = 1 << max(4, (2 * self.keep_words - 1).bit_length())
        self.keys, self.at = np.zeros(size, U), np.zeros(size, np.int32)
        self.starts, self.lengths, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.pool, self.used = np.zeros(4096, np.int32), 0

    # -- the kept words: an open-addressing table of 64-bit keys
    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not kept."""
        mask = U(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep distinct new words."""
        n, total = len(keys), int(lengths.sum())
        while self.n + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + total] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + n] = lengths
        self._slots(keys, self.n + np.arange(n))
        self.n += n
        self.used += total

    def _slots(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        if self.n + len(keys) > mask:
            raise ValueError("no room for so many words")
        slot, left = (keys & U(mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[left[free]]
            won = self.keys[s] == keys[left]
            self.at[s[won]] = numbers[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after another, and how many each has."""
        ids, owner = [], []
        for lo in range(0, len(words), 4096):
            e = self.tokenizer.encode(words[lo : lo + 4096], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            owner.append(np.array(e.word_ids, np.int64) + lo)
        owners = np.concatenate(owner) if owner else np.empty(0, np.int64)
        return np.concatenate(ids) if ids else np.empty(0, np.int32), np.bincount(owners, minlength=len(words)).astype(np.int32)

    def words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined text; start, end and key of each word; the first word of each text (n + 1); texts for the library."""
        if self.lower:
            texts = [t.lower() for t in texts]
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        kind = _classes()[cp]
        kind[ends] = END
        whole = np.zeros(len(texts), bool)
        if (odd := kind == UNSURE).any():
            whole[np.searchsorted(ends, np.flatnonzero(odd))] = True
        lo, hi = self.split(cp, kind) if self.split else (np.empty(0, np.int64),) * 2
        if whole.any() and self.split and not self.lower:
            first = np.append(0, ends[:-1] + 1)
            cut = [(first[i] + a, first[i] + b) for i in np.flatnonzero(whole) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(texts[i])]
            own = ~whole[np.searchsorted(ends, lo)]
            lo, hi = np.concatenate([np.stack([lo, hi], 1)[own], np.array(cut, np.int64).reshape(-1, 2)]).T
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], hi[order]
            whole[:] = False
        keys = _keys(joined, cp, lo, hi)
        return joined, lo, hi, keys, np.append(0, np.searchsorted(lo, ends)), whole

    def _normal(self, text: str) -> str | None:
        """The text as the split needs it, or None if it must go to the library as a whole."""
        if self.split is None or any(a in text for a in self.added):
            return None
        if self.lower and not text.isascii():
            if "Σ" in text:  # its lower case depends on what stands around it
                return None
            if max(text) >= "̀":
                return unicodedata.normalize("NFC", text) if not any(c >= "\U00010000" for c in text) else None
        return text

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n + 1 offsets; null is empty. Texts are never cut."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        some: list[str | None] = []
        size = 0
        for t in texts:
            t = t or ""
            if some and size + len(t) > PIECE:
                done.append(self._some(some))
                some, size = [], 0
            some.append(t)
            size += len(t)
        if some:
            done.append(self._some(some))
        lengths = np.concatenate([c for _, c in done]) if done else np.empty(0, np.int64)
        return np.concatenate([i for i, _ in done]) if done else np.empty(0, np.int32), np.append(0, np.cumsum(lengths))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ready = [self._normal(t) for t in texts]
        joined, lo, hi, keys, first, whole = self.words([t or "" for t in ready])
        whole |= np.array([t is None for t in ready])
        at = self._find(keys)
        if (new := np.flatnonzero(at < 0)).size:
            _, pick = np.unique(keys[new], return_index=True)
            pick = new[pick]
            if self.n + len(pick) > self.keep_words:
                self._clear()
                _, pick = np.unique(keys, return_index=True)
                if len(pick) > self.keep_words:
                    self.keep_words = len(pick)
                    self._clear()
            ids, lengths = self._library([joined[a:b] for a, b in zip(lo[pick].tolist(), hi[pick].tolist(), strict=True)])
            self._add(keys[pick], ids, lengths)
            at = self._find(keys)
        return self._put(texts, at, first, whole, self.pool, self.starts, self.lengths)

    def grow(self) -> None:
        """Room for twice as many words."""
        old, self.keep_words = self.keys[self.keys != 0], 2 * self.keep_words
        at = self._find(old)
        n, self.n = self.n, 0
        self.keys, self.at = np.zeros(2 * len(self.keys), U), np.zeros(2 * len(self.at), np.int32)
        self._slots(old, at)
        self.n = n

    def put(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Like :meth:`encode`, from kept words alone; a word that is not kept is an error."""
        texts = [t or "" for t in texts]
        ready = [self._normal(t) for t in texts]
        _, _, _, keys, first, whole = self.words([t or "" for t in ready])
        whole |= np.array([t is None for t in ready], bool)
        at = self._find(keys)
        if (at < 0).any():
            raise ValueError("a word has no ids")
        ids, counts = self._put(texts, at, first, whole, self.pool, self.starts, self.lengths)
        return ids, np.append(0, np.cumsum(counts))

    def _put(self, texts, at, first, whole, pool, starts, lengths):
        n = lengths[at].astype(np.int64)
        ids = pool[ragged(starts[at], n)]
        bounds = np.append(0, np.cumsum(n))[first]
        if not whole.any():
            return ids, np.diff(bounds)
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _runs(kind: np.ndarray) -> np.ndarray:
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    return start


def _shorten(cp: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """Words like 's and 'll that begin at an apostrophe, whatever letters follow."""
    i = np.flatnonzero((cp == ord("'")) & start)
    i = i[i + 1 < len(cp)]
    nxt, after = cp[i + 1], cp[np.minimum(i + 2, len(cp) - 1)]
    one = np.isin(nxt, [ord(c) for c in "stmd"])
    two = ((nxt == ord("r")) & (after == ord("e"))) | ((nxt == ord("v")) & (after == ord("e"))) | ((nxt == ord("l")) & (after == ord("l")))
    for hit, length in ((i[one], 2), (i[two], 3)):
        start[hit + 1] = False
        start[np.minimum(hit + length, len(cp) - 1)] = True


def _bounds(kind: np.ndarray, start: np.ndarray, skip: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(start)
    word = ~np.isin(kind[at], skip)
    word[-1] = False  # the last is the end of the last text
    i = np.flatnonzero(word)
    return at[i], at[i + 1]


def _split_byte_level(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, numbers or others, each with one space before it; other white space by itself."""
    start = _runs(kind)
    start[kind == END] = True
    follows = np.flatnonzero(start[1:] & (kind[1:] != END) & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    start[follows - 1] = True
    start[follows[cp[follows - 1] == 0x20]] = False
    _shorten(cp, kind, start)
    return _bounds(kind, start, (END,))


def _split_lower(cp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters or others and single numbers; white space goes."""
    start = _runs(kind)
    start[(kind == END) | (kind == NUMBER)] = True
    _shorten(cp, kind, start)
    return _bounds(kind, start, (END, BLANK))


@functools.cache
def coder(path: str) -> WordCoder:
    """One for each worker process. It stays between tasks, so it holds fewer words than the default; each clearing costs CPU."""
    return WordCoder(path, 1 << 20)


def _keys(joined: str, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes in UTF-8, none of them 0."""
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) > len(cp):
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
        lo, hi = at[lo], at[hi]
    keys = word_hashes(raw, lo, hi)
    keys[keys == 0] = 1
    return keys


def word_key(words: list[str]) -> np.ndarray:
    """Keys of whole words, as :meth:`WordCoder.words` gives them."""
    joined = "".join(words)
    hi = np.cumsum(np.array([len(w) for w in words], np.int64)) if words else np.empty(0, np.int64)
    return _keys(joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, hi[:-1])[: len(hi)], hi)
