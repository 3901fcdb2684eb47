"""Words and hashes of them, for a whole run of texts at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U = np.uint64
#: Odd multipliers; an odd number has an inverse modulo 2**64. 
_BASES, _GOLD = (U(0x9E3779B97F4A7C55), U(0xD1342543DE82EF95)), U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: The white space of words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Masks of the first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Longer words are hashed one by one.
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept for the next call unless very long."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
            p = np.ones(size, U)
            p[1:] = U(base)
            out.append(np.cumprod(p))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of values[j] * base**j for j < i, for each i from 0 to n.

    Such sums modulo 2**64 are linear, and some strings of a hundred symbols agree in every odd base. So they only choose
    places (grams) and never say that two strings are equal; :func:`word_hashes` and :func:`digests` do.
    """
    up, _ = powers(max(1, len(values)), which)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[lo:hi] out of :func:`prefix`, with the lengths."""
    _, down = powers(len(pre), which)
    return mix((pre[hi] - pre[lo]) * down[lo] + (hi - lo).astype(U) * _GOLD)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of its first word (n + 1 of them).

    A word never runs from one text into the next.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[data], out=inside[1 : n + 1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(lo, at)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[lo:hi], eight bytes a round, mixed with what was there, so no sum of symbols cancels out; those of eight bytes or less and one length never agree."""
    n = (hi - lo).astype(np.int64)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(n.astype(U) * _GOLD + _BASES[which])
    rows = np.flatnonzero((n > 0) & (n <= _LONG_WORD))
    done = 0
    while len(rows):
        here = n[rows] - done
        have = eight[lo[rows] + done] & _BYTES[np.minimum(here, 8)]
        out[rows] = mix((out[rows] ^ have) * _BASES[which]) + (have * _M1 if done else U(0))
        rows, done = rows[here > 8], done + 8
    for i in np.flatnonzero(n > _LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[lo[i] : hi[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def digests(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2 of 128 bits of the rows values[lo:hi], as two columns."""
    raw, step = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize * int(np.prod(values.shape[1:]))
    make = functools.partial(hashlib.blake2b, digest_size=16)
    out = np.frombuffer(b"".join([make(raw[a:b]).digest() for a, b in zip((lo * step).tolist(), (hi * step).tolist(), strict=True)]), U).reshape(-1, 2)
    return out[:, 0].copy(), out[:, 1].copy()


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (n - k + 1 of them, over text bounds too)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _BASES[0]
        out += words[j : j + n]
    return mix(out + U(k * int(_GOLD) & (1 << 64) - 1))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] of them, for all i in turn."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class KeySet:
    """64-bit keys seen so far, with a flag each; an open-addressing table that starts anew when ``most`` are in it."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.keys, self.flags, self.n = np.zeros(4 * most, U), np.zeros(4 * most, bool), 0

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key (distinct ones), put in if new; and whether it was there."""
        if self.n + len(keys) > 2 * self.most:
            raise ValueError("too many keys at once")
        if self.n + len(keys) > self.most and self.n:
            self.keys[:], self.flags[:], self.n = 0, False, 0
        keys = np.where(keys == 0, U(1), keys)
        mask = len(self.keys) - 1
        slot, left, old = (keys & U(mask)).astype(np.int64), np.arange(len(keys)), np.zeros(len(keys), bool)
        while len(left):
            s = slot[left]
            hit = self.keys[s] == keys[left]
            old[left[hit]] = True
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[left[free]]
            won = hit | (free & (self.keys[s] == keys[left]))
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
        self.n += int((~old).sum())
        return slot, old
