"""What the operators must return, worked out the plain way, one document after another."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def id_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def near_duplicates(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id); every pair that shares a shingle is compared."""
    sets = {i: shingles(t, k) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated_bytes(docs: list[tuple[int, str | None]], width: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), sorted."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[j : j + width] for _, b in raw for j in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if count[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def repeated_words(docs: list[tuple[int, str | None]], width: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256), sorted; doc_ids are distinct."""
    seen, out = set(), []
    for i, t in sorted(docs):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for j in range(len(words) - width + 1):
            w = tuple(words[j : j + width])
            if w in seen:
                gone[j : j + width] = [True] * width
            seen.add(w)
        out.append((i, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


def without_repeated_words(docs: list[tuple[int, str]], width: int) -> dict[int, str]:
    """Texts with each run of removed words cut from its first word to the next kept one."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        words = list(WORDS.finditer(t))
        gone = [False] * len(words)
        for j in range(len(words) - width + 1):
            w = tuple(m[0] for m in words[j : j + width])
            if w in seen:
                gone[j : j + width] = [True] * width
            seen.add(w)
        ends = [m.start() for m in words[1:]] + [len(t)]
        out[i] = t[: words[0].start()] + "".join(t[m.start() : e] for m, e, g in zip(words, ends, gone, strict=True) if not g) if words else t
    return out


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def crc(ids: list[int]) -> int:
    return zlib.crc32(id_bytes(ids))


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(LOWER), m[2]


def url_rule(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    found = [(len(r), r, v) for r, v in rules for name, _, tail in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + tail)]
    return max(found)[1:] if found else (None, None)
