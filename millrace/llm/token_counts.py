"""Token counts by rank-synchronous merging of BPE pieces (sentencepiece models).

1. A text is cut where no piece of the vocabulary can lie: between two characters that stand side by side in no
   piece, so no merge ever crosses a cut. What is between two cuts is a pre-token; with spaces as word starts these are about words.
2. Each task counts a distinct pre-token once. New ones are held together as ragged arrays: the symbols of all, one after another.
3. In a round every pre-token applies its own pair of the lowest rank, all pre-tokens at once. All places of that pair go
   together if no merge of it can make a pair of the same or a lower rank; else the leftmost goes alone, as the library does it.
4. Where no pair is left, the surviving symbols are counted; a character without a piece counts as its bytes.

Pre-tokens of more than :data:`LONG` characters would need very many rounds over the whole of them; their pairs wait in a heap by
rank and place instead, which is the same order.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import ragged, word_hashes
from millrace.llm.tables import pieces

#: Characters of a pre-token that is merged together with others.
LONG = 256
#: Distinct pre-tokens that a task remembers.
REMEMBERED = 1 << 20
#: Bytes of text looked at together; a longer text comes alone.
PIECE = 1 << 20
#: The character that stands for a space, and the kinds of piece in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int32).max


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Merger:
    """The vocabulary of a model as arrays: characters, pairs of pieces and their ranks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models with byte fallback, a word start before each text and no normalisation are known")
        named = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        scores = {s: r for r, s in enumerate(sorted(set(named.values()), reverse=True))}
        names = list(named)
        number = {p: i for i, p in enumerate(names)}
        self.rank = np.array([scores[named[p]] for p in names], np.int32)
        letters = sorted({c for p in names for c in p} | {SPACE})
        # Characters get numbers from 1 (0: in no piece); symbols are pieces, and characters that are in pieces but are none.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        loose = {c: len(names) + i for i, c in enumerate(c for c in letters if c not in number)}
        self.symbol = np.array([-1] + [number.get(c, loose.get(c)) for c in letters], np.int32)
        self.n_pieces = len(names)
        side = {(a, b) for p in names for a, b in zip(p, p[1:], strict=False)}
        n = len(letters) + 1
        self.n_letters = n
        self.joined = np.sort(np.array([int(self.letter[ord(a)]) * n + int(self.letter[ord(b)]) for a, b in side], np.int64))
        symbols = number | loose
        pairs = sorted((symbols[p[:i]] << 32 | symbols[p[i:]], number[p]) for p in names for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols)
        self.pairs, self.made = np.array([k for k, _ in pairs], np.int64), np.array([m for _, m in pairs], np.int32)
        # A piece is quick if every pair it is in is of a higher rank than itself.
        self.quick = np.ones(len(names) + len(loose), bool)
        for part in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            known = part < len(names)
            part, whole = part[known], self.made[known]
            self.quick[part[self.rank[whole] <= self.rank[part]]] = False

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of a text that has its word starts, and where pre-tokens begin."""
        cp = _code_points(text)
        letter = self.letter[cp].astype(np.int64)
        side = letter[:-1] * self.n_letters + letter[1:]
        at = np.minimum(np.searchsorted(self.joined, side), len(self.joined) - 1)
        together = (self.joined[at] == side) & (letter[:-1] > 0) & (letter[1:] > 0)
        return cp, np.flatnonzero(np.append(True, ~together)) if len(cp) else np.empty(0, np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, -1 if none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def survivors(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``cp[first[i] : first[i + 1]]``; ``first`` has n + 1 offsets."""
        n = np.diff(first)
        out = np.zeros(len(n), np.int64)
        symbol = self.symbol[self.letter[cp]]
        # A character in no piece at all stands alone and is written as its bytes.
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        alone = np.flatnonzero((n == 1) & (symbol[np.minimum(first[:-1], len(cp) - 1)] < 0)) if len(cp) else np.empty(0, np.int64)
        out[alone] = width[first[alone]]
        for i in np.flatnonzero(n > LONG).tolist():
            out[i] = self._one(symbol[first[i] : first[i + 1]], width[first[i] : first[i + 1]])
        rest = (n > 0) & (n <= LONG)
        rest[alone] = False
        rest = np.flatnonzero(rest)
        owner = np.repeat(rest, n[rest])
        at = ragged(first[rest], n[rest])
        symbol, width = symbol[at], width[at]
        while len(owner):
            same = owner[1:] == owner[:-1]
            piece = np.full(len(owner), -1, np.int32)
            piece[:-1][same] = self._pair(symbol[:-1][same], symbol[1:][same])
            rank = np.where(piece >= 0, self.rank[piece], _NONE)
            begin = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, begin)
            over = least == _NONE
            size = np.diff(np.append(begin, len(owner)))
            if over.any():
                # Done: these symbols survive.
                done = np.repeat(over, size)
                out += np.bincount(owner[done], np.where(symbol[done] < self.n_pieces, 1, width[done]), len(n)).astype(np.int64)
                owner, symbol, width, rank, piece = (x[~done] for x in (owner, symbol, width, rank, piece))
                least, size = least[~over], size[~over]
                if not len(owner):
                    break
                begin = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            lead = np.append(True, owner[hit][1:] != owner[hit][:-1])
            # Only the leftmost of a pre-token if one of its pieces could make an earlier pair.
            slow = np.zeros(len(n), bool)
            slow[owner[hit[~self.quick[piece[hit]]]]] = True
            hit = hit[lead | ~slow[owner[hit]]]
            # Of places that overlap, every other one.
            run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbol[hit] = piece[hit]
            stay = np.ones(len(owner), bool)
            stay[hit + 1] = False
            owner, symbol, width = owner[stay], symbol[stay], width[stay]
        return out

    def _one(self, symbol: np.ndarray, width: np.ndarray) -> int:
        """Tokens of one long pre-token: the pair of the lowest rank, leftmost first, from a heap of all pairs with links to the neighbours."""
        s, n = symbol.tolist(), len(symbol)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        made = dict(zip(self.pairs.tolist(), self.made.tolist(), strict=True)) if not hasattr(self, "_made") else self._made
        self._made = made
        rank = self.rank.tolist()
        first = self._pair(symbol[:-1], symbol[1:])
        where = np.flatnonzero(first >= 0)
        heap = list(zip(self.rank[first[where]].tolist(), where.tolist(), first[where].tolist(), (where + 1).tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            _, i, piece, j = heapq.heappop(heap)
            if s[i] < 0 or after[i] != j or made.get(s[i] << 32 | s[j]) != piece:
                continue
            s[i], s[j] = piece, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (m := made.get(s[a] << 32 | s[b])) is not None:
                    heapq.heappush(heap, (rank[m], a, m, b))
        return sum(1 if x < self.n_pieces else w for x, w in zip(s, width.tolist(), strict=True) if x >= 0)


class Counter:
    """Counts tokens of texts; remembers the counts of REMEMBERED pre-tokens at most."""

    def __init__(self, path: str):
        self.merger, self.known = Merger(path), {}

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; empty ones have none."""
        marked = ["" if t == "" else SPACE + t.replace(" ", SPACE) for t in texts]
        if max(map(len, marked), default=0) <= 2 * PIECE:
            return self._count(marked)
        return np.array([sum(int(self._count([part])[0]) for part in self._parts(t)) for t in marked], np.int64)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that end where pre-tokens do."""
        size = PIECE
        while len(text) > size:
            _, begin = self.merger.cut(text[:size])
            if begin[-1] > 0:
                yield text[: begin[-1]]
                text, size = text[begin[-1] :], PIECE
            else:
                size *= 2
        yield text

    def _count(self, marked: list[str]) -> np.ndarray:
        joined = "".join(marked)
        if not joined:
            return np.zeros(len(marked), np.int64)
        cp, begin = self.merger.cut(joined)
        ends = np.cumsum([len(t) for t in marked])
        begin = np.union1d(begin, np.append(0, ends[:-1])[np.array([len(t) for t in marked]) > 0])
        end = np.append(begin[1:], len(cp))
        raw = np.frombuffer(joined.encode(), np.uint8)
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
        lo, hi = at[begin], at[end]
        # Pre-tokens are put together by one hash; a second one must agree, and their own bytes name them from there on.
        one, two = word_hashes(raw, lo, hi), word_hashes(raw, lo, hi, 1)
        _, head, back = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[head][back]).any():
            _, head, back = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
        data = raw.tobytes()
        names = [data[a:b] for a, b in zip(lo[head].tolist(), hi[head].tolist(), strict=True)]
        if len(self.known) + len(names) > REMEMBERED:
            self.known = {}
        counts = np.array([self.known.get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            n = (end - begin)[head[new]]
            counts[new] = self.merger.survivors(cp[ragged(begin[head[new]], n)], np.append(0, np.cumsum(n)))
            self.known.update((names[i], c) for i, c in zip(new.tolist(), counts[new].tolist(), strict=True) if len(names[i]) <= 4 * LONG)
        total = np.append(0, np.cumsum(counts[back]))
        return np.diff(total[np.searchsorted(begin, np.append(0, ends))])


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(path)


def count_tokens(df: DataFrame, key: str, text: str, model: str, limit: int) -> DataFrame:
    """The key, ``n_bytes`` (of the text in UTF-8), ``n_tokens`` as the library gives them without begin and end, and ``over_limit``: more tokens than ``limit``.

    Whole texts; null and empty ones have no bytes and no tokens. Names of special tokens in a text are plain text. Every row is
    counted for itself, whatever its key; an empty table gives an empty table. Other columns are dropped, so none can clash. There is
    no shuffle. ``model`` is a path that workers can open.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            for part, data, at in pieces(batch, "text", PIECE):
                raw = data.tobytes()
                n = own.count([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
