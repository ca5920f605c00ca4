"""Pre-tokens of byte-level BPE texts in numpy, and a cache of what the tokenizers library makes of each.

A byte-level BPE vocabulary never merges across pre-tokens, so the ids of a text are those of its pre-tokens, in order. Texts are
cut into pre-tokens by array work over character classes; each distinct pre-token is encoded by the library itself, once for as
long as a worker keeps it. Character classes are asked of the library too. Texts that hold a special token's string go to the
library whole.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from assayer.llm.common import Prefixes

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = 0, 1, 2, 3, 255
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe; fixed values of the pattern
KEPT = 1 << 20  # pre-tokens that a worker keeps; beyond that it begins anew


class HashTable:
    """64-bit keys to row numbers in two arrays, looked up and filled by whole arrays."""

    def __init__(self, most: int):
        self.bits = max(10, int(2 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.mask = np.int64((1 << self.bits) - 1)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is new."""
        out = np.full(len(keys), -1, np.int32)
        slot, at = self._slot(keys), np.arange(len(keys))
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """``keys``: distinct and new."""
        slot, at = self._slot(keys), np.arange(len(keys))
        while len(at):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[at[won]]
            self.rows[slot[won]] = rows[at[won]]
            on = np.ones(len(at), bool)
            on[won] = False
            at, slot = at[on], slot[on]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + 1) & self.mask, slot)
        self.size += len(keys)


class PreTokenizer:
    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, points: np.ndarray) -> None:
        """Classes of characters not met before: what joins a letter is a letter, and so on."""
        for point in points.tolist():
            c = chr(point)
            for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(probe + c)) == 1:
                    self.classes[point] = kind
                    break
            else:
                self.classes[point] = BLANK

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where pre-tokens start, and each row's range in them."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.classes[points]
        first = np.zeros(n + 1, bool)  # first character of a text
        first[np.searchsorted(place, offsets)] = True
        run = first[:-1].copy()  # first character of a run of one class
        run[1:] |= kind[1:] != kind[:-1]
        run_at = np.flatnonzero(run)
        run_end = np.append(run_at[1:], n)
        run_kind, text_end = kind[run_at], first[run_end]
        start = run.copy()
        blank = run_kind == BLANK
        inner = blank & ~text_end  # white space with something behind it gives up its last character
        last = run_end[inner] - 1
        start[last] = True
        absorbed = last[points[last] == 32]  # a plain space belongs to what follows
        start[absorbed + 1] = False
        quote = run_at[(run_kind == OTHER) & (run_end - run_at == 1) & (points[run_at] == 39)]
        quote = quote[start[quote] & (quote + 1 < n)]
        quote = quote[~first[quote + 1]]
        for tail in CONTRACTIONS:
            at = quote[quote + len(tail) < n]
            for i, c in enumerate(tail):
                at = at[(points[at + 1 + i] == ord(c)) & ~first[at + 1 + i]] if len(at) else at
            start[at + 1] = False
            after = at + 1 + len(tail)
            after = after[after < n]
            start[after] |= kind[after] == LETTER  # the rest of the word is a pre-token of its own
            quote = np.setdiff1d(quote, at, assume_unique=True)
        at = place[np.flatnonzero(start)]
        return at, np.searchsorted(at, offsets)


def byte_alphabet() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts, by pre-token; one for each worker process and vocabulary file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cutter = PreTokenizer(self.tokenizer)
        self.alphabet = byte_alphabet()
        self.reset()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def reset(self) -> None:
        self.table = HashTable(KEPT + (1 << 19))
        self.bounds = np.zeros(KEPT + (1 << 19) + 1, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def rows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The cache row of each pre-token; new ones are encoded by the library."""
        ends = np.append(starts[1:], len(data))
        keys = Prefixes(data).of(starts, ends) | np.uint64(1)
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            if self.table.size + len(distinct) > len(self.bounds) - 1 or self.table.size > KEPT:
                self.reset()
                if len(distinct) > KEPT:  # one round of very many different pre-tokens
                    self.table, self.bounds = HashTable(2 * len(keys)), np.zeros(2 * len(keys) + 1, np.int64)
                return self.rows(data, starts)
            raw = data.tobytes()
            at = new[first]
            model = self.tokenizer.model
            encoded = [[t.id for t in model.tokenize(raw[s:e].decode("latin-1").translate(self.alphabet))] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            size = self.table.size
            self.bounds[size + 1 : size + 1 + len(encoded)] = self.bounds[size] + np.cumsum([len(x) for x in encoded])
            flat = np.array([i for x in encoded for i in x], np.uint32)
            if self.bounds[size] + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            self.ids[self.bounds[size] : self.bounds[size] + len(flat)] = flat
            self.table.add(distinct, np.arange(size, size + len(distinct), dtype=np.int32))
            found[new] = size + back
        return found

    def special(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows whose texts hold a special token's string."""
        raw, found = data.tobytes(), set()
        for s in self.cutter.specials:
            at, key = raw.find(s.encode()), s.encode()
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(key) <= offsets[row + 1]:
                    found.add(row)
                    at = raw.find(key, int(offsets[row + 1]))
                else:
                    at = raw.find(key, at + 1)
        return sorted(found)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, bounds = self.cutter.cut(data, offsets)
        rows = self.rows(data, starts)
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(self.bounds[rows + 1] - self.bounds[rows], out=total[1:])
        out = np.diff(total[bounds])
        for row in self.special(data, offsets):
            out[row] = len(self.whole(data[offsets[row] : offsets[row + 1]].tobytes()))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, and the n + 1 offsets of the rows in them."""
        starts, bounds = self.cutter.cut(data, offsets)
        rows = self.rows(data, starts)
        low = self.bounds[rows]
        size = self.bounds[rows + 1] - low
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(low - total[:-1], size) + np.arange(total[-1])]
        at = total[bounds]
        if special := self.special(data, offsets):
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for row in special:
                parts[row] = self.whole(data[offsets[row] : offsets[row + 1]].tobytes())
            ids = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at

