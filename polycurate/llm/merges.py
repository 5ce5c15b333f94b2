"""Byte-pair merges of many short strings at once: one numpy step joins the best pair of every string that still has one."""

from __future__ import annotations

import json

import numpy as np

NONE = np.int64(1) << 62
#: Longer pieces go to the library.
MOST_BYTES = 48


class Merger:
    """Ids of pre-tokens for a byte-level merge vocabulary, with or without an end-of-word mark."""

    def __init__(self, path: str, alphabet: dict[str, int]):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first, self.last = (np.full(256, -1, np.int64) for _ in range(2))
        for char, byte in alphabet.items():
            self.first[byte], self.last[byte] = vocab.get(char, -1), vocab.get(char + mark, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.asarray([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # open addressing: one pair takes each free slot, the others move on
            free = self.keys[slot] < 0
            taken, which = np.unique(slot[free], return_index=True)
            winner = np.flatnonzero(free)[which]
            self.keys[taken], self.ranks[taken] = keys[left[winner]], left[winner]
            rest = np.ones(len(left), bool)
            rest[winner] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.width + b
        slot = self._slot(keys)
        out, open_ = np.full(len(keys), NONE, np.int64), np.arange(len(keys))
        while len(open_):
            found = self.keys[slot]
            hit = found == keys
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            open_, keys, slot = open_[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another; number of ids of each piece). No piece is empty or longer than MOST_BYTES."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        size = lengths.copy()
        out = np.empty((len(pieces), int(lengths.max(initial=1))), np.int64)
        alive = np.arange(len(pieces))
        rank = np.full(len(symbols), NONE, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self._rank(symbols[at], symbols[at + 1])
        while len(alive):
            n = size[alive]
            starts = np.cumsum(n) - n
            place = np.arange(len(symbols)) - np.repeat(starts, n)
            best = np.minimum.reduceat(np.where(rank < NONE, rank * 64 + place, NONE), starts)  # the lowest rank, the leftmost place
            done = best >= NONE
            if done.any():
                fill = np.repeat(done, n)
                out[np.repeat(alive[done], n[done]), place[fill]] = symbols[fill]
                symbols, rank = symbols[~fill], rank[~fill]
                alive, best, n = alive[~done], best[~done], n[~done]
                starts = np.cumsum(n) - n
                if not len(alive):
                    break
            p = starts + (best & 63)
            symbols[p] = self.made[best >> 6]
            keep = np.ones(len(symbols), bool)
            keep[p + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            size[alive] = n = n - 1
            starts = np.cumsum(n) - n
            p = starts + (best & 63)
            last = p == starts + n - 1
            rank[p[last]] = NONE
            right = p[~last]
            rank[right] = self._rank(symbols[right], symbols[right + 1])
            left = p[p > starts] - 1
            rank[left] = self._rank(symbols[left], symbols[left + 1])
        return out[np.arange(out.shape[1]) < size[:, None]], size
