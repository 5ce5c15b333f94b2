"""Tokenizers as the workers use them: pieces of text are looked up in a bounded table and only unseen ones reach the library.

Both shortcuts rest on one property of the vocabulary files: a pre-token never reaches beyond the piece it is cut from, so the
ids of a text are the ids of its pieces, one after another. Texts for which that is not certain (special strings, control
characters that the libraries and Python class differently, scripts outside the checked ranges) go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from .merges import MOST_BYTES, Merger

#: Entries of a worker's table; it starts afresh when full, so its memory is bounded.
TABLE_ENTRIES = 600_000

#: Separators that Python's str.split knows and the tokenizer's \s does not.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Fixed value: the pre-token pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters outside these ranges may be classed by another Unicode version in the library.
UNCHECKED = regex.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]")


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


def byte_level_text(token: str, byte_of: dict[str, int]) -> str | None:
    """The text that a byte-level vocabulary entry stands for; None where its bytes are not whole UTF-8 characters."""
    try:
        return bytes(byte_of[c] for c in token).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path, byte_alphabet())


#: The word vocabulary's pre-tokens in lower-cased text of the checked ranges, where these are all letters and numbers there are.
LETTERS, NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, for the vocabulary that drops case and white space."""

    def __init__(self, path: str):
        self.library, self.merger = library(path), merger(path)
        self.special, self.pattern = special_strings(path), re.compile(WORD_PATTERN)
        self.table: dict[str, bytes] = {}

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _certain(self, text: str) -> bool:
        if any(s in text for s in self.special) or any(c in text for c in ODD_SPACES):
            return False
        return text.isascii() or UNCHECKED.search(text) is None and "İ" not in text and unicodedata.is_normalized("NFC", text)

    def _learn(self, pre: list[str]) -> None:
        long = [p for p in pre if len(p) > MOST_BYTES // 3]
        self.table.update((p, self._by_library(p)) for p in long)
        short = list(set(pre).difference(long)) if long else pre
        if short:
            ids, sizes = self.merger.encode([p.encode() for p in short])
            ends = np.cumsum(4 * sizes).tolist()
            data = ids.astype("<u4").tobytes()
            self.table.update(zip(short, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        certain = [self._certain(t) for t in texts]
        pre = [self.pattern.findall(t.lower()) if c else [] for t, c in zip(texts, certain, strict=True)]
        missing = set().union(*pre).difference(self.table)
        if len(self.table) + len(missing) > TABLE_ENTRIES:
            self.table.clear()
            missing = set().union(*pre)
        self._learn(list(missing))
        get = self.table.__getitem__
        return [b"".join(map(get, ps)) if c else self._by_library(t) for t, c, ps in zip(texts, certain, pre, strict=True)]


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven, by encoding each alone, to be one pre-token and one token."""
    lib, pattern, alphabet = library(path), regex.compile(BYTE_LEVEL_PATTERN), byte_alphabet()
    special = set(special_strings(path))
    candidates = [(t, i) for v, i in lib.get_vocab().items() if v not in special and (t := byte_level_text(v, alphabet))]
    candidates = [(t, i) for t, i in candidates if pattern.fullmatch(t) and pattern.findall(t) == [t]]
    encoded = lib.encode_batch([t for t, _ in candidates], add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(candidates, encoded, strict=True) if e.ids == [i])


class WholeTokenCounter:
    """Numbers of tokens of whole texts: proven pre-tokens count one each, others are merged by the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.library, self.merger, self.whole = library(path), merger(path), whole
        self.special, self.pattern = special_strings(path), regex.compile(BYTE_LEVEL_PATTERN)
        self.table: dict[str, int] = dict.fromkeys(whole, 1)

    def count(self, texts: list[str]) -> list[int]:
        outside = [any(s in t for s in self.special) or not t.isascii() and UNCHECKED.search(t) is not None for t in texts]
        pre = [[] if o else self.pattern.findall(t) for t, o in zip(texts, outside, strict=True)]
        missing = set().union(*pre).difference(self.table)
        if len(self.table) + len(missing) > TABLE_ENTRIES:
            self.table = dict.fromkeys(self.whole, 1)
            missing = set(chain.from_iterable(pre)).difference(self.table)
        long = [m for m in missing if len(m) > MOST_BYTES // 4]
        short = list(missing.difference(long))
        if short:
            self.table.update(zip(short, self.merger.encode([m.encode() for m in short])[1].tolist(), strict=True))
        self.table.update((m, len(self.library.encode(m, add_special_tokens=False).ids)) for m in long)
        table = self.table
        counts = [sum([table[p] for p in ps]) for ps in pre]
        for i, o in enumerate(outside):
            if o:
                counts[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return counts
