"""Fill-in-middle transformation: documents cut in three at unit borders, and put together in another order between sentinels.

A unit is a run of ASCII letters or any other single character. One Aho-Corasick automaton reads each text, of which every
character that is neither in a sentinel nor an ASCII letter counts as the same symbol, and reports sentinels and the places where
the class changes: a letter after one other character after a letter, a letter after a wider gap, and the begin of a wider gap. So
a word costs one event in most texts. Between events the units are arithmetic: a run of letters is one, a gap has as many as
characters. A cut after k units is found by binary search over the runs' ranks, without looking at the text again.

A text's form and cuts depend on the seed, its doc_id and its number of units alone: the hex SHA-256 of `seed:doc_id` gives four
numbers, the first two the cuts (modulo units + 1), the others whether it stays as it is, and the order of its parts.

Defined cases: a null or empty text is plain with 0 units, as is any text with a sentinel in it, whose units are counted all the
same; a null doc_id counts as an empty one; repeated rows each give the same row; bytes that are no UTF-8 become U+FFFD; a very
long text is read in pieces through one automaton state, with 16 bytes for each word and a few copies of the text in one worker;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, text_or_empty

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 documents so many are cut, and of 100 of those so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Symbols that the automaton reads at once.
SCAN_SYMBOLS = 1 << 20
#: Kinds of events, as bits: a run of letters begins, a run has ended one symbol before, a sentinel ends.
BEGIN, END, MARK = 1, 2, 4
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@cache
def _machine(sentinels: tuple[str, ...]) -> tuple[ahocorasick.Automaton, bytes]:
    """The automaton, and the byte table that makes a text's symbols."""
    own = sorted(set("".join(sentinels)))
    if not all(c.isascii() for c in own) or not all(sentinels):
        raise ValueError("sentinels are non-empty ASCII strings")
    if any(x.endswith(y[:k]) for x in sentinels for y in sentinels for k in range(1, len(y) + (x != y))):
        raise ValueError("no sentinel may end as one begins, or outputs could not be taken apart")
    other_letter = next(c for c in string.ascii_letters if c not in own)
    other = next(c for c in ".,;:!?" if c not in own)
    table = bytearray(other.encode() * 256)
    for c in string.ascii_letters:
        table[ord(c)] = ord(other_letter)
    for c in own:
        table[ord(c)] = ord(c)
    symbols = [*own, other_letter, other]
    kinds: dict[str, int] = defaultdict(int)
    for word in map("".join, product(symbols, repeat=3)):
        a, b, c = (x in string.ascii_letters for x in word)
        kinds[word] |= BEGIN * (c and not b) | END * (a and not b)
    for mark in sentinels:
        kinds[mark] |= MARK
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word, kind in kinds.items():
        if kind:
            machine.add_word(word, kind)
    machine.make_automaton()
    return machine, bytes(table)


def _events(symbols: str, machine: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(index of the last symbol, kind) of every match, in order."""
    found, scan = [], None
    for at in range(0, len(symbols), SCAN_SYMBOLS):
        piece = symbols[at : at + SCAN_SYMBOLS]
        if scan is None:
            scan = machine.iter(piece)
        else:
            scan.set(piece)  # goes on in the state and at the index where the last piece ended
        found.append(np.fromiter(chain.from_iterable(scan), np.int64))
    both = np.concatenate(found).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Units:
    """The units of a text: how many there are, how many characters, whether a sentinel occurs, and where the k-th begins."""

    def __init__(self, text: bytes, sentinels: tuple[str, ...] = SENTINELS):
        machine, table = _machine(sentinels)
        edge = table[0:1] * 2  # two characters that are no letters, so that every run begins and ends somewhere
        symbols = (edge + text.translate(table, bytes(range(0x80, 0xC0))) + edge).decode("latin-1")  # one symbol for each character
        index, kind = _events(symbols, machine)
        begins = index[(kind & BEGIN) != 0] - 2
        ends = index[(kind & END) != 0] - 3
        self.characters = len(symbols) - 4
        self.marked = bool((kind & MARK).any())
        self._joined = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - begins - 1)])  # characters beyond the first of the runs so far
        self._ranks = begins - self._joined[:-1]
        self.count = self.characters - int(self._joined[-1])

    def character(self, k: int) -> int:
        """Characters before unit k, all for k = count."""
        return k + int(self._joined[np.searchsorted(self._ranks, k)])


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arranged(doc_id: int | None, text: str, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one document."""
    units = Units(text.encode(), sentinels)
    h1, h2, h3, h4 = _draws(seed, doc_id)
    n = units.count
    if not text or units.marked or h3 % 100 >= CUT_PERCENT:
        return n, "plain", None, None, text
    cuts = [units.character(k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    p, s, m = sentinels
    suffix_first = h4 % 100 < SUFFIX_FIRST_PERCENT
    output = s + suffix + p + prefix + m + middle if suffix_first else p + prefix + s + suffix + m + middle
    return n, "spm" if suffix_first else "psm", cuts[0], cuts[1] - cuts[0], output


def fill_in_middle(documents: DataFrame, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output; one row per document."""

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [field.split(" ")[0] for field in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):  # one text at a time is copied
                rows.append((doc_id.as_py(), *arranged(doc_id.as_py(), text.as_py(), seed, sentinels)))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)
            del batch, rows
            pa.default_memory_pool().release_unused()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(text_or_empty()).alias("text")).mapInArrow(arrange, SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. Each sentinel is in it once, since texts that hold one stay plain."""
    p, s, m = (F.lit(x) for x in sentinels)
    place = lambda mark: F.instr(output, mark)
    between = lambda mark, end: F.substr(output, place(mark) + F.length(mark), end - place(mark) - F.length(mark))
    past = F.char_length(output) + 1
    psm = F.concat(between(p, place(s)), between(m, past), between(s, place(m)))
    spm = F.concat(between(p, place(m)), between(m, past), between(s, place(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
