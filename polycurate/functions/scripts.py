"""The dominant script of texts: letters looked up in sorted ranges of code points, by whole Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .overlap import chunks, code_points

#: The share of the letters that a script needs, and what a text without letters or without such a script is.
SCRIPT_SHARE, NO_LETTERS, NO_SCRIPT = 0.6, "EMPTY", "MIXED"


@cache
def letter_ranges() -> list[tuple[int, int, str]]:
    """(first, last, script) of all neighbouring letters of one script, ascending. A letter's script is the first word of its Unicode name."""
    ranges: list[tuple[int, int, str]] = []
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            script = unicodedata.name(letter, "UNKNOWN").split(" ")[0]
            if ranges and ranges[-1][1] == point - 1 and ranges[-1][2] == script:
                ranges[-1] = (ranges[-1][0], point, script)
            else:
                ranges.append((point, point, script))
    return ranges


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Firsts and lasts of the ranges, the number of each range's script, the scripts' names."""
    first, last, script = zip(*letter_ranges(), strict=True)
    names, number = np.unique(script, return_inverse=True)
    return np.array(first), np.array(last), number, names


def scripts_of(texts: list[str]) -> list[str]:
    """The script of at least SCRIPT_SHARE of each text's letters; of scripts with equal shares the one that is seen first."""
    first, last, number, names = _tables()
    points, length = code_points(texts)
    place = np.searchsorted(first, points.astype(np.int64), "right") - 1
    letter = (place >= 0) & (points.astype(np.int64) <= last[place])
    row = np.repeat(np.arange(len(texts)), length)[letter]
    letters = np.bincount(row, minlength=len(texts))
    pair, seen, n = np.unique(row * len(names) + number[place[letter]], return_index=True, return_counts=True)
    row, script = pair // len(names), pair % len(names)
    order = np.lexsort((seen, -n, row))
    best = order[np.append(True, row[order][1:] != row[order][:-1])[: len(order)]]
    out = np.where(letters > 0, NO_SCRIPT, NO_LETTERS).astype(object)
    enough = best[n[best] >= SCRIPT_SHARE * letters[row[best]]]
    out[row[enough]] = names[script[enough]]
    return out.tolist()


def dominant_script(c: Column) -> Column:
    """The name of the script of most letters, MIXED where none has enough of them, EMPTY without letters and for null."""

    def run(a: pa.Array) -> pa.Array:
        a, found = pc.fill_null(a, ""), []
        for at, to in chunks(np.asarray(pc.utf8_length(a)).astype(np.int64)):
            found += scripts_of(a[at:to].to_pylist())
        return pa.array(found, pa.string())

    return F.arrow_udf(run, "string")(c)
