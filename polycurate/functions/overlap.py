"""Overlaps of texts. Arrow batches are counted as a whole with numpy; the scores themselves are expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens of ROUGE.
WORDS, ASCII_WORDS = re.compile(r"\w+"), re.compile("[a-z0-9]+")
ORDERS = 6
BETA_SQUARED = 4.0
#: Code points whose n-grams are counted together.
CHUNK = 1 << 19
#: Tokens that are compared together.
TOKENS = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_items(row_a: np.ndarray, key_a: np.ndarray, row_b: np.ndarray, key_b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, how many items (numbers) its two multisets share. Both sides are sorted together; equal items form runs."""
    row, key = np.concatenate([row_a, row_b]), np.concatenate([key_a, key_b])
    if not len(row):
        return np.zeros(n, np.int64)
    right = np.repeat([0, 1], [len(row_a), len(row_b)])
    order = np.lexsort((key, row))
    row, key, right = row[order], key[order], right[order]
    runs = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
    of_right, of_both = np.add.reduceat(right, runs), np.diff(np.append(runs, len(row)))
    return np.bincount(row[runs], np.minimum(of_right, of_both - of_right), minlength=n).astype(np.int64)


def _coded(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each token of all rows of a, then of b; lengths of a's lists; of b's). Equal tokens have equal codes."""
    lengths = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in (a, b)]
    return np.asarray(pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices), *lengths


def _by_parts(count, a: pa.Array, b: pa.Array) -> pa.Array:
    """count(a, b) of rows with about TOKENS tokens at a time."""
    sizes = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (a, b)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *[count(a[at:to], b[at:to]) for at, to in chunks(sizes[0] + sizes[1], TOKENS)]]))


def _common_tokens(a: pa.Array, b: pa.Array) -> pa.Array:
    def count(a: pa.Array, b: pa.Array) -> np.ndarray:
        code, n_a, n_b = _coded(a, b)
        rows, cut = np.arange(len(a)), int(n_a.sum())
        return shared_items(np.repeat(rows, n_a), code[:cut], np.repeat(rows, n_b), code[cut:], len(a))

    return _by_parts(count, a, b)


def subsequence_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit of a whole number for each item of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _common_subsequences(a: pa.Array, b: pa.Array) -> pa.Array:
    def count(a: pa.Array, b: pa.Array) -> np.ndarray:
        code, n_a, n_b = _coded(a, b)
        ends_a, ends_b = np.cumsum(n_a), int(n_a.sum()) + np.cumsum(n_b)
        pairs = zip(ends_a - n_a, ends_a, ends_b - n_b, ends_b, strict=True)
        return np.array([subsequence_length(code[i:j].tolist(), code[k:m].tolist()) for i, j, k, m in pairs], np.int64)

    return _by_parts(count, a, b)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts end to end, length of each)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.asarray([len(t) for t in texts], np.int64)


def gram_matches(a: list[str], b: list[str], orders: int = ORDERS) -> np.ndarray:
    """(rows, orders): how many character n-grams, of n from 1 on, the texts of each row share."""
    sides, out = [], np.zeros((len(a), orders), np.int64)
    for texts in (a, b):
        points, length = code_points(texts)
        row = np.repeat(np.arange(len(texts)), length)
        sides.append([points + np.uint64(1), row, np.cumsum(length)[row] - np.arange(len(points)), points + np.uint64(1)])
    for n in range(1, orders + 1):
        whole = []
        for points, row, left, grams in sides:  # left: code points from here to the end of the row
            inside = left[: len(grams)] >= n
            whole += [row[: len(grams)][inside], grams[inside]]
        out[:, n - 1] = shared_items(*whole, len(a))
        for side in sides:
            side[3] = side[3][:-1] * _STEP + side[0][n:]
    return out


def _matches(a: pa.Array, b: pa.Array) -> pa.Array:
    texts = [pc.fill_null(x, "") for x in (a, b)]
    sizes = np.asarray(pc.add(*[pc.utf8_length(x) for x in texts])).astype(np.int64)
    parts = [np.zeros((0, ORDERS), np.int64), *[gram_matches(*[x[at:to].to_pylist() for x in texts]) for at, to in chunks(sizes)]]
    found = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * ORDERS, pa.int32()), pa.array(found.ravel()))


def shingle_hashes(texts: list[str], k: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's runs of k characters; of a shorter text the hash of the whole, none of an empty one."""
    points, length = code_points(texts)
    points, row = points + np.uint64(1), np.repeat(np.arange(len(texts)), length)
    left, grams, rows, keys = np.cumsum(length)[row] - np.arange(len(points)), points, [], []
    for n in range(1, k + 1):
        used = left[: len(grams)] >= n if n == k else (length[row[: len(grams)]] == n) & (left[: len(grams)] == n)
        rows.append(row[: len(grams)][used])
        keys.append((grams[used] ^ (grams[used] >> np.uint64(29))) * _STEP + np.uint64(n))
        grams = grams[:-1] * _STEP + points[n:]
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
    return np.split(key[first], np.cumsum(np.bincount(row[first], minlength=len(texts)))[:-1]) if len(texts) else []


def chunks(sizes: np.ndarray, most: int = CHUNK):
    """(from, to) of rows that have about `most` code points, or whatever sizes are, together."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def shingle_lists(texts: pa.Array, k: int) -> pa.ListArray:
    """Hashes of each text's distinct runs of k characters, in order; for null none."""
    texts, found = pc.fill_null(texts, ""), []
    for at, to in chunks(np.asarray(pc.utf8_length(texts)).astype(np.int64)):
        found += shingle_hashes(texts[at:to].to_pylist(), k)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)))


def shingles(text: Column, k: int) -> Column:
    """`shingle_lists` as a column."""

    def hashed(a: pa.Array) -> pa.Array:
        return shingle_lists(a, k)

    return F.arrow_udf(hashed, "array<long>")(text)


def _arrow(function, kind: str):
    def wrapped(a: pa.Array, b: pa.Array) -> pa.Array:
        return function(a, b)

    return F.arrow_udf(wrapped, kind)


def _f1(common: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * common, F.size(a) + F.size(b)), F.lit(0.0))


def rouge1(prediction: Column, reference: Column) -> Column:
    """F1 of the tokens that two arrays share, each as often as both have it."""
    return _f1(_arrow(_common_tokens, "long")(prediction, reference), prediction, reference)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays."""
    return _f1(_arrow(_common_subsequences, "long")(prediction, reference), prediction, reference)


def rouge_words(text: str, kind: str = "unicode") -> list[str]:
    """The tokens of a text: runs of letters, digits and _ of its lower-cased NFKC form, or of ASCII letters and digits."""
    low = text.lower()
    if kind == "ascii":
        return ASCII_WORDS.findall(low)
    return WORDS.findall(low if low.isascii() else unicodedata.normalize("NFKC", low))


def rouge(prediction: Column, reference: Column, kind: str = "unicode", subsequences: bool = True) -> Column:
    """struct(rouge1, rougeL) of two texts, rougeL only with `subsequences`. Texts are cut into tokens one pair at a time, so a batch holds no more than its texts."""

    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        one, long = np.zeros(len(a)), np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            p, r = (rouge_words(t.as_py() or "", kind) for t in (x, y))
            if p and r:
                one[i] = 2.0 * (Counter(p) & Counter(r)).total() / (len(p) + len(r))
                long[i] = 2.0 * subsequence_length(p, r) / (len(p) + len(r)) if subsequences else np.nan
        return pa.StructArray.from_arrays([pa.array(one), pa.array(long)], names=["rouge1", "rougeL"])

    return _arrow(scored, "struct<rouge1: double, rougeL: double>")(prediction, reference)


def _scored(reference: Column, prediction: Column, score) -> Column:
    """score(matches by order, length of the reference, of the prediction), each computed once."""
    both = F.struct(_arrow(_matches, "array<long>")(reference, prediction).alias("m"), F.coalesce(F.length(reference), F.lit(0)).alias("r"), F.coalesce(F.length(prediction), F.lit(0)).alias("p"))
    return F.get(F.transform(F.array(both), lambda x: score(x["m"], x["r"], x["p"])), F.lit(0))


def _mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0))


def chrf(reference: Column, prediction: Column) -> Column:
    """Blanks removed; F2 of the character n-grams of each order, averaged over the orders that have a match; 0 without any."""
    bare = [F.regexp_replace(c, " ", "") for c in (reference, prediction)]

    def score(matches: Column, r: Column, p: Column) -> Column:
        # with m matches among R and P n-grams, precision m / P and recall m / R give F = (1 + b) m / (b R + P)
        each = F.transform(matches, lambda m, i: (1 + BETA_SQUARED) * m / (BETA_SQUARED * F.greatest(r - i, F.lit(1)) + F.greatest(p - i, F.lit(1))))
        return _mean(F.filter(each, lambda f: f > 0))

    return _scored(*bare, score)


def sentence_chrf(reference: Column, prediction: Column) -> Column:
    """White space removed; precision and recall averaged over the orders that both texts have, then one F2 of the averages; 0 where a text is blank."""
    from .text import SPACE

    bare = [F.regexp_replace(c, SPACE, "") for c in (reference, prediction)]

    def score(matches: Column, r: Column, p: Column) -> Column:
        used = F.slice(matches, F.lit(1), F.least(r, p, F.lit(ORDERS)))
        share = lambda of: _mean(F.transform(used, lambda m, i: m / (of - i)))
        precision, recall = share(p), share(r)
        return F.coalesce(F.try_divide((1 + BETA_SQUARED) * precision * recall, BETA_SQUARED * precision + recall), F.lit(0.0))

    return _scored(*bare, score)
