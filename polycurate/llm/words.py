"""Word and shingle hashes of many texts at once, over their UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_STEP, _BACK = U(0xD1342543DE82EF95), None
#: A random number for each byte, from a fixed seed.
BYTE_KEY = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(_STEP), -1, 1 << 64)
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size, b, U)]), dtype=U) for b in (_STEP, U(inverse))]
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S such that (S[j] - S[i]) * step**-i is a hash of data[i:j]."""
    forward, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_KEY[data] * forward[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, back = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of the first word of each text and after the last). Words: runs without space, tab, \\n, \\v, \\f, \\r."""
    if lower:
        data = lowered(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(1, bool), inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], np.zeros(1, bool)]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles of one text, ascending; of fewer words, the whole sequence is one."""
    size = min(n, len(words))
    if not size:
        return np.zeros(0, U)
    count = len(words) - size + 1
    out = np.full(count, size, U)
    for k in range(size):
        out = mixed(out * U(0x9E3779B97F4A7C15) + words[k : k + count])
    return np.unique(out)
