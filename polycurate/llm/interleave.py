"""Merging of shards' Burrows-Wheeler transforms by interleave refinement, over windows of one fixed length.

A shard is a block of byte windows. Its transform is kept by depth: column t lists, in the order of the windows' last t bytes,
the byte before each of these suffixes. Merging never sorts suffixes again. It refines an interleave: which shard each place of
the merged order comes from. Reading the shards' columns through the interleave and dealing the places stably by the byte read
gives the interleave one byte deeper. Beside it runs a block number for each place: neighbours stay in one block as long as the
bytes read agree, so after `length` steps the blocks are the intervals of windows whose common prefix is the whole window.
"""

from __future__ import annotations

import numpy as np

#: Windows of one transform: its columns stay in the processor's cache. Shards with fewer share a transform.
SHARD = 16_384


def transform(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns by depth, order) of one shard: windows is (n, length) of bytes; order sorts them."""
    n, length = windows.shape
    across = np.ascontiguousarray(windows.T)
    order = np.arange(n)
    columns = np.empty((length, n), np.uint8)
    for depth in range(length):
        before = across[length - 1 - depth][order]
        columns[depth] = before
        order = order[np.argsort(before, kind="stable")]
    return columns, order


def merge(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each merged window in the shards' orders laid end to end, block of each) from the shards' columns."""
    sizes = [c.shape[1] for c in shards]
    n, length = sum(sizes), shards[0].shape[0]
    columns = np.concatenate(shards, axis=1) if len(shards) > 1 else shards[0]
    source = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16 if len(shards) > 255 else np.uint8)
    place, block = np.arange(n), np.zeros(n, np.int32)
    within = np.arange(n)
    for depth in range(length):
        read = columns[depth][place]
        turn = np.argsort(read, kind="stable")
        read, block, source = read[turn], block[turn], source[turn]
        new = np.empty(n, bool)
        new[:1] = False
        np.not_equal(read[1:], read[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32)
        if len(shards) > 1:  # a shard's windows keep their own order
            place = np.empty(n, np.int64)
            place[np.argsort(source, kind="stable")] = within
    return place, block


def equal_windows(windows: np.ndarray, shard: int = SHARD, sources: np.ndarray | None = None) -> np.ndarray:
    """Number of the group of equal windows that each window belongs to; windows is (n, length) of bytes.

    sources, ascending, tells which shard each window comes from: a transform is of whole shards, of as many as make `shard` windows.
    """
    n = len(windows)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.arange(1, n + 1) if sources is None else np.append(np.flatnonzero(np.diff(sources)) + 1, n)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(int(ends[min(np.searchsorted(ends, cuts[-1] + shard), len(ends) - 1)]))
    parts = [transform(windows[at:to]) for at, to in zip(cuts, cuts[1:], strict=False)]
    place, block = merge([columns for columns, _ in parts])
    order = np.concatenate([order + at for (_, order), at in zip(parts, cuts, strict=False)])
    group = np.empty(n, np.int64)
    group[order[place]] = block
    return group
