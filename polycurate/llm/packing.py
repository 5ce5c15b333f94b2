"""Packing of documents into fixed windows by best-fit decreasing.

Every document is cut into full windows and one remainder. A segment tree over the remaining capacities finds the tightest open
window for each remainder, longest first. Remainders are dealt into groups of bounded size by a hash of their row, so any number
of tasks pack at once, however often a row repeats; only numbers move between tasks, never texts or ids.

Defined cases: a null or empty text is the end token alone; a null doc_id stays null; repeated rows are packed once each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .token_counts import text_slices
from .tokens import WordEncoder

#: Pieces that one task packs; the waste is at most a few open windows of each group.
GROUP_PIECES = 50_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Segment tree over remaining capacities 0..window: which have an open window, and the least that holds a given length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, window_id: int) -> None:
        self.stacks[capacity].append(window_id)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """(window id, its capacity) of the open window with the least capacity of at least `length`."""
        node = length + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # climb to the nearest filled subtree on the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.stacks[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; `lengths` are in descending order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    for i, length in enumerate(lengths.tolist()):
        found = tree.pop_tightest(length)
        if found is None:
            found, used = (used, window), used + 1
        bins[i], offsets[i] = found[0], window - found[1]
        if found[1] > length:
            tree.push(found[1] - length, found[0])
    return bins, offsets


def cut_pieces(documents: DataFrame, tokenizer_path: str, window: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: full windows, then the remainder; with `keep_ids`, their ids as an array."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = WordEncoder(tokenizer_path)
        for batch in text_slices(batches):
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=False):
                        column.append(value)
                    if keep_ids:
                        rows[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in rows[:5]]
            if keep_ids:
                arrays.append(pa.array(rows[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(cut, PIECE + ", ids array<int>" * keep_ids)


def pack(documents: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset there; `sequence_texts` turns them into padded sequences."""
    pieces = written(cut_pieces(documents, tokenizer_path, window, end_id, keep_ids), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    extra = ["ids"] * keep_ids

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        group = table.column("pack_group")[0].as_py()
        placed = table.drop_columns(["pack_group"])
        placed = placed.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return placed.select([*PACKED.replace(" long", "").split(", "), *extra])

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(place, PACKED + ", ids array<int>" * keep_ids)


def sequence_texts(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Padded id sequences from `pack(..., keep_ids=True)`: (sequence_id, ids, n_used)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("used"))
    padded = F.concat("used", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("used")))
    return joined.select("sequence_id", padded.alias("ids"), F.size("used").alias("n_used"))
