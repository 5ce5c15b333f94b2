"""Removal of passages that start in an earlier document, by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

1. Documents are laid into shards of bounded size: a bucketed table, so later joins by shard move only what is joined to it.
   Shard numbers are chosen so that a task's shards fall into few buckets, hence into few files.
2. Each window of `length` bytes has an anchor: the least-hashed run of ANCHOR bytes in it. Equal windows have equal anchors at
   equal places, so a window can only repeat where its anchor does. Shards send their distinct anchor hashes to hash ranges and
   learn which of them repeat. Nothing is lost here: this only spares the transforms the text that repeats nowhere.
3. For each repeating anchor a shard sends the bytes around it that its windows cover, once for each distinct context, to the
   range of the anchor. There each shard's windows of the range get a transform (small shards share one with their neighbours),
   and the transforms are merged by interleave refinement; intervals of windows with a common prefix of `length` bytes give the
   least doc_id at which each window starts. Contexts that agree byte for byte are one from the start. The windows of anchors
   with very many contexts travel alone, dealt by their content.
4. Shards learn for which runs of windows a smaller doc_id exists elsewhere, and mark the bytes.

Defined cases: null, empty and short texts keep all their bytes; a null doc_id counts as the smallest; repeated rows of one
doc_id are one document and remove nothing from each other; a text longer than a shard is a shard of its own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.scratch import scratch_folder
from .common import slices, task_number, text_or_empty, written
from .interleave import equal_windows
from .words import BYTE_KEY, U, mixed

ANCHOR = 16
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Bytes of input that one hash range answers for.
RANGE_BYTES = 16 << 20
#: Buckets, and so files, that the shards of one task are dealt to.
SPREAD = 4
#: An anchor with more contexts than this sends single windows, dealt by content; the contexts of others meet in one task.
HOT_CONTEXTS = 1 << 16
#: Windows whose transforms are merged at once, and contexts that are looked at together.
MERGE_WINDOWS, CONTEXTS = 1 << 16, 1 << 13
#: Anchor hashes travel as their upper 48 bits and, when shards report them, two bytes: how many contexts they have in the shard, at
#: most MOST_COUNTED (a shard of SHARD_BYTES has fewer), and whether in several documents. A clash of hashes only sends text that
#: repeats nowhere.
KEY, MOST_COUNTED = U(((1 << 64) - 1) ^ ((1 << 16) - 1)), (1 << 15) - 1

NO_ID = -(1 << 63)
SHARDS = "shard long, n_bytes long, ids binary, sizes binary, text binary, gaps binary, rest binary"


def run_hashes(data: np.ndarray, n: int = ANCHOR) -> np.ndarray:
    """Hashes of all runs of n bytes; n is a power of two."""
    h, step = BYTE_KEY[data], 1
    while step < n:
        h = mixed_step(h[:-step], step) + h[step:] if len(h) > step else h[:0]
        step *= 2
    return mixed(h)


def mixed_step(h: np.ndarray, step: int) -> np.ndarray:
    return (h ^ (h >> U(31))) * U((0x9E3779B97F4A7C15 + 2 * step * 0x632BE59BD9B4E019) & (2**64 - 1) | 1)


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Ascending places of the anchors of all windows of `length` bytes in one document; empty if it is shorter."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    h = run_hashes(data)
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)  # the leftmost of equal ones
    width, step = length - ANCHOR + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def spark_hashes(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of each long (Murmur3, 32 bits), by which tables are bucketed."""
    u = np.uint32
    turned = lambda v, r: (v << u(r)) | (v >> u(32 - r))
    h, x = np.full(len(x), seed, u), x.astype(U)
    for half in (x & U(0xFFFFFFFF), x >> U(32)):
        h = turned(h ^ turned(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h = (h ^ u(8)) * u(1)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32)


def shard_numbers(task: int, buckets: int):
    """Distinct numbers for the shards of a task that fall into at most SPREAD buckets, in turn."""
    targets = sorted({(task * SPREAD + k) % buckets for k in range(SPREAD)})
    waiting: dict[int, list[int]] = {t: [] for t in targets}
    at = task << 32
    for target in cycle(targets):
        while not waiting[target]:
            tried = np.arange(at, at + 4 * buckets, dtype=np.int64)
            bucket, at = spark_hashes(tried) % buckets, at + len(tried)
            for t in targets:
                waiting[t] += tried[bucket == t].tolist()
        yield waiting[target].pop()


def even_parts(n: int, partitions: int) -> np.ndarray:
    """Numbers for n hash ranges that Spark deals evenly to its partitions; for very many, any numbers are dealt evenly enough."""
    if n > 64 * partitions:
        return np.arange(n)
    tried = np.arange(64 * (n + partitions))
    bucket = spark_hashes(tried) % partitions
    order = np.argsort(bucket, kind="stable")
    nth = np.arange(len(tried)) - np.searchsorted(bucket[order], bucket[order])  # within its bucket
    return tried[order[np.argsort(nth, kind="stable")]][:n]


class Shard:
    """A row of the shard table, with the anchors of all its documents."""

    def __init__(self, row: dict, length: int):
        self.ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(row["text"], np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.at = np.cumsum(np.frombuffer(row["gaps"], "<u4").astype(np.int64)) if len(row["gaps"]) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.ends, self.at, "right") - 1
        self.length = length

    def hashes(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, U)
        h, step = BYTE_KEY[self.data[self.at[:, None] + np.arange(ANCHOR)]], 1
        while step < ANCHOR:
            h = mixed_step(h[:, :-step], step) + h[:, step:]
            step *= 2
        return mixed(h[:, 0])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start of each anchor, in the shard's bytes."""
        h = self.hashes() & U(0xFFFFFFFF00000000)
        span = self.length - ANCHOR
        first = np.maximum(self.at - span, self.ends[self.doc])
        last = np.minimum(self.at, self.ends[self.doc + 1] - self.length)
        near = self.doc[1:] == self.doc[:-1]
        left_wins = h[:-1] <= h[1:]
        first[1:] = np.where(near & left_wins, np.maximum(first[1:], self.at[:-1] + 1), first[1:])
        last[:-1] = np.where(near & ~left_wins, np.minimum(last[:-1], self.at[1:] - span - 1), last[:-1])
        return first, last


def packed_columns(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def lay_shards(documents: DataFrame, length: int, with_rest: bool = False) -> DataFrame:
    """documents as shards, with the places of their anchors; `with_rest` keeps their other columns too."""

    rest = [c for c in documents.columns if c not in ("doc_id", "text")] if with_rest else []
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lay(batches):
        numbers = shard_numbers(task_number(), buckets)
        for batch in batches:
            done = 0
            for ids, offsets, data in slices(batch.column("doc_id"), batch.column("text"), SHARD_BYTES):
                at = [anchors(data[a:b], length) + a for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                gaps = np.diff(np.concatenate(at) if at else np.zeros(0, np.int64), prepend=0).astype("<u4")
                row = {"shard": next(numbers), "n_bytes": len(data), "ids": ids.astype(np.int64).tobytes(), "sizes": np.diff(offsets).astype(np.int64).tobytes(), "text": data.tobytes(), "gaps": gaps.tobytes()}
                if rest:
                    row["rest"] = packed_columns(batch.select(["rest"]).slice(done, len(ids)))
                done += len(ids)
                kinds = [("shard", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "text", "gaps", "rest"))]
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))
            pa.default_memory_pool().release_unused()  # workers are kept and reused

    source = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] * bool(rest))
    laid = source.mapInArrow(lay, SHARDS)
    name = f"polycurate_shards_{uuid.uuid4().hex}"
    path = scratch_folder(spark, "shards")  # not in the warehouse, which may be a folder of one machine
    laid.write.bucketBy(buckets, "shard").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
    except Exception:  # noqa: BLE001  the session has usually ended by then
        pass


def upper(h: np.ndarray, n: int = 6) -> bytes:
    """The upper n bytes of each number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :]).tobytes()


def from_upper(data, n: int = 6) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, 8 - n :] = part
    return out.reshape(-1).view("<u8")


def _rows(batches):
    """Rows as dicts; binary values are buffers of the batch, not copies."""
    for batch in batches:
        whole = [pa.types.is_binary(kind) or pa.types.is_large_binary(kind) for kind in batch.schema.types]
        for i in range(len(batch)):
            yield {name: c[i].as_buffer() if plain else c[i].as_py() for name, c, plain in zip(batch.schema.names, batch.columns, whole, strict=True)}
        del batch
        pa.default_memory_pool().release_unused()  # workers are kept and reused


def _split(order: np.ndarray, keys: np.ndarray):
    """(key, the rows of it) for keys in the given order."""
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part


def anchor_counts(shard: Shard) -> np.ndarray:
    """The shard's distinct anchor hashes, each with its counts. Contexts are told apart by the anchors on either side."""
    h = shard.hashes()
    if not len(h):
        return h
    near = shard.doc[1:] == shard.doc[:-1]
    around = mixed(np.append(U(0), np.where(near, h[:-1], U(0))) * U(0x9E3779B97F4A7C15) + np.append(np.where(near, h[1:], U(0)), U(0)))
    both = (h & KEY) | (around >> U(48))
    order = np.argsort(both)
    both, doc = both[order], shard.ids[shard.doc[order]]
    key = both & KEY
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    contexts = np.add.reduceat(np.append(True, both[1:] != both[:-1]).astype(np.int64), new)
    several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
    return key[new] | (np.minimum(contexts, MOST_COUNTED).astype(U) << U(1)) | several.astype(U)


def repeating_anchors(shards: DataFrame, ranges: int, length: int, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(shard, plain, hot): the shard's anchors that occur in two documents anywhere; hot ones have more than hot_contexts contexts."""
    parts = even_parts(ranges, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send(batches):
        for row in _rows(batches):
            h = anchor_counts(Shard(row, length))
            part = parts[((h >> U(33)) % U(ranges)).astype(np.int64)]
            out = [(int(k), row["shard"], upper(h[p], 8)) for k, p in _split(np.argsort(part, kind="stable"), part)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "hashes"])

    def find(table: pa.Table) -> pa.Table:
        blobs = [from_upper(b.as_buffer(), 8) for b in table.column("hashes")]
        shard = np.repeat(table.column("shard").to_numpy(), [len(b) for b in blobs])
        h = np.concatenate(blobs)
        order = np.argsort(h & KEY, kind="stable")
        h, shard = h[order], shard[order]
        contexts, several, h = ((h >> U(1)) & U(MOST_COUNTED)).astype(np.int64), h & U(1) > 0, h & KEY
        new = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        count = np.diff(np.append(new, len(h)))
        # two shards hold different documents, unless rows of one doc_id lie in both: that only sends more than is needed
        repeats = (count > 1) | np.logical_or.reduceat(several, new)
        hot = np.repeat(np.add.reduceat(contexts, new) > hot_contexts, count)
        keep = np.repeat(repeats, count)
        h, shard, hot = h[keep], shard[keep], hot[keep]
        out = []
        for x in (False, True):
            rows = np.flatnonzero(hot == x)
            out += [(s, x, upper(h[p])) for s, p in _split(rows[np.argsort(shard[rows], kind="stable")], shard)]
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "hot": pa.array([o[1] for o in out], pa.bool_()), "hashes": pa.array([o[2] for o in out], pa.binary())})

    sent = shards.drop("rest").mapInArrow(send, "part long, shard long, hashes binary")
    found = sent.groupBy("part").applyInArrow(find, "shard long, hot boolean, hashes binary")
    return found.groupBy("shard").agg(F.collect_list(F.when(~F.col("hot"), F.col("hashes"))).alias("plain"), F.collect_list(F.when(F.col("hot"), F.col("hashes"))).alias("hot"))


def contexts(row: dict, length: int) -> dict[str, np.ndarray]:
    """The distinct contexts of a shard's repeating anchors, and where each occurs.

    A context is 2 * length - ANCHOR bytes around the anchor, zero outside the windows that the anchor owns. For hot anchors
    each window is a context of its own, its bytes at the front.
    """
    shard = Shard(row, length)
    span, width = length - ANCHOR, 2 * length - ANCHOR
    h = shard.hashes() & KEY
    plain, hot = (np.unique(np.concatenate([from_upper(b) for b in row[k]] or [np.zeros(0, U)])) for k in ("plain", "hot"))
    first, last = shard.windows()
    is_hot, is_plain = np.isin(h, hot), np.isin(h, plain)
    a = np.flatnonzero(is_plain & (last >= first))
    b = np.flatnonzero(is_hot & (last >= first))
    count = last[b] - first[b] + 1
    each = np.repeat(b, count)
    start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.concatenate([np.zeros(width, np.uint8), shard.data, np.zeros(width, np.uint8)])
    base = np.concatenate([shard.at[a] - span, start])  # where the context's first byte lies
    lo = np.concatenate([first[a] - shard.at[a] + span, np.zeros(len(start), np.int64)]).astype(np.int64)
    hi = np.concatenate([last[a] - shard.at[a] + span, np.zeros(len(start), np.int64)]).astype(np.int64)
    doc = shard.ids[np.concatenate([shard.doc[a], shard.doc[each]]).astype(np.int64)]
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    text = view[base + width].copy() if len(base) else np.zeros((0, width), np.uint8)
    column = np.arange(width)
    text[(column < lo[:, None]) | (column >= hi[:, None] + length)] = 0
    key = np.concatenate([h[a], np.zeros(len(start), U)])
    if len(start):
        key[len(a) :] = _row_hashes(text[len(a) :, :length]) & KEY
    return {"base": base, "lo": lo, "hi": hi, "doc": doc, "text": text, "key": key, "shard": shard}


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    pad = np.zeros((n, -(-width // 8) * 8), np.uint8)
    pad[:, :width] = rows
    h = np.full(n, U(width))
    for word in pad.view(U).T:
        h = mixed(h * U(0x9E3779B97F4A7C15) + word)
    return h


def distinct_rows(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one row number of each distinct context, number of the distinct context of each row)."""
    h = mixed(_row_hashes(c["text"]) + c["key"] + (c["lo"] * 4096 + c["hi"]).astype(U))
    _, chosen, number = np.unique(h, return_index=True, return_inverse=True)
    same = (c["text"] == c["text"][chosen][number]).all(axis=1) & (c["lo"] == c["lo"][chosen][number]) & (c["hi"] == c["hi"][chosen][number])
    odd = np.flatnonzero(~same)  # hashes that clash: rows of their own
    number[odd] = len(chosen) + np.arange(len(odd))
    return np.concatenate([chosen, odd]), number


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(column: pa.ChunkedArray, sizes: list[int], kind) -> np.ndarray:
    parts = [np.frombuffer(pa.decompress(b.as_buffer(), size, codec="zstd"), kind) for b, size in zip(column, sizes, strict=True)]
    return np.concatenate(parts)


def least(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, groups, values)
    return out


def send_contexts(joined: DataFrame, ranges: int, length: int) -> DataFrame:
    """(part, shard, n, numbers, keys, lo, hi, docs, text): distinct contexts with the least doc_id that each has in the shard."""
    parts = even_parts(ranges, int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send(batches):
        for row in _rows(batches):
            c = contexts(row, length)
            if not len(c["base"]):
                continue
            chosen, number = distinct_rows(c)
            doc = least(c["doc"], number, len(chosen))
            part = parts[((c["key"][chosen] >> U(33)) % U(ranges)).astype(np.int64)]
            out = []
            for k, p in _split(np.argsort(part, kind="stable"), part):
                q = chosen[p]
                out.append((k, row["shard"], p.astype(np.uint32).tobytes(), upper(c["key"][q]), c["lo"][q].astype(np.uint8).tobytes(), c["hi"][q].astype(np.uint8).tobytes(), squeezed(doc[p]), squeezed(c["text"][q])))
            kinds = (pa.int64(), pa.int64(), *(pa.binary(),) * 6)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["part", "shard", "numbers", "keys", "lo", "hi", "docs", "text"])

    return joined.mapInArrow(send, "part long, shard long, numbers binary, keys binary, lo binary, hi binary, docs binary, text binary")


def least_starts(c: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, nth), ascending: windows of contexts for which a smaller doc_id exists than the row's own. The rows hold whole anchors."""
    key, lo, hi, doc, text, shard = c["key"], c["lo"], c["hi"], c["doc"], c["text"], c["shard"]
    chosen, same = distinct_rows(c)
    lowest = least(doc, same, len(chosen))
    count = hi[chosen] - lo[chosen] + 1
    begin = np.cumsum(count) - count  # of each distinct context's windows
    found = np.repeat(lowest, count)
    # an anchor with one distinct context repeats nothing but that; the others' transforms are merged
    _, anchor, contexts_of = np.unique(key[chosen], return_inverse=True, return_counts=True)
    rows = np.flatnonzero(contexts_of[anchor] > 1)
    row = np.repeat(rows, count[rows])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
    place = anchor[row] * 256 + lo[chosen[row]] + nth  # equal windows have one anchor at one place
    order = np.argsort(place, kind="stable")
    row, nth, place = row[order], nth[order], place[order]
    at = 0
    while at < len(row):  # whole places, about MERGE_WINDOWS at a time
        to = len(row) if at + MERGE_WINDOWS >= len(row) else int(np.searchsorted(place, place[at + MERGE_WINDOWS], "left"))
        to = to if to > at else int(np.searchsorted(place, place[at], "right"))
        r, k = row[at:to], nth[at:to]
        by_shard = np.argsort(shard[chosen[r]], kind="stable")
        r, k = r[by_shard], k[by_shard]
        windows = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)[chosen[r], lo[chosen[r]] + k]
        group = equal_windows(windows, sources=shard[chosen[r]])
        found[begin[r] + k] = least(lowest[r], group, int(group.max()) + 1)[group]
        at = to
    mine = np.repeat(np.arange(len(key)), count[same])
    nth = np.arange(len(mine)) - np.repeat(np.cumsum(count[same]) - count[same], count[same])
    less = found[begin[same[mine]] + nth] < doc[mine]
    return mine[less], nth[less]


def merged_range(table: pa.Table, length: int) -> pa.Table:
    """(shard, numbers, nth, runs): runs of windows of the shards' contexts for which a smaller doc_id exists elsewhere."""
    column = lambda name, kind: np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name)])
    number, lo, hi = column("numbers", np.uint32), column("lo", np.uint8).astype(np.int64), column("hi", np.uint8).astype(np.int64)
    key = np.concatenate([from_upper(b.as_buffer()) for b in table.column("keys")])
    sizes = [len(b.as_buffer()) // 4 for b in table.column("numbers")]
    width = 2 * length - ANCHOR
    doc = unsqueezed(table.column("docs"), [8 * n for n in sizes], np.int64)
    text = unsqueezed(table.column("text"), [width * n for n in sizes], np.uint8).reshape(-1, width)
    shard = np.repeat(table.column("shard").to_numpy(), sizes)
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    found, at = [], 0
    while at < len(order):  # whole anchors, about CONTEXTS rows at a time
        cut = np.searchsorted(edges, at + CONTEXTS)
        to = int(edges[cut]) if cut < len(edges) else len(order)
        rows = order[at:to]
        mine, nth = least_starts({"key": key[rows], "lo": lo[rows], "hi": hi[rows], "doc": doc[rows], "text": text[rows], "shard": shard[rows]}, length)
        new = np.flatnonzero((np.diff(mine, prepend=-1) != 0) | (np.diff(nth, prepend=-1) != 1))  # most runs are all of a context
        found.append((rows[mine[new]], nth[new], np.diff(np.append(new, len(mine)))))
        at = to
    mine, nth, run = (np.concatenate([f[i] for f in found]) for i in range(3))
    out = [(s, number[mine[p]].tobytes(), nth[p].astype(np.uint8).tobytes(), run[p].astype(np.uint8).tobytes()) for s, p in _split(np.argsort(shard[mine], kind="stable"), shard[mine])]
    kinds = (pa.int64(), *(pa.binary(),) * 3)
    del text, key, found
    pa.default_memory_pool().release_unused()
    return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["shard", "numbers", "nth", "runs"])


def removed_bytes(row: dict, length: int) -> tuple[Shard, np.ndarray]:
    """The shard and which of its bytes go."""
    shard = Shard(row, length)
    gone = np.zeros(len(shard.data) + 1, np.int64)
    if row["plain"] is not None:
        c = contexts(row, length)
        if len(c["base"]):
            chosen, number = distinct_rows(c)
            doc = least(c["doc"], number, len(chosen))
            count = c["hi"] - c["lo"] + 1
            begin_of = np.cumsum(count[chosen]) - count[chosen]
            edges = np.zeros(int(count[chosen].sum()) + 1, np.int64)  # of the runs that start earlier elsewhere
            for found in row["found"] or []:
                at = begin_of[np.frombuffer(found["numbers"], np.uint32)] + np.frombuffer(found["nth"], np.uint8)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + np.frombuffer(found["runs"], np.uint8), -1)
            earlier = np.cumsum(edges) > 0
            each = np.repeat(np.arange(len(number)), count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            hit = earlier[begin_of[number[each]] + nth] | (doc[number] < c["doc"])[each]
            start = c["base"][each[hit]] + c["lo"][each[hit]] + nth[hit]
            gone += np.bincount(start, minlength=len(gone)) - np.bincount(start + length, minlength=len(gone))
    return shard, np.cumsum(gone)[:-1] > 0


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _repeats(documents: DataFrame, length: int, hot_contexts: int, with_rest: bool = False) -> DataFrame:
    """Shards with what tells which of their bytes go."""
    shards = lay_shards(documents, length, with_rest)
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // RANGE_BYTES))
    known = written(repeating_anchors(shards, ranges, length, hot_contexts), "anchors")
    joined = shards.drop("rest").join(known.hint("shuffle_hash"), "shard")
    found = send_contexts(joined, 2 * ranges, length).groupBy("part").applyInArrow(lambda t: merged_range(t, length), "shard long, numbers binary, nth binary, runs binary")
    found = written(found.groupBy("shard").agg(F.collect_list(F.struct("numbers", "nth", "runs")).alias("found")), "found")
    return shards.join(known.hint("shuffle_hash"), "shard", "left").join(found.hint("shuffle_hash"), "shard", "left")


def repeats_report(documents: DataFrame, length: int = 50, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """For each document: bytes, bytes removed, maximal removed runs, SHA-256 of the bytes that stay."""

    def report(batches):
        for row in _rows(batches):
            shard, gone = removed_bytes(row, length)
            out = []
            for i, doc_id in enumerate(shard.ids.tolist()):
                text, off = shard.data[shard.ends[i] : shard.ends[i + 1]], gone[shard.ends[i] : shard.ends[i + 1]]
                spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if len(off) else 0
                out.append((None if doc_id == NO_ID else doc_id, len(text), int(off.sum()), spans, hashlib.sha256(text[~off].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _repeats(documents, length, hot_contexts).mapInArrow(report, REPORT)


def remaining_texts(documents: DataFrame, length: int = 50, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """documents, in all their columns, with what is left of each text; characters of which a part goes, go whole."""
    names = documents.columns
    kinds = {f.name: f.dataType for f in documents.schema.fields} | {"doc_id": LongType(), "text": StringType()}
    schema = StructType([StructField(n, kinds[n]) for n in names])

    def keep(batches):
        for row in _rows(batches):
            shard, gone = removed_bytes(row, length)
            columns = {
                "doc_id": pa.array([None if i == NO_ID else i for i in shard.ids.tolist()], pa.int64()),
                "text": pa.array([shard.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(shard.ends[:-1].tolist(), shard.ends[1:].tolist(), strict=True)], pa.string()),
            }
            if row["rest"] is not None:
                rest = pa.ipc.open_stream(row["rest"]).read_next_batch().column("rest")
                columns |= {rest.type.field(i).name: rest.field(i) for i in range(rest.type.num_fields)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return _repeats(documents, length, hot_contexts, True).mapInArrow(keep, schema)
