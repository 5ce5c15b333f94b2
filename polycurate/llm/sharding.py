"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, row number), so equal texts stand together and a hot text, or even one row
repeated, can still be divided. A size-weighted sample of these keys gives quantile boundaries; records are range-partitioned by
them, ranges that turn out overfull are subdivided by a sample of their own, and running sums within the ranges give every shard
the same bytes.

Defined cases: a null text has size 1 and stands with empty texts; a null doc_id stays null and sorts first; repeated rows each
get a slot, in the order of the input's files; a very long text is one row and so lies in one shard, whatever its size; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written

#: Rows that a range should hold, and the most ranges that the driver plans for.
RANGE_ROWS, MOST_RANGES = 20_000, 16_384
#: Sampled keys for each range.
OVERSAMPLING = 24
#: A range is overfull beyond this many times its share; rounds of subdivision.
OVERFULL, ROUNDS = 1.25, 4


#: What records are ordered by.
KEYS = ("key", "tie", "row")


def keyed(documents: DataFrame) -> DataFrame:
    text = text_or_empty()
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Each row of signed numbers as bytes that sort as the numbers do."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for i, c in enumerate(columns):
        out[:, i] = (np.asarray(c, np.int64) ^ np.int64(-(1 << 63))).view(np.uint64)
    return out.view(f"S{8 * len(columns)}").ravel()


def ranged(records: DataFrame, boundaries: list[tuple]) -> DataFrame:
    """records with the number of boundaries at or below each of them."""
    edges = packed([np.asarray([b[i] for b in boundaries], np.int64) for i in range(len(KEYS))])

    def locate(batches):
        for batch in batches:
            at = np.searchsorted(edges, packed([batch.column(k).to_numpy(zero_copy_only=False) for k in KEYS]), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "part"])

    return records.mapInArrow(locate, "doc_id long, size long, text_crc32 long, key long, tie long, row long, part long")


def _sample(records: DataFrame, rate: Column) -> list[tuple]:
    """Keys drawn in proportion to size, row by row; the draw is a hash, so a repeated task draws the same."""
    draw = F.pmod(F.xxhash64(*KEYS, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return [tuple(r) for r in records.filter(draw < rate).select(*KEYS).collect()]  # about OVERSAMPLING * ranges keys


def splitters(records: DataFrame, n: int, total: int, ranges: int) -> list[tuple]:
    """Quantile boundaries from a size-weighted sample, with overfull ranges subdivided by samples of their own.

    A record weighs its bytes and the mean's on top, so that ranges of short records do not hold too many of them.
    """
    weight = F.col("size") + total / max(n, 1)
    share = 2 * total / ranges
    drawn = sorted(_sample(records, weight * (OVERSAMPLING / max(share, 1))))
    chosen = sorted({drawn[i] for i in range(OVERSAMPLING, len(drawn), OVERSAMPLING)})
    for _ in range(ROUNDS):
        parted = ranged(records, chosen)
        full = parted.groupBy("part").agg(F.sum(weight).alias("weight"), F.count("*").alias("n")).filter((F.col("weight") > OVERFULL * share) & (F.col("n") > 1))
        over = full.collect()  # fewer than there are ranges
        if not over:
            break
        rates = records.sparkSession.createDataFrame([(r.part, 2 * OVERSAMPLING / share) for r in over], "part long, rate double")
        again = sorted(_sample(parted.join(F.broadcast(rates), "part"), weight * F.col("rate")))
        more = {again[i] for i in range(OVERSAMPLING, len(again), OVERSAMPLING)} - set(chosen)
        if not more:
            break
        chosen = sorted({*chosen, *more})
    return chosen


def shard(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard and slot; the shards' bytes differ by about one document."""
    records = written(keyed(documents), "shard-keys")
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(4 * shards, n // RANGE_ROWS)))
    parted = written(ranged(records, splitters(records, n, total, ranges)), "shard-ranges")
    discard(records)
    counted = parted.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()  # at most the ranges
    rows_before = bytes_before = 0
    before = []
    for r in counted:
        before.append((r.part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.n
    starts = documents.sparkSession.createDataFrame(before, "part long, bytes_before long, rows_before long")
    order = Window.partitionBy("part").orderBy(*KEYS)
    running = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("bytes_before")
    placed = parted.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(running * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("position"),
    )
    placed = written(placed, "shard-placed")
    discard(parted)
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
