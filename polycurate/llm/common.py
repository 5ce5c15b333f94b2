"""Helpers that every operator of this subpackage shares: reading tables, cutting lineage, cleaning up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard as discard
from ..sources.scratch import settled

#: Rough bytes of text that Python code holds at once; a longer document stands alone.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch whose texts are copied at once.
CAST_ROWS = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; see `settled`."""
    return settled(df, label)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(ids: pa.Array, texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, offsets, bytes) of consecutive rows, about `limit` bytes at a time; the bytes are the texts' UTF-8, one after another."""
    for begin in range(0, len(ids), CAST_ROWS):  # a cast copies
        own = ids.slice(begin, CAST_ROWS)
        keys = np.asarray(own.fill_null(-1) if own.null_count else own)
        part = texts.slice(begin, CAST_ROWS).cast(pa.large_binary())
        buffers = part.buffers()
        ends = np.frombuffer(buffers[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield keys[at:to], ends[at : to + 1] - ends[at], data[ends[at] : ends[to]]
            at = to


def per_document(batches: Iterable[pa.RecordBatch], keep: tuple[str, ...], measure: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The columns `keep` of a mapInArrow iterator, nulls and all, beside what measure(offsets, bytes) gives for the documents' texts."""
    for batch in batches:
        at = 0
        for ids, offsets, data in slices(batch.column("doc_id"), batch.column("text"), limit):
            made = measure(offsets, data)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(ids)) for c in keep], *made.values()], names=[*keep, *made])
            at += len(ids)
        del batch
        pa.default_memory_pool().release_unused()  # workers are kept and reused


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
