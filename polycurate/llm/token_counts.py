"""Token counts by the whole-token shortcut.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each give a row; other
columns of the input are ignored; a very long text is counted alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, text_or_empty
from .tokens import WholeTokenCounter, proven_whole_tokens

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of text."""
    for batch in batches:
        at = 0
        while at < len(batch):
            to, held = at, 0
            while to < len(batch) and (to == at or held < limit):
                held += len(batch.column("text")[to].as_buffer() or b"")
                to += 1
            yield batch.slice(at, to - at)
            at = to


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, as the byte-level vocabulary at `tokenizer_path` gives them."""
    whole = documents.sparkSession.sparkContext.broadcast(proven_whole_tokens(tokenizer_path))  # at most the vocabulary

    def count(batches):
        counter = WholeTokenCounter(tokenizer_path, whole.value)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            tokens = counter.count(texts)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(count, SCHEMA)
