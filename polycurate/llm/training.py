"""Samples of documents for the classifiers that are fitted on the driver. What a fit reads of a text is measured by the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written


def fold(of: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def sample_ids(ids: DataFrame, bound: int) -> DataFrame:
    """At most `bound` rows of ids, the first by a hash of doc_id: the same rows on every run, and all of them where there are fewer."""
    return ids.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def sampled(documents: DataFrame, ids: DataFrame, bound: int, measure: Callable, kind: str, most: tuple[str, int] | None = None) -> list[Row]:
    """(doc_id, the other columns of ids, what `measure` (a mapInArrow function over doc_id, text and those columns) adds) by doc_id.

    At most `bound` rows: of rows of one doc_id that of the least text hash counts. most: a binary column, and the bytes that it may
    have in all; rows beyond, by a hash of doc_id, are left out.
    """
    chosen = sample_ids(ids, bound)
    texts = source(documents).join(F.broadcast(chosen), "doc_id").withColumn("text_key", F.xxhash64("text"))  # at most `bound` rows of numbers
    own = [f"{c} {t}" for c, t in chosen.dtypes if c != "doc_id"]
    rows = texts.mapInArrow(measure, ", ".join(["doc_id long", "text_key long", *own, kind]))
    least = rows.groupBy("doc_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("x"))
    least = least.select("doc_id", "x.*")
    if most is None:
        return sorted(least.collect(), key=lambda r: r.doc_id)
    least = written(least, "measured")
    so_far = F.sum(F.octet_length(most[0])).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `bound` numbers
    within = least.select("doc_id", so_far.alias("so_far")).filter(F.col("so_far") <= most[1]).select("doc_id")
    out = sorted(least.join(F.broadcast(within), "doc_id", "left_semi").collect(), key=lambda r: r.doc_id)
    discard(least)
    return out
