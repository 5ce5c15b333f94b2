"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents. Stages work on everything that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycurate.llm import decontamination, near_dup, packing, quality_rules, suffix_dedup
from polycurate.llm.common import read_table, written

#: The SimHash, HyperMinHash, interleave and packing stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps.

    Null and empty texts have no words and go; rows without doc_id and rows that repeat are judged one by one like all others;
    very long texts are measured whole; columns of any name are carried along; an empty table stays empty.
    """
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked over five-word shingles at a similarity of 0.8.

    Texts without words are linked with nothing and stay; rows without doc_id are linked with nothing and stay; rows that repeat
    one doc_id are one document and stay or go together, whatever their texts; other columns are carried along whatever their
    names; an empty table stays empty.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), shingle_words=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that start in an earlier document; no row is dropped.

    n_chars is counted anew. A null text becomes an empty one; a null doc_id counts as the smallest; rows of one doc_id remove
    nothing from each other; a character of which any byte goes, goes whole; other columns are carried along whatever their
    names; an empty table stays empty.
    """
    left = suffix_dedup.remaining_texts(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, each row judged by its own text.

    Rows without doc_id that leak go too; null and empty texts leak nothing; rows that repeat go together; a window of a very
    long text counts like any other; other columns are carried along whatever their names; an empty table stays empty.
    """
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    A null or empty text is its end token; a null doc_id stays null; every row, repeated or not, is packed once; very long texts
    are cut into full windows; other columns are not carried; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
