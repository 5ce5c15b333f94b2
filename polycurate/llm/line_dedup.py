"""Line deduplication, in DataFrame functions only: keys of lines that occur in several documents keep their lines in the last of them.

1. Each line's key (stripped, A-Z in lower case) of enough characters becomes 128 bits of hashes beside doc_id and position; texts
   go no further.
2. The hashes are dealt by ranges of (hash, doc_id downwards, position) and sorted so within each range, so a key that half of all
   lines have fills many ranges instead of one. Only keys at the ends of ranges can lie in two; there are at most two for each
   range, and their greatest and least documents, and whether any lies between, come from aggregates that combine before rows move.
3. All other keys lie within one range. A window streams each key's lines from the greatest doc_id down: the first document keeps
   its lines, those of the others go if there is a third document.
4. The places that go are gathered for each document and return as a run-length bitmap: the runs of lines that stay. A document
   without a row keeps all its lines. `without_lines` applies the bitmaps to the texts.

Defined cases: a null or empty text is one empty line; a row with a null doc_id shares keys with nothing and keeps its lines; rows
of one doc_id are one document, told apart by their texts, and repeated rows lose the same lines; keys count by distinct doc_id, so
a line that one document repeats stays; a very long text is split within its row, and its bitmap is as long as its runs; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written

#: Code points that a key must have, and documents that must hold it.
LEAST_CHARACTERS, LEAST_DOCUMENTS = 20, 3
#: Fixed value: the characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _lowered(text: Column) -> Column:
    """A-Z as a-z, other characters as they are."""
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def line_hashes(documents: DataFrame, least_characters: int = LEAST_CHARACTERS) -> DataFrame:
    """(h, g, doc, text_hash, n_lines, at): 128 bits of the key of every line that counts, and where it stands."""
    text = text_or_empty()
    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), _text_hash(text).alias("text_hash"), F.split(_lowered(text), "\n").alias("lines"))
    lines = rows.select("doc", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line"))
    keys = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("key") >= least_characters)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "doc", "text_hash", "n_lines", "at")


def _across(ranges: DataFrame) -> DataFrame:
    """(h, g, last, several): the keys that lie in two ranges or more, their greatest doc, and whether they have enough documents.

    At most two rows for each range: its least and its greatest key.
    """
    key = F.struct("h", "g")
    ends = ranges.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    spanning = ends.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key.h", "key.g")
    extremes = ranges.join(F.broadcast(spanning), ["h", "g"]).groupBy("h", "g").agg(F.max("doc").alias("last"), F.min("doc").alias("least"))
    extremes = written(extremes, "extremes")
    between = ranges.join(F.broadcast(extremes), ["h", "g"]).filter("least < doc and doc < last").groupBy("h", "g").agg(F.lit(True).alias("several"))
    return extremes.join(F.broadcast(between), ["h", "g"], "left").select("h", "g", "last", F.coalesce("several", F.lit(False)).alias("several"))


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """The rows of `line_hashes` whose lines go."""
    order = [F.col("h"), F.col("g"), F.col("doc").desc(), F.col("text_hash"), F.col("at")]
    ranges = written(hashes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges")
    across = written(_across(ranges), "across")
    spread = ranges.join(F.broadcast(across), ["h", "g"]).filter("several and doc < last")
    within = ranges.join(F.broadcast(across), ["h", "g"], "left_anti")
    down = Window.partitionBy("h", "g").orderBy(F.col("doc").desc())
    ranked = within.withColumns({"rank": F.dense_rank().over(down), "least": F.min("doc").over(Window.partitionBy("h", "g"))})
    repeats = ranked.filter("rank > 2 or (rank = 2 and least < doc)")  # the second document's lines go only if there is a third
    columns = ["doc", "text_hash", "n_lines", "at"]
    return spread.select(*columns).union(repeats.select(*columns))


def _kept_runs(gone: Column, n_lines: Column) -> Column:
    """Runs (first line, lines) between the ascending places that go."""
    before = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    run = lambda i: F.struct((before(i) + 1).alias("first"), (F.coalesce(F.get(gone, i), n_lines) - before(i) - 1).alias("lines"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(gone)), run), lambda x: x["lines"] > 0)


def keep_bitmaps(documents: DataFrame, least_characters: int = LEAST_CHARACTERS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, kept_runs: array of (first, lines) from 0; one row for each document that loses lines."""
    hashes = written(line_hashes(documents, least_characters), "line-hashes")
    gone = dropped_lines(hashes).groupBy("doc", "text_hash", "n_lines").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    bitmaps = written(gone.select(F.col("doc").alias("doc_id"), "text_hash", "n_lines", F.size("gone").alias("n_dropped"), _kept_runs(F.col("gone"), F.col("n_lines")).alias("kept_runs")), "bitmaps")
    discard(hashes)
    return bitmaps


def without_lines(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (the lines that stay, joined), n_lines (before), n_dropped; one row per document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", _text_hash(F.col("text")))
    both = texts.join(bitmaps.select("doc_id", "text_hash", "n_dropped", "kept_runs").hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    lines = F.split("text", "\n")
    kept = F.flatten(F.transform("kept_runs", lambda run: F.slice(F.col("lines"), run["first"] + 1, run["lines"])))
    return both.withColumn("lines", lines).select(
        "doc_id", F.when(F.col("kept_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
