"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

A document leaks an item if a window of as many words as the item has a weighted Jaccard similarity of 0.8 or more with it, over
five-word shingles weighted by how often each occurs. Windows may hang over either end of the text; only the words inside count.

1. Documents' shingle hashes meet those of the benchmark. A similar window holds at least 0.8 of an item's number of shingles in
   such places, wherever they lie in the item, so every window with that many gets a fingerprint and no other can be similar.
2. Each window and each item gets a 128-bit SimHash of its words. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS
   bits agree on a block, so joining on (words, block, value) finds every item within the radius of a window.
3. The similarity of these pairs is computed exactly; the best window of each document and item is reported.

At the threshold at most about a tenth of a window's words differ, which puts 18 of 128 bits apart on average (standard deviation
4); the radius is five deviations beyond that, and unlike windows lie at 64 (standard deviation 6).

Defined cases: words are runs of letters and digits, lower-cased; null, empty and wordless texts leak nothing; a document or item
of fewer than five words is one shingle, so only the same whole sequence matches; a null doc_id or item_id stays null; repeated
rows of documents give one row; of windows equally similar the first counts; other columns are ignored; an empty table on either
side gives no rows; a very long text is cut into its shingles within its row, and only windows that may leak leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

SHINGLE_WORDS, PERCENT = 5, 80
#: Bits by which fingerprints of similar windows may differ; one block more, half of them in each 64-bit lane.
RADIUS = 39
LANES = ("high", "low")
#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def word_array(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def shingles(words: Column) -> Column:
    """Hashes of the shingles in order; one of the whole where there are fewer words, none where there are none."""
    several = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]))
    whole = F.array(F.xxhash64(words))
    return F.when(F.size(words) >= SHINGLE_WORDS, several).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column, planes: int) -> Column:
    """64 bits: each is set where more than half of the words' hashes have it. For fewer than 2 ** planes words.

    The 64 counters are kept bit-sliced: plane k holds bit k of every counter, so a word is added to all of them at once.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(planes)])

    def add(sums: Column, word: Column) -> Column:
        carry, out = word, []
        for k in range(planes):
            out.append(sums[f"p{k}"].bitwiseXOR(carry).alias(f"p{k}"))
            carry = carry.bitwiseAND(sums[f"p{k}"])
        return F.struct(*out)

    def majority(sums: Column) -> Column:
        least = F.floor(F.size(words) / 2).cast("long") + 1
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for k in reversed(range(planes)):  # compares every counter with `least`, from the highest bit down
            digit, plane = -F.call_function("shiftright", least, F.lit(k)).bitwiseAND(F.lit(1).cast("long")), sums[f"p{k}"]
            more = more.bitwiseOR(equal.bitwiseAND(plane).bitwiseAND(F.bitwise_not(digit)))
            equal = equal.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(digit)))
        return more.bitwiseOR(equal)

    return F.aggregate(words, zero, add, majority)


def fingerprint(words: Column, planes: int) -> Column:
    """Two 64-bit SimHashes over different hashes of the words."""
    return F.struct(simhash(words, planes).alias("high"), simhash(F.transform(words, lambda w: F.xxhash64(w)), planes).alias("low"))


def blocks(mark: Column) -> Column:
    """RADIUS + 1 parts of the fingerprint, each with its number."""
    half = (RADIUS + 1) // 2
    edges = [64 * i // half for i in range(half + 1)]
    return F.array(*[
        F.struct(F.lit(lane * half + i).alias("block"), F.shiftrightunsigned(mark[name], a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int").alias("value"))
        for lane, name in enumerate(LANES) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[lane].bitwiseXOR(b[lane])) for lane in LANES), F.lit(0))


def common_weight(x: Column, y: Column) -> Column:
    """Shingles that two lists share, each as often as both have it."""
    once = lambda z: F.size(F.array_distinct(z)) == F.size(z)
    count = lambda z, g: F.size(F.filter(z, lambda h: h == g))
    each = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(count(x, g), count(y, g)))
    return F.when(once(x) | once(y), F.size(F.array_intersect(x, y))).otherwise(each)


def bounded(small: DataFrame, size: Column | int) -> DataFrame:
    """small, marked for broadcast if its rows, of `size` bytes each, have at most BROADCAST_BYTES, else for a shuffled hash join."""
    total = small.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(small) if total <= BROADCAST_BYTES else small.hint("shuffle_hash")


def dense_starts(places: Column, n_shingles: Column, percent: int) -> Column:
    """(first, last) of the runs of starts whose windows of n_shingles shingles hold at least percent of that number of places.

    places ascend. A window holds that many if it covers some place and the (needed - 1)th after it; runs do not overlap.
    """
    needed = F.ceil(n_shingles * percent / 100).cast("int")
    run = lambda i: F.struct(
        F.greatest(F.get(places, i + needed - 1) - n_shingles + 1, F.get(places, i - 1) + 1).alias("first"), F.get(places, i).alias("last"))
    runs = F.transform(F.sequence(F.lit(0), F.size(places) - needed), run)
    return F.when(F.size(places) >= needed, F.filter(runs, lambda r: r["first"] <= r["last"]))


def _leaking_windows(documents: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start, n_words): windows that reach the threshold."""
    items = benchmark.select("item_id", word_array(text_or_empty()).alias("words")).select("item_id", "words", F.size("words").alias("of")).filter("of > 0")
    items = written(items.withColumn("shingles", shingles(F.col("words"))), "items")
    planes = (items.agg(F.coalesce(F.max("of"), F.lit(1))).first()[0]).bit_length()
    places = items.select("of", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("shingle")).distinct()

    text = text_or_empty()
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    worded = source.select("doc_id", "text_key", word_array(F.col("text")).alias("words"))
    met = worded.select("doc_id", "text_key", F.posexplode(shingles(F.col("words"))).alias("at", "shingle")).join(bounded(places, 32), "shingle")
    dense = met.groupBy("doc_id", "text_key", "of", "n_shingles").agg(F.array_sort(F.collect_set("at")).alias("places"))
    dense = dense.select("doc_id", "text_key", "of", dense_starts(F.col("places"), F.col("n_shingles"), percent).alias("runs")).filter(F.size("runs") > 0)
    seeds = written(dense.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("of", "runs")).alias("seeds")), "seeds")

    seeded = source.alias("d").join(bounded(seeds, 64 + 32 * F.aggregate("seeds", F.lit(0), lambda n, s: n + 1 + F.size(s["runs"]))).alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")))
    windows = seeded.select("d.doc_id", "d.text_key", "seeds", word_array(F.col("text")).alias("words"))
    windows = windows.select("doc_id", "text_key", "words", F.explode("seeds").alias("s")).select("doc_id", "text_key", "words", "s.of", F.explode("s.runs").alias("run"))
    windows = windows.select("doc_id", "text_key", "words", "of", F.explode(F.sequence("run.first", "run.last")).alias("start"))
    inside = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("of") + F.least(F.col("start"), F.lit(0)))
    windows = windows.select("doc_id", "text_key", "of", "start", inside.alias("words")).distinct()
    windows = windows.select("doc_id", "text_key", "of", "start", F.size("words").alias("n_words"), shingles(F.col("words")).alias("shingles"), fingerprint(F.col("words"), planes).alias("mark"))
    windows = written(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")

    marked = items.select("item_id", "of", F.col("shingles").alias("item_shingles"), fingerprint(F.col("words"), planes).alias("item_mark"))
    marked = written(marked.withColumn("item", F.monotonically_increasing_id()), "marked")  # a null item_id has a number too
    probes = windows.select("window_id", "of", "mark", F.explode(blocks(F.col("mark"))).alias("b")).select("window_id", "of", "mark", "b.*")
    index = marked.select("item", "of", "item_mark", F.explode(blocks(F.col("item_mark"))).alias("b")).select("item", "of", "item_mark", "b.*")
    near = probes.join(bounded(index, 64), ["of", "block", "value"]).filter(distance(F.col("mark"), F.col("item_mark")) <= RADIUS)
    near = near.select("window_id", "item").distinct()

    pairs = near.join(windows, "window_id").join(bounded(marked.drop("of", "item_mark"), 64 + 8 * F.size("item_shingles")), "item")
    common = pairs.withColumn("common", common_weight(F.col("shingles"), F.col("item_shingles")))
    similar = common.withColumn("all", F.size("shingles") + F.size("item_shingles") - F.col("common")).filter(100 * F.col("common") >= percent * F.col("all"))
    return similar.select("doc_id", "text_key", "item_id", (F.col("common") / F.col("all")).alias("similarity"), "start", "n_words")


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each document's best window for each item that it leaks."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words"))
    found = _leaking_windows(documents, benchmark, percent).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", "b.similarity", F.greatest(-F.col("b.start"), F.lit(0)).alias("start_word"), "b.n_words")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document that leaks an item: doc_id, item_ids."""
    return leaks(documents, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents, in all their columns, without the rows whose text leaks an item. Rows without doc_id are told apart by their text."""
    gone = _leaking_windows(documents, benchmark, PERCENT).select("doc_id", "text_key").distinct()
    # all columns go as one, so none of their names can clash
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_or_empty()).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    return rows.join(bounded(written(gone, "leaking"), 48), same, "left_anti").select("_row.*")
