"""Near-duplicate documents by HyperMinHash.

Each document's distinct word shingles fill registers: a hash picks the register, and the register keeps its least remaining hash
as a count of leading zeros and ten mantissa bits. There are 128 coarse registers, whose bands of four give candidate groups, and
16,384 fine ones, of which only the filled are stored. Documents with the same shingle set are one class from the start, and work
goes on between classes:

1. every member of a band's group is compared with the group's center, the member that meets most others over all of its bands
   (a star, so a group of n costs n - 1 pairs); the center goes to as many tasks as its group needs;
2. links are confirmed on the full shingle sets and contracted to components;
3. in groups that still hold several components, members outside the group's largest component are compared with all of other
   components by their registers, in blocks, with Jaccard estimates corrected for register collisions, and what the estimate
   leaves is confirmed on the full sets.

Two linked documents (similarity 0.8) share no band with probability (1 - 0.8**4)**32, about 5e-8; the estimates' margins are over
five standard deviations. Documents in one component already are not compared again, and no group is capped. Sets are told apart
by their size and 128 bits of sums of their hashes; that two unlike sets agree in all of these is taken not to happen.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a row without doc_id is linked with
nothing, has no component and is kept; repeated rows share a class; rows of one doc_id with different texts are linked; other
columns are ignored; a very long text is read in one piece, and its registers have a fixed size; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, text_or_empty, written
from .components import components
from .words import U, mixed, shingle_hashes, word_hashes

FINE_BITS, REGISTER_BITS, MANTISSA_BITS, BAND_ROWS = 14, 7, 10, 4
REGISTERS = 1 << REGISTER_BITS
EMPTY = 0xFFFF
BANDS = REGISTERS // BAND_ROWS
#: Pairs whose coarse estimate lies this far under the threshold are not confirmed; for fine estimates, this much and so many
#: shingles, since in small sets two shingles of one register weigh more.
MARGIN, FINE_MARGIN, FINE_SHINGLES = 0.2, 0.03, 2.5
#: Members of a group that are compared together; larger groups are dealt into blocks.
BLOCK = 1024
#: Classes whose keys, 16 bytes each, may be broadcast.
BROADCAST_CLASSES = 500_000

PROFILE = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, registers binary, fine binary"


def register_codes(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(filled registers, their 16-bit codes) from ascending distinct hashes. A lesser hash has a lesser code."""
    register = (shingles >> U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(register, prepend=-1))
    rest = (shingles[first] << U(bits)) >> U(11)  # the 53 bits that a double holds
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(53 - exponent, 62).astype(np.int64)
    shift = np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(U)
    mantissa = (rest >> shift) & U((1 << MANTISSA_BITS) - 1)
    return register[first], ((62 - zeros) << MANTISSA_BITS) | mantissa.astype(np.int64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The coarse registers; EMPTY is where no shingle falls."""
    filled, codes = register_codes(shingles, REGISTER_BITS)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[filled] = codes
    return out


def fine_registers(shingles: np.ndarray) -> np.ndarray:
    """The filled fine registers in order, each as its number and its code."""
    filled, codes = register_codes(shingles, FINE_BITS)
    return ((filled << 16) | codes).astype(np.uint32)


_PROBES = np.argsort(np.random.default_rng(5).random((REGISTERS, REGISTERS)), axis=1)


def filled_registers(values: np.ndarray) -> np.ndarray:
    """Empty registers borrow from the first filled one of a fixed random order of their own."""
    empty = np.flatnonzero(values == EMPTY)
    if len(empty) == 0 or len(empty) == REGISTERS:
        return values
    probes = _PROBES[empty]
    out = values.copy()
    out[empty] = values[probes[np.arange(len(empty)), np.argmax(values[probes] != EMPTY, axis=1)]]
    return out


def chance_matches(size_a: np.ndarray, size_b: np.ndarray, count: int) -> np.ndarray:
    """Chance that different shingles leave the same code in a register, of `count` registers."""
    octave = np.exp2(-np.arange(40.0))

    def least_in(size):  # chance that a register's least hash has so many leading zeros
        load = np.asarray(size, float)[..., None] / count
        return (1 - octave / 2) ** load - (1 - octave) ** load

    return (least_in(size_a) * least_in(size_b)).sum(axis=-1) / (1 << MANTISSA_BITS)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of coarse register rows, less the matches that different shingles make by chance."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    chance = chance_matches(size_a, size_b, REGISTERS)
    return (same / np.maximum(used, 1) - chance) / (1 - chance)


def fine_estimates(one: np.ndarray, others: list[np.ndarray], size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, corrected in the same way, of one document's fine registers with those of others; what they can be at most).

    A shingle that two documents share leaves the same code in both, unless a lesser one of either takes its register; that hides
    at most as many shingles as a document has more of than filled registers.
    """
    code = np.full(1 << FINE_BITS, EMPTY, np.uint16)
    code[one >> 16] = one & 0xFFFF
    laid = np.concatenate(others)
    lengths = np.fromiter(map(len, others), np.int64, len(others))
    begin = np.cumsum(lengths) - lengths
    mine = code[laid >> 16]
    same = np.add.reduceat((mine == (laid & 0xFFFF)).astype(np.int64), begin)
    both = np.add.reduceat((mine != EMPTY).astype(np.int64), begin)
    chance = chance_matches(size, sizes, 1 << FINE_BITS) * both / np.maximum(len(one) + lengths - both, 1)
    common = np.minimum(same + (size - len(one)) + (sizes - lengths), np.minimum(size, sizes))
    return (same / (len(one) + lengths - both) - chance) / (1 - chance), common / (size + sizes - common)


def profiles(documents: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, text_key, number of shingles, a 128-bit hash of the shingle set, registers."""

    def profile(batches):
        for batch in batches:
            keys, at = batch.column("text_key"), 0
            for ids, offsets, data in slices(batch.column("doc_id"), batch.column("text"), 1 << 18):
                words, first = word_hashes(offsets, data)
                counts, sums, values, fine = [], [], [], []
                for i in range(len(ids)):
                    s = shingle_hashes(words[first[i] : first[i + 1]], shingle_words)
                    counts.append(len(s))
                    sums.append((s.sum(dtype=U), mixed(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)))
                    fine.append(fine_registers(s).tobytes())
                    values.append(registers(s).tobytes())
                sums = np.asarray(sums, U).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), keys.slice(at, len(ids)), pa.array(counts, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(values, pa.binary()), pa.array(fine, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "registers", "fine"],
                )
                at += len(ids)
            pa.default_memory_pool().release_unused()  # workers are kept and reused

    return documents.mapInArrow(profile, PROFILE)


_SALT = (np.arange(BANDS, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15)


def band_keys(coarse_rows: np.ndarray) -> np.ndarray:
    """(rows, BANDS): each band's four registers and its number, as one hash."""
    full = np.vstack([filled_registers(r) for r in coarse_rows]) if len(coarse_rows) else coarse_rows
    return mixed(full.reshape(-1, BANDS, BAND_ROWS).copy().view(U)[:, :, 0] ^ _SALT)


def bands(classes: DataFrame) -> DataFrame:
    """(band, class_id): one row for each band of each class."""

    def band(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ids = np.repeat(batch.column("class_id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(rows).ravel().astype(np.int64)), pa.array(ids)], names=["band", "class_id"])

    return classes.select("class_id", "registers").mapInArrow(band, "band long, class_id long")


def centers(banded: DataFrame) -> DataFrame:
    """(band, center, size) of bands that several classes have: the center is the class that meets most others over all of its bands.

    Such a class lies in the middle of its near copies, so most of them are linked with it; with any other, fewer are, and the rest
    is compared among itself, which grows with its square.
    """
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(banded.join(shared, "band"), "shared-bands")
    met = members.groupBy("class_id").agg(F.sum("size").alias("met"))
    return members.join(met, "class_id").groupBy("band").agg(F.max(F.struct("met", "class_id"))["class_id"].alias("center"), F.first("size").alias("size"))


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold. A class's text is that of its doc_id with its text_key.

    pairs: a, b, part; a's text goes to each of its parts, so a class with many partners is not one task's.
    """
    heads = classes.select("class_id", "doc_id", "text_key")
    if 2 * pairs.count() <= BROADCAST_CLASSES:  # then only the texts of these classes are dealt out
        ends = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
        texts = texts.join(F.broadcast(heads.join(ends, "class_id").select("doc_id", "text_key")), ["doc_id", "text_key"], "left_semi")
    wanted = pairs.join(heads.withColumnRenamed("class_id", "b"), "b").hint("shuffle_hash")
    right = texts.join(wanted, ["doc_id", "text_key"]).select("a", "b", "part", F.col("text").alias("text_b"))
    starts = pairs.select(F.col("a").alias("class_id"), "part").distinct().join(heads, "class_id").withColumnRenamed("class_id", "a")
    left = texts.join(starts.hint("shuffle_hash"), ["doc_id", "text_key"]).select("a", "part", F.col("text").alias("text_a"))
    both = right.join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def sets(column):
        column = column.cast(pa.large_binary())
        for text in column:
            data = np.frombuffer(text.as_buffer(), np.uint8)
            yield shingle_hashes(word_hashes(np.asarray([0, len(data)]), data)[0], shingle_words)

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, part) whose corrected estimate is at least `least`."""
    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("registers").alias(f"registers_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def estimate(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"registers_{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab")
            near = estimated_jaccard(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
            yield batch.select(["a", "b", "part"]).filter(pa.array(near))

    lefts = pairs.select("a", "part").distinct().join(side("a"), "a")
    both = pairs.join(side("b"), "b").join(lefts, ["a", "part"])
    return both.select("a", "b", "part", "registers_a", "registers_b", "n_a", "n_b").mapInArrow(estimate, "a long, b long, part int")


def _meetings(members: DataFrame) -> DataFrame:
    """members of groups of several components, dealt to the blocks in which they meet.

    Added: block and stray_block, which name the meeting; resident, whether the member is compared there with the strays present.
    Strays are the members outside the group's largest component. Members of that are resident in one block; a stray is
    resident in one and visits all others, since any two members of different components have a stray among them.
    """
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("components"))
    groups = groups.filter("components > 1").select("band", F.col("main.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("stray_blocks"))
    rows = members.join(groups, "band").withColumn("stray", F.col("component") != F.col("main"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.col(n)).cast("int")
    rows = rows.withColumns({"own": dealt("blocks", 1), "own_stray": dealt("stray_blocks", 2)})
    lives = F.transform(F.sequence(F.lit(0), F.col("stray_blocks") - 1), lambda s: F.struct(F.col("own").alias("block"), s.alias("stray_block"), F.lit(True).alias("resident")))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), F.col("own_stray").alias("stray_block"), F.lit(False).alias("resident")))
    places = F.when(F.col("stray"), F.concat(lives, visits)).otherwise(lives)
    return rows.select("band", "class_id", "component", "stray", F.explode(places).alias("x")).select("band", "class_id", "component", "stray", "x.*")


def _across(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components within a band's group that may reach `least`. members: band, class_id, component."""
    rows = _meetings(members).join(classes.select("class_id", "n_shingles", "registers", "fine"), "class_id")

    def pairs(table: pa.Table) -> pa.Table:
        ids, comp, size = (table.column(c).to_numpy() for c in ("class_id", "component", "n_shingles"))
        stray, resident = (table.column(c).to_numpy() for c in ("stray", "resident"))
        rows = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        fine = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("fine")]
        keys = band_keys(rows)
        this = int(np.flatnonzero((keys == np.int64(table.column("band")[0].as_py()).astype(U)).all(axis=0))[0])
        a, b = [], []
        for i in np.flatnonzero(~resident):
            other = np.flatnonzero(resident & (comp != comp[i]) & (~stray | (ids > ids[i])))  # two strays meet twice
            ratio = np.minimum(size[other], size[i]) / np.maximum(size[other], size[i])
            other = other[ratio >= least]
            other = other[~(keys[other, :this] == keys[i, :this]).any(axis=1)]  # a pair belongs to the first band that it shares
            other = other[estimated_jaccard(rows[i][None, :], rows[other], size[i], size[other]) >= least - MARGIN] if len(other) else other
            if len(other):
                close = least - FINE_MARGIN - FINE_SHINGLES / np.maximum(size[other], size[i])
                estimate, most = fine_estimates(fine[i], [fine[k] for k in other], size[i], size[other])
                near = other[(estimate >= close) & (most >= least - 1e-9)]
                a.append(np.minimum(ids[near], ids[i]))
                b.append(np.maximum(ids[near], ids[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    return rows.groupBy("band", "block", "stray_block").applyInArrow(pairs, "a long, b long").distinct()


def _part(size: Column) -> Column:
    """Which of a's parts b belongs to, of as many as `size` partners need."""
    return F.pmod(F.xxhash64("b"), F.ceil(size / BLOCK)).cast("int").alias("part")


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (doc_id = component_id) for every row."""
    text = text_or_empty()
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    texts = source.filter(F.col("doc_id").isNotNull())
    full = written(profiles(texts, shingle_words), "profiles")
    key = ["set_a", "set_b", "n_shingles"]
    classes = full.filter("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "registers", "fine")).alias("x"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class_id"), *key, "x.*"), "classes")
    profile = written(full.select("doc_id", *key), "sets")
    discard(full)

    banded = written(bands(classes), "bands")
    groups = written(centers(banded), "groups")
    star = banded.join(groups, "band").filter("class_id <> center").groupBy(F.col("center").alias("a"), F.col("class_id").alias("b")).agg(F.max("size").alias("size"))
    star = star.select("a", "b", _part(F.col("size")))
    star = written(_estimated(star, classes, percent / 100 - MARGIN), "star")
    links = written(confirmed(star, classes, texts, shingle_words, percent), "links")
    found = components(links)

    members = banded.join(groups.select("band"), "band").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    members = written(members.withColumn("component", F.coalesce("component", "class_id")), "members")
    across = written(_across(members, classes, percent / 100), "across")
    across = across.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    across = written(across.join(across.groupBy("a").agg(F.count("*").alias("size")), "a").select("a", "b", _part(F.col("size"))), "across")
    more = written(confirmed(across, classes, texts, shingle_words, percent), "more-links")
    unlike = profile.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x <> y").select("doc_id")
    unlike = written(unlike, "unlike")
    own = profile.join(unlike, "doc_id").join(classes.select(*key, "class_id"), key).select("doc_id", "class_id")
    ties = own.join(own.groupBy("doc_id").agg(F.min("class_id").alias("a")), "doc_id").select("a", F.col("class_id").alias("b")).filter("a < b").distinct()
    found = components(links.union(more).union(ties))

    by_class = classes.select(*key, "class_id", "doc_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    by_class = written(by_class.select(*key, "doc_id", F.coalesce("component", "class_id").alias("component")), "by-class")
    # written, so that the join below stands right above its exchanges and a large component can be split
    least = written(by_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    by_class = by_class.join(least, "component").select(*key, "component_id")
    known = profile.select("doc_id", *key).join(by_class, key, "left").select("doc_id", "n_shingles", "component_id")
    if unlike.limit(1).count():  # a blank row of such a document goes with its other rows
        shared = known.join(unlike, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("shared"))
        known = known.join(shared, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "shared").alias("component_id"))
    known = known.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = source.filter(F.col("doc_id").isNull())
    nameless = profiles(nameless, shingle_words).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
