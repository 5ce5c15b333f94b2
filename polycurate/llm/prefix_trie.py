"""A trie of conversations: which beginnings they share, and what computing each shared beginning once would save.

1. A turn becomes the SHA-256 of its role and text, its length and its place; texts go no further. Places come from one order over
   all turns, dealt by ranges, so a conversation of any length spans several tasks.
2. Every beginning gets a polynomial rolling fingerprint, the sum of turn * BASE ** depth modulo 2 ** 62, by numpy scans over
   chunks of turns; the sums of earlier chunks are scanned in the same way and added.
3. (depth, fingerprint) groups the conversations. Each group is verified turn by turn: all members must have the digest and the
   parent of the representative, the least conv_id, told by minima and maxima that are combined before rows move. Members that
   differ get another mark from that depth on, and the groups are formed anew until none is mixed.
4. Conversations are the paths of the trie: one is the representative of a beginning and of everything deeper until its end, so
   the nodes of one conv_id are a path down. A node's sums over its subtree are those of its own path from there on, and of the
   whole paths of the other members that begin below it. Both are plain sums, whatever the trie's depth.

Defined cases: turns are ordered by turn, null first, ties by digest; a null role or text is empty; rows without conv_id are left
out; repeated rows are turns of their own; a conversation without turns counts at the root; very long texts are only hashed; other
columns are ignored, whatever their names; an empty table gives no rows, and so no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import group_ranks
from .common import discard, written

U = np.uint64
BITS = 62
#: Fixed value: an odd multiplier.
BASE = 0x9E3779B97F4A7C15
#: Turns of a conversation that are scanned together, and conv_ids whose list is one string.
CHUNK, BLOCK = 4096, 4096
#: The query's conversations begin as the first of five does, for up to eight turns.
FAMILY, MOST_SHARED = 5, 8
PARTS = ("d1", "d2", "d3", "d4")
KEY = ("depth", "fp", "mark")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, n_bytes of every turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return group_ranks(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "place").select("conv_id", "place", "digest", "n_bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each took the first turns of the first conversation of its family for its own first turns.

    How many is told by a checksum of conv_id. The second frame has one row for each conversation, even one left without turns.
    """
    conv = F.col("conv_id")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    talks = sizes.select("conv_id", (conv - conv % FAMILY).alias("first"), (F.crc32(conv.cast("string")) % (MOST_SHARED + 1)).alias("shared"))
    firsts = sizes.select(conv.alias("first"), "n")
    talks = written(talks.join(firsts, "first", "left").select("conv_id", "first", "shared", F.least("shared", F.coalesce("n", F.lit(0))).alias("taken")), "talks")
    heads = placed.filter(F.col("place") <= MOST_SHARED).withColumnRenamed("conv_id", "first").join(talks, "first").filter("place <= shared")
    tails = placed.join(talks.select("conv_id", "shared", "taken"), "conv_id").filter("place > shared")
    columns = ["conv_id", "place", "digest", "n_bytes"]
    return heads.select(*columns).union(tails.withColumn("place", F.col("place") - F.col("shared") + F.col("taken")).select(*columns)), talks.select("conv_id")


def _running(segment: tuple[np.ndarray, ...], terms: np.ndarray, last: tuple | None, carried: np.uint64) -> tuple[np.ndarray, tuple, np.uint64]:
    """Sums of terms so far within each run of equal segment values; the first run may go on from the last batch."""
    n = len(terms)
    fresh = np.ones(n, bool)
    fresh[1:] = np.any([s[1:] != s[:-1] for s in segment], axis=0)
    fresh[0] = last != tuple(s[0] for s in segment)
    total = np.cumsum(terms, dtype=U)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
    before = np.where(begin > 0, total[begin - 1], U(0)) - np.where(begin < 0, carried, U(0))
    sums = total - before
    return sums, tuple(s[-1] for s in segment), sums[-1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints within chunks: fp with the turn, up without it."""
    low = U((1 << BITS) - 1)
    powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(CHUNK - 1, BASE, U)]), dtype=U)
    last, carried = None, U(0)
    for batch in batches:
        if not len(batch):
            continue
        conv, chunk, depth = (np.asarray(batch.column(c)) for c in ("conv_id", "chunk", "depth"))
        digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">i8").reshape(-1, 4).astype(np.int64)
        far = {int(c): U(pow(BASE, int(c) * CHUNK, 1 << 64)) for c in np.unique(chunk)}
        terms = np.ascontiguousarray(digest[:, 0]).view(U)
        terms = terms * powers[depth - 1 - chunk * CHUNK] * np.array([far[int(c)] for c in chunk], U)
        sums, last, carried = _running((conv, chunk), terms, last, carried)
        out = [batch.column("conv_id"), batch.column("chunk"), batch.column("depth"), *[pa.array(x & low).cast(pa.int64()) for x in (sums, sums - terms)]]
        yield pa.RecordBatch.from_arrays([*out, *[pa.array(np.ascontiguousarray(digest[:, i])) for i in range(4)], batch.column("n_bytes")], names=["conv_id", "chunk", "depth", "fp", "up", *PARTS, "n_bytes"])


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the chunks before each chunk of a conversation."""
    low = U((1 << BITS) - 1)
    last, carried = None, U(0)
    for batch in batches:
        if not len(batch):
            continue
        sums = np.asarray(batch.column("total")).view(U)
        so_far, last, carried = _running((np.asarray(batch.column("conv_id")),), sums, last, carried)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array((so_far - sums) & low).cast(pa.int64())], names=["conv_id", "chunk", "offset"])


def members(rows: DataFrame, conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each conversation and depth: conv_id, depth, fp, mark, up, up_mark, digest parts, n_bytes; depth 0 for all."""
    mask = F.lit((1 << bits) - 1)
    chunked = rows.select("conv_id", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"), F.col("place").alias("depth"), "digest", "n_bytes")
    kinds = "conv_id long, chunk long, depth long, fp long, up long, " + ", ".join(f"{p} long" for p in PARTS) + ", n_bytes long"
    scanned = written(chunked.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "depth").mapInArrow(_scan, kinds), "scanned")
    if scanned.filter("chunk > 0").limit(1).count():
        totals = scanned.groupBy("conv_id", "chunk").agg(F.max_by("fp", "depth").alias("total"))
        long = totals.join(totals.filter("chunk > 0").select("conv_id").distinct(), "conv_id", "left_semi")
        offsets = long.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_earlier, "conv_id long, chunk long, offset long")
        moved = lambda c: (F.col(c) + F.coalesce("offset", F.lit(0))).alias(c)
        scanned = scanned.join(offsets, ["conv_id", "chunk"], "left").select("conv_id", "depth", moved("fp"), moved("up"), *PARTS, "n_bytes")
    zero = F.lit(0).cast("long")
    found = scanned.select("conv_id", "depth", F.col("fp").bitwiseAND(mask).alias("fp"), zero.alias("mark"), F.col("up").bitwiseAND(mask).alias("up"), zero.alias("up_mark"), *PARTS, "n_bytes")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("fp"), zero.alias("mark"), zero.alias("up"), zero.alias("up_mark"), *[zero.alias(p) for p in PARTS], zero.alias("n_bytes"))
    return found.union(roots)


def _groups(rows: DataFrame) -> DataFrame:
    """The nodes, and whether a node's members differ in their last turn or parent."""
    told = ["up", "up_mark", *PARTS]
    groups = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
        *[F.min(c).alias(c) for c in told], *[F.max(c).alias(f"{c}_most") for c in told],
    )
    mixed = F.lit(False)
    for c in told:
        mixed = mixed | (F.col(c) != F.col(f"{c}_most"))
    return groups.select(*KEY, "n_convs", "conv_id", "n_bytes", "up", "up_mark", mixed.alias("mixed"))


def _split(rows: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """rows with another mark, from the first depth on at which a conversation differs from its group's representative."""
    told = ["up", "up_mark", *PARTS]
    heads = rows.join(nodes.filter("mixed").select(*KEY, "conv_id"), [*KEY, "conv_id"]).select(*KEY, *[F.col(c).alias(f"{c}_head") for c in told])
    differs = F.lit(False)
    for c in told:
        differs = differs | (F.col(c) != F.col(f"{c}_head"))
    event = F.xxhash64(F.lit(turn), "depth", *told)
    first = rows.join(heads, list(KEY)).filter(differs).groupBy("conv_id").agg(F.min(F.struct(F.col("depth").alias("since"), event.alias("event"))).alias("e")).select("conv_id", "e.*")
    marked = lambda c, depth: F.when(depth >= F.col("since"), F.col(c).bitwiseXOR(F.col("event"))).otherwise(F.col(c))
    return rows.join(first, "conv_id", "left").withColumns({"mark": marked("mark", F.col("depth")), "up_mark": marked("up_mark", F.col("depth") - 1)}).drop("since", "event")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, nodes), both written, once every group has been found equal to its representative."""
    rows, turn = written(rows, "members"), 0
    while True:
        nodes = written(_groups(rows), "nodes")
        if not nodes.filter("mixed").limit(1).count():
            return rows, nodes
        turn += 1
        again = written(_split(rows, nodes, turn), "members")
        discard(rows, nodes)
        rows = again


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined strings, which arrive in order; only the hash's state goes from batch to batch."""
    key, state, made = None, None, []

    def taken() -> pa.RecordBatch:
        out = [pa.array([x[i] for x in made], pa.int64()) for i in range(len(KEY))] + [pa.array([x[-1] for x in made], pa.string())]
        made.clear()
        return pa.RecordBatch.from_arrays(out, names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *this, ids in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("ids").to_pylist(), strict=True):
            if this == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                made.append((*key, state.hexdigest()))
            key, state = this, hashlib.sha256(ids.encode())
        yield taken()
    if key is not None:
        made.append((*key, state.hexdigest()))
        yield taken()


def _ends(rows: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the nodes at which conversations end. Lists are made by blocks of conv_ids; only their hash reads them in a row."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "fp", "mark")).alias("x")).select("conv_id", "x.*")
    blocks = last.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    kinds = ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string"
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(_hash_lists, kinds)


def _below(nodes: DataFrame) -> DataFrame:
    """nodes with `own_saved` and `own_leaves`: sums over the node's path from it downwards."""
    rows = nodes.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    down = Window.partitionBy("conv_id", "chunk").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({"own_saved": F.sum("saves").over(down), "own_leaves": F.sum("leaf").over(down)})
    if rows.filter("chunk > 0").limit(1).count():
        deeper = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk
        chunks = rows.groupBy("conv_id", "chunk").agg(F.sum("saves").alias("s"), F.sum("leaf").alias("l"))
        chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("l"))
        sums = sums.join(chunks, ["conv_id", "chunk"]).withColumns({"own_saved": F.col("own_saved") + F.col("s"), "own_leaves": F.col("own_leaves") + F.col("l")}).drop("s", "l")
    return sums.drop("chunk")


def trie(rows: DataFrame, conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, place, digest, n_bytes; conversations: conv_id, each once. bits: of fingerprints; fewer only cost more rounds.
    """
    rows, nodes = verified(members(rows, conversations, bits))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up").alias("fp"), F.col("up_mark").alias("mark")]
    below = nodes.filter("depth > 0")
    children = below.select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, list(KEY), "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "saves": (F.col("n_convs") - 1) * F.col("n_bytes"), "leaf": F.col("n_children").isNull().cast("long"),
    })
    known = written(known, "known")
    paths = known.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saves").alias("path_saved"), F.sum("leaf").alias("path_leaves"))
    others = rows.select("conv_id", *KEY).join(paths, "conv_id").filter("depth < top").groupBy(*KEY).agg(F.sum("path_saved").alias("path_saved"), F.sum("path_leaves").alias("path_leaves"))
    parents = known.select(*up, *[F.col(k).alias(f"own_{k}") for k in KEY]).filter("depth >= 0").join(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), list(KEY))
    parents = parents.select(*[F.col(f"own_{k}").alias(k) for k in KEY], "parent_conv_id")
    key = list(KEY)
    whole = _below(known).join(others, key, "left").join(parents, key, "left").join(_ends(rows), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("own_leaves") + zero("path_leaves")).alias("n_leaves"),
        (F.col("own_saved") + zero("path_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, prepared: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, bits: int = BITS) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text). `prepared` may change the turns first, as `rebuilt` does."""
    placed = written(turns(conversations), "turns")
    rows, talks = prepared(placed) if prepared else (placed, placed.select("conv_id").distinct())
    return trie(rows, talks, bits)
