"""Quotation linking: reply-ordered conversations without quotes, in DataFrame functions only.

1. Lines are parsed into quote levels (the number of leading `>` marks). Lines of level 0 are a message's own content; runs of
   lines of one level are quoted passages. A line that only announces a quote ("... wrote:") belongs to it.
2. Each passage, and each of its lines and sentences of three words or more, is normalised (lower case, letters and digits) and
   hashed. The same is done with the own content, lines and sentences of the messages of conversations that hold quotes; of equal
   passages in a conversation the first message is the original. Both sides are unique before they are joined, so a passage
   that many messages share makes one row for each quote. A passage without an equal before it (trimmed, or wrapped anew) links
   to the first message whose own content has its words in a row: windows of up to three words give the candidates, those of the
   passage's rarest window, and each is confirmed by containment of the whole passage.
3. A message replies to the original that most of its shallowest linked passages come from (the later one on a tie). Originals
   lie before the reply, so replies form trees. Messages are ordered by tree: each after what it replies to, replies to one message
   by turn. Walks around the trees are ranked by pointer doubling, which gives every message its place, depth and root in as many
   rounds as the longest walk has binary digits, with two short rows for each linked message and nothing longer.

Neighbours and places are counted within chunks of turns, so neither a long conversation nor a message with many replies is one
task's.

Defined cases: a null or empty text is empty content without quotes; a message with a null conv_id or turn is linked with nothing
and has no position; messages with equal (conv_id, turn) share links and stand next to each other; other columns are ignored; an
empty table gives no rows; a very long message is parsed within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written

MARKS = "^[ \\t]*(?:>[ \\t]?)+"
#: How lines that announce a quote end.
ANNOUNCES = "(?i)(?:wrote|writes|schrieb|écrit|escribió)[^\\p{L}\\p{N}]*:[ \\t\\r]*$"
SENTENCE_ENDS = "…|\\.{2,}|[.!?。！？]+(?=[^\\p{L}\\p{N}]|$)"
#: Quoted lines and sentences of fewer words are not linked on their own, only as a whole passage.
LEAST_WORDS = 3
#: Words of the windows by which candidates are found for passages without an equal.
WINDOW_WORDS = 3
#: Turns that share a chunk of an order.
CHUNK = 1024
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (own text), has_quotes, lines: array of (level, text) without marks."""
    text = text_or_empty()
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        text.alias("text"), text.rlike("(?m)^[ \\t]*>").alias("has_quotes"),
    )
    rows = rows.withColumn("lines", F.when(F.col("has_quotes"), F.transform(F.split("text", "\n"), line)))
    following = lambda i: F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ANNOUNCES) & (following(i) > 0)))
    stripped = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), "^\\s+|\\s+$", "")
    return rows.withColumn("content", F.when(F.col("has_quotes"), stripped).otherwise(F.col("text")))


def _units(text: Column, lines: Column, least: int) -> Column:
    """A normalised passage and those of its lines and sentences that have enough words, each once; none for a passage without words."""
    parts = F.transform(F.concat(lines, F.split(text, SENTENCE_ENDS)), normalised)
    parts = F.filter(parts, lambda x: F.size(F.split(x, " ")) >= least)
    return F.array_distinct(F.filter(F.concat(F.array(normalised(text)), parts), lambda x: x != ""))


def quoted_units(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, unit): the normalised passages that each message quotes, and their hashes."""
    quoting = rows.filter("has_quotes and conv_id is not null and turn is not null")
    level = lambda i: F.coalesce(F.get(F.col("lines"), i)["level"], F.lit(-1))
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (level(i) > 0) & (level(i) != level(i - 1)))
    runs = quoting.select("conv_id", "turn", "lines", begins.alias("begins"), F.filter(F.sequence(F.lit(0), F.size("lines")), lambda i: level(i) != level(i - 1)).alias("edges"))
    runs = runs.select("conv_id", "turn", "lines", "edges", F.explode("begins").alias("begin"))
    end = F.element_at("edges", (F.array_position("edges", F.col("begin")) + 1).cast("int"))
    passage = runs.select("conv_id", "turn", F.get(F.col("lines"), F.col("begin"))["level"].alias("level"), F.transform(F.slice("lines", F.col("begin") + 1, end - F.col("begin")), lambda x: x["text"]).alias("texts"))
    units = passage.select("conv_id", "turn", "level", F.explode(_units(F.array_join("texts", " "), F.col("texts"), LEAST_WORDS)).alias("passage"))
    return units.distinct().withColumn("unit", F.xxhash64("passage"))


def _windows(words: Column, size: int) -> Column:
    """Hashes of the windows of `size` words, each once; none where there are fewer."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.when(F.size(words) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def containing(passages: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, unit, within): the least turn of a message of the conversation whose text has the passage's words in a row.

    passages: conv_id, unit, passage, each once; messages: conv_id, turn, text, normalised.
    """
    n = F.size("words")
    wanted = passages.withColumn("words", F.split("passage", " ")).withColumn("short", n <= WINDOW_WORDS)
    own = F.coalesce(*[F.when(n == k, _windows(F.col("words"), k)) for k in range(1, WINDOW_WORDS)], _windows(F.col("words"), WINDOW_WORDS))
    wanted = written(wanted.select("conv_id", "unit", "short", F.explode(own).alias("window")), "windows")
    texts = messages.groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    texts = written(texts.withColumn("message", F.monotonically_increasing_id()), "texts")
    every = F.concat(*[_windows(F.col("words"), k) for k in range(1, WINDOW_WORDS + 1)])
    index = texts.withColumn("words", F.split("text", " ")).select("conv_id", "turn", "message", F.explode(every).alias("window"))
    index = written(index.join(wanted.select("conv_id", "window").distinct(), ["conv_id", "window"], "left_semi"), "index")
    counts = index.groupBy("conv_id", "window").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    rarest = wanted.join(counts, ["conv_id", "window"], "left").groupBy("conv_id", "unit", "short").agg(
        F.bool_and(F.col("n").isNotNull()).alias("all_known"), F.min(F.struct("n", "window", "first")).alias("x"))
    rarest = written(rarest.filter("all_known").select("conv_id", "unit", "short", "x.window", "x.first"), "rarest")
    candidates = rarest.filter("not short").join(index.select("conv_id", "window", "message", "turn"), ["conv_id", "window"]).select("conv_id", "unit", "message", "turn")
    both = candidates.join(passages.select("conv_id", "unit", "passage"), ["conv_id", "unit"]).join(texts.select("message", "text"), "message")
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    long = both.filter(F.contains(spaced("text"), spaced("passage"))).groupBy("conv_id", "unit").agg(F.min("turn").alias("within"))
    return rarest.filter("short").select("conv_id", "unit", F.col("first").alias("within")).union(long)


def links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents: conv_id, turn, parent_turn; counts: conv_id, turn, n_quoted, n_linked) of messages with quotes."""
    quoted = written(quoted_units(rows), "quoted")
    talks = quoted.select("conv_id").distinct()
    originals = rows.filter("turn is not null").join(talks, "conv_id", "left_semi")
    units = originals.select("conv_id", "turn", F.explode(_units(F.regexp_replace("content", "\n", " "), F.split("content", "\n"), 1)).alias("passage"))
    first = units.groupBy("conv_id", F.xxhash64("passage").alias("unit")).agg(F.min("turn").alias("original"))
    linked = quoted.join(first, ["conv_id", "unit"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    linked = written(linked, "linked")
    missing = linked.filter("original is null").select("conv_id", "unit", "passage").distinct()
    if missing.limit(1).count():
        missing = written(missing, "missing")
        texts = originals.join(missing.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", normalised(F.col("content")).alias("text"))
        within = containing(missing, texts.filter("text <> ''"))
        linked = linked.join(within, ["conv_id", "unit"], "left")
        linked = linked.withColumn("original", F.coalesce("original", F.when(F.col("within") < F.col("turn"), F.col("within"))))
    counts = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"))
    votes = linked.filter("original is not null").groupBy("conv_id", "turn", "level", "original").agg(F.count("*").alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "original")).alias("x")).select("conv_id", "turn", F.col("x.original").alias("parent_turn"))
    return parents, counts


def _chunk(turn: Column) -> Column:
    return F.floor(turn / CHUNK).alias("chunk")


def tours(parents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Steps of the walks around the reply trees: conv_id, turn, leaving, next_turn, next_leaving, n, balance.

    A walk enters a message, walks around its replies by turn, and leaves it. n: rows of the message, where it is entered;
    balance: 1 where it is entered, else -1. The last step, leaving the root, has no next one. parents: conv_id, turn,
    parent_turn; sizes: conv_id, turn, n.
    """
    family = ["conv_id", "parent_turn"]
    kids = parents.withColumn("chunk", _chunk(F.col("turn")))
    kids = kids.withColumn("sibling", F.lead("turn").over(Window.partitionBy(*family, "chunk").orderBy("turn")))
    heads = kids.groupBy(*family, "chunk").agg(F.min("turn").alias("head"))
    heads = heads.select(*family, "chunk", F.lead("head").over(Window.partitionBy(*family).orderBy("chunk")).alias("following"))
    kids = kids.join(heads, [*family, "chunk"]).select("conv_id", "turn", "parent_turn", F.coalesce("sibling", "following").alias("sibling"))
    firsts = parents.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min(parents["turn"]).alias("first"))
    none = F.lit(None).cast("long")
    roots = firsts.select("conv_id", "turn").join(parents.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", "turn", none.alias("parent_turn"), none.alias("sibling"))
    nodes = kids.union(roots).join(firsts, ["conv_id", "turn"], "left").join(sizes, ["conv_id", "turn"], "left")
    step = lambda leaving, turn, up, n: F.struct(F.lit(leaving).alias("leaving"), turn.alias("next_turn"), F.when(turn.isNotNull(), up).alias("next_leaving"), n.alias("n"), F.lit(-1 if leaving else 1).cast("long").alias("balance"))
    enter = step(False, F.coalesce("first", "turn"), F.col("first").isNull(), F.coalesce("n", F.lit(1).cast("long")))
    leave = step(True, F.coalesce("sibling", "parent_turn"), F.col("sibling").isNull(), F.lit(0).cast("long"))
    return nodes.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("s")).select("conv_id", "turn", "s.*")


def trees(parents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, turn, root, inner, depth) of the messages in reply trees; inner: rows of the tree before the message."""
    now = written(tours(parents, sizes).withColumn("root", F.when(F.col("next_turn").isNull(), F.col("turn"))), "tours")
    while now.filter("next_turn is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("turn").alias("next_turn"), F.col("leaving").alias("next_leaving"), F.col("next_turn").alias("far_turn"), F.col("next_leaving").alias("far_leaving"), F.col("n").alias("more"), F.col("balance").alias("further"), F.col("root").alias("its_root"))
        both = now.join(ahead, ["conv_id", "next_turn", "next_leaving"], "left")
        following = written(both.select(
            "conv_id", "turn", "leaving", F.col("far_turn").alias("next_turn"), F.col("far_leaving").alias("next_leaving"),
            (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("balance") + F.coalesce("further", F.lit(0))).alias("balance"), F.coalesce("root", "its_root").alias("root"),
        ), "tours")
        discard(now)
        now = following
    entered = now.filter(~F.col("leaving"))  # n and balance now tell what lies ahead
    whole = entered.filter("turn = root").select("conv_id", "root", F.col("n").alias("all"))
    return entered.join(whole, ["conv_id", "root"]).select("conv_id", "turn", "root", (F.col("all") - F.col("n")).alias("inner"), (-F.col("balance")).cast("int").alias("depth"))


def placed(parents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, turn, first, depth): the place of each message's first row in its conversation. sizes: conv_id, turn, n, all messages."""
    known = written(trees(parents, sizes), "trees")
    rows = sizes.join(_small(known), ["conv_id", "turn"], "left").select("conv_id", "turn", "n", F.coalesce("root", "turn").alias("root"), F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("depth", F.lit(0)).alias("depth"))
    heads = rows.groupBy("conv_id", "root").agg(F.sum("n").alias("n")).withColumn("chunk", _chunk(F.col("root")))
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = heads.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"))
    chunks = chunks.select("conv_id", "chunk", earlier(Window.partitionBy("conv_id").orderBy("chunk")).alias("before"))
    starts = heads.withColumn("within", earlier(Window.partitionBy("conv_id", "chunk").orderBy("root"))).join(chunks, ["conv_id", "chunk"])
    starts = starts.select("conv_id", "root", (F.col("before") + F.col("within")).alias("start"))
    return rows.join(starts, ["conv_id", "root"]).select("conv_id", "turn", (F.col("start") + F.col("inner")).alias("first"), "depth")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


def threads(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, content, parent_turn, depth, n_quoted, n_linked, position (in reply order, from 0)."""
    rows = parsed(messages)
    parents, counts = links(rows)
    parents, counts = written(parents, "parents"), written(counts, "counts")
    keyed = rows.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "content")
    sizes = written(keyed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")), "sizes")
    found = counts.join(parents, ["conv_id", "turn"], "left")
    places = placed(parents, sizes).join(_small(found), ["conv_id", "turn"], "left")
    again = Window.partitionBy("conv_id", "turn").orderBy("role", "content")
    numbered = keyed.join(places, ["conv_id", "turn"]).withColumn("position", F.col("first") + F.row_number().over(again) - 1)
    nameless = rows.filter("conv_id is null or turn is null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = numbered.select("conv_id", "turn", "role", "content", "parent_turn", "depth", zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"), F.col("position").cast("long").alias("position"))
    return named.union(nameless.select("conv_id", "turn", "role", "content", F.lit(None).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")))


def chat_texts(messages: DataFrame, opening: str = "<|", closing: str = "|>") -> DataFrame:
    """(conv_id, text): each conversation in reply order, every message after a mark with its role. For conversations that fit a row."""
    mark = F.concat(F.lit(opening), F.coalesce("role", F.lit("user")), F.lit(closing), F.lit("\n"), "content")
    rows = threads(messages).filter("position is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", mark.alias("text")))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"))
