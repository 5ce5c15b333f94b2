"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once and keeps its measurements and one failure bit for each rule. `apply_policy` keeps documents
of which no bit of a versioned policy is set, and `ablations` tells what each rule of a policy removes alone or last, by bitwise
operations on the ledger's counts.

Defined cases: a null or empty text has no words and fails `too_short`; a null doc_id stays null; repeated rows each give a row;
other columns are ignored, whatever their names; a very long text is measured within its row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"

#: Rule by bit: name, then the test that fails a document, over the ledger's measurements.
RULES = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: The rules that the contract fixes.
BASE_MASK = BIT["too_short"] | BIT["repeated_windows"]
#: Versioned policies: the bits that reject a document.
POLICIES = {
    1: BASE_MASK,
    2: BASE_MASK | BIT["symbols"] | BIT["repeated_lines"],
    3: BASE_MASK | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["shouting"],
}
CURRENT_POLICY = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def _packed_windows(hashes: Column, n: Column, bits: Column) -> Column:
    """Each three-word window as one long, in order: its hash in the upper bits, its position in the lower."""
    window = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.call_function("shiftright", window(i), bits), bits) + i)
    return F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def measured(documents: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id and the measurements that the rules read; `carried` goes along as the column `carried`."""
    text = text_or_empty()
    carried = F.lit(None).cast("int") if carried is None else carried
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    base = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        carried.alias("carried"),
    )
    counted = base.select(
        "doc_id", "n_symbols", "n_upper", "carried",
        F.size("words").alias("n"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).withColumn("bits", F.length(F.bin(F.col("n").cast("long"))))
    # the row number keeps the optimizer from pushing a filter on the results below this column, which would repeat it inside each lambda
    windows = F.when(F.monotonically_increasing_id() >= 0, _packed_windows(F.col("hashes"), F.col("n"), F.col("bits")))
    sorted_windows = counted.withColumn("windows", windows)

    def same(x: Column, y: Column) -> Column:
        """Equal windows: equal upper bits, then equal words."""
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
        i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        equal = F.call_function("shiftright", x, F.col("bits")) == F.call_function("shiftright", y, F.col("bits"))
        for k in range(3):
            equal = equal & (F.get(F.col("hashes"), i + k) == F.get(F.col("hashes"), j + k))
        return F.coalesce(equal, F.lit(False))

    repeated = F.filter("windows", lambda x, i: same(x, F.get(F.col("windows"), i + 1)) | same(x, F.get(F.col("windows"), i - 1)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    found = sorted_windows.withColumn("repeated", repeated)
    at = found.withColumn("at", F.sort_array(F.transform("repeated", lambda x: x.bitwiseAND(mask))))
    # a word belongs to the last repeated window that starts before it: gaps beyond three words are not covered
    spans = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)
    return at.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_upper", "carried")


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements and `fail_bits`: bit i is set where rule i fails."""
    return _with_bits(measured(documents)).drop("carried")


def kept_documents(documents: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The rows of documents, in all their columns, that a policy keeps. Measured and filtered in one pass, without a join."""
    rows = _with_bits(measured(documents, F.struct(*[F.col(f"`{c}`") for c in documents.columns])))
    return apply_policy(rows, version).filter("kept").select("carried.*")


def _with_bits(rows: DataFrame) -> DataFrame:
    bits = F.lit(0)
    for i, (_, test) in enumerate(RULES):
        bits = bits + F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0))
    return rows.withColumn("fail_bits", bits.cast("int"))


def apply_policy(ledger_rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with base_failed and the verdict of a policy."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return ledger_rows.withColumn("base_failed", failed(BASE_MASK)).withColumn("kept", ~failed(BASE_MASK | POLICIES[version]))


def ablations(ledger_rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    The ledger is first summed by bit pattern (at most 2 to the number of rules), so the corpus is read once.
    """
    policy = POLICIES[version]
    patterns = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name, _ in RULES if BIT[name] & policy])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "bit").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
