"""Scores and parsers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
WEIGHTS = {"rouge1": 0.37, "rougeL": 0.37, "judge": 0.26}
JUDGE_KEYS = ("accuracy", "completeness", "language")
JUDGE_DEFAULT = 3.0
BATCH_TIERS = ((70, 24), (55, 16), (40, 12), (28, 8), (18, 4), (10, 2))
MODEL_SIZES = (("xxl", 13.0), ("xl", 3.7), ("large", 1.2), ("base", 0.58), ("small", 0.30))
USUAL_SIZE, TIERED_SIZE = 1.2, 3.7


def missing_to_null(c: Column) -> Column:
    """Spark orders NaN above every number; a missing score is null here."""
    return F.when(~F.isnan(c), c)


def below(c: Column, limit) -> Column:
    """A drop rule: false where the score is missing."""
    return F.coalesce(missing_to_null(c) < limit, F.lit(False))


def at_least(c: Column, limit) -> Column:
    """A keep rule: false where the score is missing."""
    return F.coalesce(missing_to_null(c) >= limit, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def composite(rouge1: Column, rouge_l: Column, judge: Column) -> Column:
    part = F.least(F.greatest((judge - 1.0) / 4.0, F.lit(0.0)), F.lit(1.0))
    return F.bround(WEIGHTS["rouge1"] * rouge1 + WEIGHTS["rougeL"] * rouge_l + WEIGHTS["judge"] * part, 5)


def judge_score(reply: Column) -> Column:
    """`overall` of the first braces if these hold JSON, else the mean of three keys; without JSON the first decimal from 1 to 5, else the first digit, else 3."""
    braces = F.nullif(F.regexp_extract(reply, "(?s)\\{[^}]+\\}", 0), F.lit(""))
    parsed = F.try_parse_json(braces)
    field = lambda key: F.try_variant_get(parsed, f"$.{key}", "double")
    mean = sum((F.coalesce(field(k), F.lit(JUDGE_DEFAULT)) for k in JUDGE_KEYS), F.lit(0.0)) / len(JUDGE_KEYS)
    numbers = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit("\\b([1-5](?:\\.\\d+)?)\\b"), F.lit(1))
    decimals = F.filter(numbers, lambda x: F.instr(x, ".") > 0)
    loose = F.coalesce(F.get(decimals, F.lit(0)), F.get(numbers, F.lit(0))).cast("double")
    return F.coalesce(F.when(parsed.isNotNull(), F.coalesce(field("overall"), mean)), loose, F.lit(JUDGE_DEFAULT))


def mean_confidence(probabilities: Column, default: float = 0.85) -> Column:
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(total, F.size(probabilities)), F.lit(default))


def tempered(counts: Column, temperature: float, over) -> Column:
    """Shares in proportion to counts ** (1 / temperature)."""
    weight = F.pow(counts.cast("double"), F.lit(1.0 / temperature))
    return weight / F.sum(weight).over(over)


def model_size(name: Column) -> Column:
    """Parameters of a model in billions, by what its name contains."""
    return F.coalesce(*[F.when(F.lower(name).contains(part), F.lit(size)) for part, size in MODEL_SIZES], F.lit(USUAL_SIZE))


def batch_size(free_gb: Column, size: Column) -> Column:
    """The batch to start with on so much free memory, less for models larger than that the tiers were found on."""
    tier = F.coalesce(*[F.when(free_gb >= least, F.lit(batch)) for least, batch in BATCH_TIERS], F.lit(1))
    return F.greatest(F.floor(tier / F.greatest(size / TIERED_SIZE, F.lit(1.0))), F.lit(1)).cast("int")
