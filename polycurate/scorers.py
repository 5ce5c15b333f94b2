"""The boundary to models. A scorer adds one column; no model is shipped or stood in for here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from .functions import text as T

# The codes that a detector may give for a tag's language, for the two detectors; how they are asked.
ACCEPTED_CODES = {
    "Eng_Uga": ("en",),
    "Eng_Gha": ("en",),
    "Eng_Eth": ("en",),
    "Eng_Ken": ("en",),
    "Aka_Gha": ("tw", "ak"),
    "Lug_Uga": ("lg",),
    "Swa_Ken": ("sw",),
    "Amh_Eth": ("am",),
}
GATE_CODES = {
    "Aka_Gha": ("tw", "ak"),
    "Amh_Eth": ("am",),
    "Lug_Uga": ("lg",),
    "Swa_Eas": ("sw",),
    "Eng": ("en",),
}
LEAST_DETECTED_CHARS, DETECTED_PREFIX = 5, 200
UNDETERMINED = "und"
LEAST_CONFIDENCE, TOXIC = 0.5, 0.5


class Scorer(Protocol):
    def score(self, df: DataFrame, inputs: list[str], output: str) -> DataFrame: ...


class ColumnScorer:
    """Scores that exist already: a column of df, or of a table joined by key."""

    def __init__(self, column: str, table: DataFrame | None = None, key: str | None = None):
        self.column, self.table, self.key = column, table, key

    def score(self, df: DataFrame, inputs: list[str], output: str) -> DataFrame:
        if self.table is None:
            return df.withColumn(output, F.col(self.column))
        return df.join(self.table.select(self.key, F.col(self.column).alias(output)), self.key, "left")


class ArrowScorer:
    """A model that each Python worker loads once; filter rows before scoring.

    A batch that does not fit in memory is halved until it does; a single row that does not fit gives on_error. With `keep`, a
    batch that fails in any other way gives the values of that column instead. With `group`, rows of one group go to the model
    together, which gets the group's value first. With `where`, only rows with that column true are scored; the others give
    the values of `keep`.
    """

    def __init__(self, load: Callable[[], Callable[..., pd.Series]], kind: DataType, batch: int = 256, on_error=None, keep: str | None = None, group: str | None = None, where: str | None = None):
        if where is not None and keep is None:
            raise ValueError("`where` needs `keep`, the column that the other rows take their values from")
        self.load, self.kind, self.batch, self.on_error, self.keep, self.group, self.where = load, kind, batch, on_error, keep, group, where

    def score(self, df: DataFrame, inputs: list[str], output: str) -> DataFrame:
        load, size, on_error, keep, group, where = self.load, self.batch, self.on_error, self.keep, self.group, self.where

        def run(model, part: pd.DataFrame, first: tuple) -> list:
            try:
                return list(model(*first, *[part[c] for c in inputs]))
            except MemoryError:
                if len(part) == 1:
                    return [on_error]
                half = len(part) // 2
                return run(model, part.iloc[:half], first) + run(model, part.iloc[half:], first)
            except Exception:
                if keep is None:
                    raise
                return part[keep].tolist()

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for frame in batches:
                frame = frame.reset_index(drop=True)
                values = frame[keep].astype(object).copy() if where is not None else pd.Series([None] * len(frame), dtype=object)
                chosen = frame[frame[where].fillna(False).astype(bool)] if where is not None else frame
                for value, rows in [((), chosen)] if group is None else [((v,), g) for v, g in chosen.groupby(group, dropna=False, sort=False)]:
                    for at in range(0, len(rows), size):
                        part = rows.iloc[at : at + size]
                        for place, x in zip(part.index, run(model, part, value), strict=True):
                            values.at[place] = x
                yield frame.assign(**{output: values.tolist()})

        return df.mapInPandas(scored, StructType([*df.schema.fields, StructField(output, self.kind)]))


def with_retries(call: Callable[[str], str], tries: int = 3, base: float = 2.0, default: str = "") -> Callable[[str], str]:
    """A hosted model's call: tries again after 1, 2, 4 ... seconds, then gives the default."""
    import time

    def wrapped(prompt: str) -> str:
        for k in range(tries):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001  any failure of a remote call counts
                if k + 1 < tries:
                    time.sleep(base**k)
        return default

    return wrapped


def hosted(connect: Callable[[], Callable[[str], str]], tries: int = 3, base: float = 2.0, default: str = "") -> ArrowScorer:
    """A hosted model as a scorer: each worker connects once; a prompt whose tries all fail gives the default."""

    def load():
        call = with_retries(connect(), tries, base, default)
        return lambda prompts: [call(p) for p in prompts]

    return ArrowScorer(load, StringType())


def translated(df: DataFrame, load: Callable[[], Callable[..., list[str]]], text: str, source: Column, target: Column, output: str, batch: int = 64) -> DataFrame:
    """df with `output`: text translated from source to target. The model is called as model(target, texts), one target at a time.

    Rows whose source is their target keep their text and never reach the model; blank texts are given as one space.
    """
    rows = df.withColumns({"_text": T.model_text(F.col(text)), "_target": target, "_moves": ~source.eqNullSafe(target)})
    scorer = ArrowScorer(load, StringType(), batch, on_error="", keep="_text", group="_target", where="_moves")
    return _failing_blank(scorer.score(rows, ["_text"], output), output).drop("_text", "_target", "_moves")


def _failing_blank(df: DataFrame, output: str) -> DataFrame:
    return df.withColumn(output, F.coalesce(F.col(output), F.lit("")))


def toxic_probability(label: Column, p: Column) -> Column:
    return F.when(F.lower(label).contains("toxic"), p).otherwise(1.0 - p)


def free_of_toxicity(question: Column, answer: Column, limit: float = TOXIC) -> Column:
    """Neither side's probability reaches the limit; a missing one does not."""
    high = lambda p: F.coalesce(p >= limit, F.lit(False))
    return ~(high(question) | high(answer))


def detected(text: Column, code: Column, confidence: Column) -> Column:
    """struct(code, confidence) as a detector gave them; (und, 0) where it failed or the stripped text is too short to tell."""
    usable = (F.length(T.strip(F.coalesce(text, F.lit("")))) >= LEAST_DETECTED_CHARS) & code.isNotNull() & confidence.isNotNull()
    return F.struct(F.when(usable, code).otherwise(F.lit(UNDETERMINED)).alias("code"), F.when(usable, confidence).otherwise(F.lit(0.0)).alias("confidence"))


def codes_of(subset: Column, codes: dict[str, tuple[str, ...]]) -> Column:
    """The accepted codes of a tag; null for a tag without any."""
    return F.coalesce(*[F.when(subset == tag, F.array(*[F.lit(c) for c in own])) for tag, own in codes.items()])


def language_accepted(code: Column, confidence: Column, accepted: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Detected with enough confidence and one of the accepted codes; a tag without codes accepts none."""
    return F.coalesce(F.array_contains(accepted, code) & (confidence >= least), F.lit(False))


def detector_input(text: Column) -> Column:
    """What the gate's detector is asked about: the first 200 characters."""
    return F.substring(text, 1, DETECTED_PREFIX)


def language_consistent(text: Column, subset: Column, code: Column) -> Column:
    """The gate's language rule: the script fits, and what was detected is accepted. Nothing detected, or a tag without codes, passes."""
    own = codes_of(subset, GATE_CODES)
    return T.script_present(text, subset) & F.coalesce(F.array_contains(own, code), F.lit(True))


def prefixed(text: Column, kind: str) -> Column:
    """How retrieval embedders want their inputs."""
    return F.concat(F.lit({"query": "query: ", "passage": "passage: "}[kind]), text)


def bert_means(df: DataFrame, scorer: Scorer, prediction: str = "prediction", reference: str = "reference") -> dict[str, float]:
    """Means of a scorer's struct(precision, recall, f1) over all rows; NaN for f1 alone if the scorer fails."""
    names = ("precision", "recall", "f1")
    try:
        row = scorer.score(df, [prediction, reference], "_bert").agg(*[F.avg(f"_bert.{n}").alias(f"bertscore_{n}") for n in names]).first()
    except Exception:  # noqa: BLE001  the score is optional: whatever fails, the others are reported
        return {"bertscore_f1": float("nan")}
    return {k: float("nan") if v is None else v for k, v in row.asDict().items()}
