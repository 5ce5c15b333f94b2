"""Arrow functions for what Spark has no expression for: Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal(text: Column | str, form: str) -> Column:
    """A text in a normal form. ASCII is in all of them, so such texts stay where they are; others are looked at one by one, and only those that change come back."""
    text = F.col(text) if isinstance(text, str) else text

    def run(texts: pa.Array) -> pa.Array:
        changed = pa.array((None if t is None or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t) for t in (x.as_py() for x in texts)), pa.string())
        pa.default_memory_pool().release_unused()  # workers are kept and reused
        return changed

    other = F.when(F.char_length(text) < F.octet_length(text), text)
    return F.coalesce(F.arrow_udf(run, "string")(other), text)


def nfc(text: Column | str) -> Column:
    return _normal(text, "NFC")


def nfkc(text: Column | str) -> Column:
    return _normal(text, "NFKC")
