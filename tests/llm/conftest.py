from __future__ import annotations

import random

import pytest

CLASHING = "words string, shard string, band string, key string, size string, part string, class_id string, component_id string, registers string, fine string, pack_group string, length string, at string, fail_bits string, kept string, carried string, row string, rest string, windows string, start string, score string"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, near copies, a shared passage, a very long text."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(2, 9)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(40))
    near = [*base]
    near[60] = "changed"
    long = " ".join(word() for _ in range(40_000))
    rows = [
        (None, " ".join(word() for _ in range(60))), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"),
        (7, " ".join(base)), (7, " ".join(base)), (8, " ".join(base)), (9, " ".join(near)), (10, " ".join(near).upper()),
        (11, " ".join(word() for _ in range(70)) + "\n" + passage + "\n" + " ".join(word() for _ in range(20))),
        (12, passage + " " + " ".join(word() for _ in range(80))), (13, long), (14, "x" * 300), (15, "<|endoftext|> a\x1cb 漢字 ﬁ é don't!! " * 30),
        (16, "same line here\n" * 40), (17, "A B C " * 50), (18, "tab\tsep\x0bvertical\x0cfeed\rreturn " * 12), (19, "# $ % & | < > *" * 20),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """documents with those rows and columns whose names clash with the operators' own."""
    names = [c.split(" ")[0] for c in CLASHING.split(", ")]
    rows = [(i, t, "en", "src", len(t) if t else None, *names) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tokenizer_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path
