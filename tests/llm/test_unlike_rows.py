"""Rows of one doc_id with different texts, against brute force over doc_ids."""

from __future__ import annotations

import random

from polycurate.llm import near_dup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or {(w,) for w in words}


def components(rows):
    """doc_id -> least doc_id that similar texts and shared doc_ids reach."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    return top


def test_rows_of_one_document_with_different_texts(spark):
    draw = random.Random(3)
    base = [[f"{draw.choice('abcdefghij')}{draw.randrange(900)}" for _ in range(150)] for _ in range(8)]
    near = lambda k: " ".join(w if draw.random() > 0.03 else f"new{draw.randrange(99)}" for w in base[k])
    rows = [(i, near(i % 8)) for i in range(40)]
    rows += [(i, near((i + 3) % 8)) for i in (5, 12)] + [(100, near(1)), (100, near(6)), (100, ""), (101, near(2)), (101, "alone here"), (102, "alone here"), (103, "")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    expected = components(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == set(expected.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
