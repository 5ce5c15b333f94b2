"""Every stage of the corpus pipeline, and all of them in a row, against brute force on a small corpus."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_duplicates import linked
from test_leaks_talks_models import similar_windows
from test_rules_sharding import measured
from tokenizers import Tokenizer

import corpus_pipeline

NAMES = ("lang", "source", "n_chars", "words", "kept", "band", "class_id", "rest", "shard", "text_key", "_gone_id", "pack_group")


def corpus():
    """(doc_id, text) and (item_id, text): copies, near copies, shared passages, leaks, junk, nulls, repeated rows."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((15, 22, 30, 41, 58))]
    rows = [(i, text(draw.randint(55, 160))) for i in range(40)]
    passage = text(30)
    for i in range(40, 48):
        rows.append((i, f"{text(40)}\n{passage}\n{text(30)}é{text(5)}"))
    for i in range(48, 60):  # near copies
        w = rows[i - 40][1].split()
        w[draw.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 55][1]) for i in range(60, 66)]
    for i in range(66, 78):  # leaks, some edited
        w = items[i % 5][1].split()
        if i % 3 == 0 and len(w) > 25:
            w[-1] = "other"
        rows.append((i, f"{text(35)} {' '.join(w)} {text(30)}"))
    rows += [(None, f"{text(40)} {items[2][1]}"), (None, text(70)), (None, None), (78, None), (79, ""), (80, "short one"), (81, "again and again " * 60), (82, text(9000)), (83, "# $ % " * 40)]
    rows += [rows[3], (84, text(60)), (84, text(66)), (85, text(51) + " ümläut ﬁ 漢字")]
    draw.shuffle(rows)
    return rows, items


def judged(rows):
    out = []
    for i, t in rows:
        n, chars, symbols, dup_lines, repeats = measured(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        upper = sum(c.isupper() for c in t or "")
        bad = n < 50 or 2 * repeats > n or 10 * symbols > n or 2 * dup_lines > lines or not 2 * n <= chars <= 15 * n or 100 * upper > 60 * chars
        out += [(i, t)] * (not bad)
    return out


def single(rows):
    gone = {i for i, _, component in linked(rows, 5) if i != component}
    return [(i, t) for i, t in rows if i not in gone or i is None]


def without_repeats(rows, length=50):
    key = lambda i: -(1 << 62) if i is None else i
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + length, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        out.append((i, np.frombuffer(b, np.uint8)[~gone[: len(b)]].tobytes().decode("utf-8", "ignore")))
    return out


def unleaked(rows, items):
    found = {n for n, _ in similar_windows([(n, t) for n, (_, t) in enumerate(rows)], items)}
    return [r for n, r in enumerate(rows) if n not in found]


def pieces(rows, path, window=4096):
    out = Counter()
    for (i, _), e in zip(rows, Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.asarray([*e.ids, 2], "<u4")
        out.update((i, at, len(p := ids[at : at + window]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), window))
    return out


def packed_rows(frame):
    """What identifies the pieces, after checking that they fill their sequences without gap or overlap."""
    rows, used = frame.collect(), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert all(u <= 4096 for u in used.values())
    return Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    path = tmp_path_factory.mktemp("corpus")
    frame = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*i, "y", "z") for i in items], "item_id long, text string, doc_id string, n_words string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_equals_brute_force(spark, folder, tokenizer_path):
    rows, items = corpus()
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    expected = {"quality rules": judged, "near duplicates": single, "repeated passages": without_repeats, "benchmark leaks": lambda r: unleaked(r, items)}
    for name, brute in expected.items():
        out = stages[name](spark, docs, folder)
        got = out.collect()
        left = brute(rows)
        assert out.columns == columns
        assert Counter((r.doc_id, r.text) for r in got) == Counter(left), name
        assert all(r.rest == r.kept == r.source == "x" for r in got)
        assert left != rows
    assert packed_rows(stages["packing"](spark, docs, folder)) == pieces(rows, tokenizer_path("word_bpe_49k.json"))


def test_run_equals_the_stages_in_a_row(spark, folder, tokenizer_path):
    rows, items = corpus()
    rows = unleaked(without_repeats(single(judged(rows))), items)
    assert packed_rows(corpus_pipeline.run(spark, folder)) == pieces(rows, tokenizer_path("word_bpe_49k.json"))


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns
