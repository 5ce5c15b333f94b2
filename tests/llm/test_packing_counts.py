from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from polycurate.llm import packing, token_counts
from polycurate.llm.tokens import WholeTokenCounter, WordEncoder, proven_whole_tokens

EDGES = ["", " ", "a\x1cb", "<|endoftext|> x <|startoftext|>", "Ünï Ωmega ЖЖ 漢字 ﬁ é é ̈a", "don't I'LL we've!!! ...", "x" * 500, "!" * 120, "İstanbul ΑΣ", "a　b\x85c\xa0d", "  two  spaces\n\n\nlines ", "12 ½ ²3", "ǅ ª º µ À×÷", "a b"]


def reference_ids(path, texts):
    return [np.asarray(e.ids, "<u4") for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def some_texts(spark, small):
    return [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + EDGES


def test_word_ids_equal_the_library(spark, small, tokenizer_path):
    path, texts = tokenizer_path("word_bpe_49k.json"), some_texts(spark, small)
    encoder = WordEncoder(path)
    assert [e.tobytes() for e in reference_ids(path, texts)] == encoder.encode(texts) == encoder.encode(texts)


def test_counts_equal_the_library(spark, small, tokenizer_path):
    path, texts = tokenizer_path("byte_bpe_50k.json"), some_texts(spark, small)
    counter = WholeTokenCounter(path, proven_whole_tokens(path))
    assert [len(e) for e in reference_ids(path, texts)] == counter.count(texts)


def test_checked_characters_agree_with_the_library(tokenizer_path):
    texts = [f"a{chr(c)}b {chr(c)}" for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x20AC]]
    for name, made in (("word_bpe_49k.json", lambda p: [len(x) // 4 for x in WordEncoder(p).encode(texts)]), ("byte_bpe_50k.json", lambda p: WholeTokenCounter(p, proven_whole_tokens(p)).count(texts))):
        assert [len(e) for e in reference_ids(tokenizer_path(name), texts)] == made(tokenizer_path(name))


def test_small_tables_start_afresh(monkeypatch, tokenizer_path):
    monkeypatch.setattr("polycurate.llm.tokens.TABLE_ENTRIES", 10)
    path = tokenizer_path("word_bpe_49k.json")
    encoder = WordEncoder(path)
    for texts in (["alpha beta gamma"] * 3, ["delta epsilon"], ["alpha zeta"]):
        assert [e.tobytes() for e in reference_ids(path, texts)] == encoder.encode(texts)


def test_token_counts_of_odd_rows(odd, none, odd_rows, tokenizer_path):
    path = tokenizer_path("byte_bpe_50k.json")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path).collect())
    ids = reference_ids(path, [t or "" for _, t in odd_rows])
    assert got == Counter((i, len((t or "").encode()), len(e), len(e) > 512) for (i, t), e in zip(odd_rows, ids, strict=True))
    assert token_counts.count_tokens(none, path).count() == 0


def check_packed(rows, texts, path, window):
    ids = {}
    for (i, _), e in zip(texts, reference_ids(path, [t or "" for _, t in texts]), strict=True):
        ids.setdefault(i, []).append(np.append(e, np.uint32(2)).astype("<u4"))
    covered, used = Counter(), defaultdict(list)
    for r in rows:
        whole = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({i: sum(map(len, x)) for i, x in ids.items()})
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(used), sum(covered.values())


def test_packing_round_trip(spark, small, odd, none, odd_rows, tokenizer_path):
    path = tokenizer_path("word_bpe_49k.json")
    check_packed(packing.pack(odd, path, window=256).collect(), odd_rows, path, 256)
    documents = spark.read.parquet(f"{small}/documents.parquet")
    n, total = check_packed(packing.pack(documents, path).collect(), [(r.doc_id, r.text) for r in documents.collect()], path, 4096)
    assert n <= total / 4096 * 1.05 + 1
    assert packing.pack(none, path).count() == 0


def test_sequences_are_padded(odd, tokenizer_path):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.sequence_texts(packing.pack(odd, path, window=256, keep_ids=True), 256).collect()
    assert all(len(r.ids) == 256 and not any(r.ids[r.n_used :]) for r in rows)


def test_best_fit_decreasing_takes_the_tightest_window():
    draw = random.Random(1)
    lengths = sorted((draw.randint(1, 100) for _ in range(400)), reverse=True)
    bins, offsets = packing.best_fit_decreasing(np.asarray(lengths), 100)
    room: list[int] = []
    for length, b, offset in zip(lengths, bins, offsets, strict=True):
        fitting = [r for r in room if r >= length]
        if fitting:
            assert room[b] == min(fitting) and offset == 100 - room[b]
        else:
            assert b == len(room) and offset == 0
            room.append(100)
        room[b] -= length
