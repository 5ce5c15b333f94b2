from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pytest

from polycurate.llm import near_dup, suffix_dedup
from polycurate.llm.components import components
from polycurate.llm.interleave import equal_windows
from polycurate.llm.words import shingle_hashes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked(rows, n, percent=80):
    """{(doc_id, shingles, component)} by comparing all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t, n))
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(shingle_set(t, n)), None if i is None else find(i)) for i, t in rows)


def found(frame):
    rows = frame.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_of_odd_rows(odd, odd_rows, n):
    assert found(near_dup.near_duplicates(odd, n)) == linked(odd_rows, n)


def test_no_rows(none):
    assert near_dup.near_duplicates(none).count() == 0
    assert suffix_dedup.repeats_report(none).count() == 0


def test_chain_and_threshold(spark):
    """a~b, b~c, a!~c is one component; a family of copies of which some reach only each other is linked over them."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    texts = [base]
    for step in range(6):
        nxt = list(texts[-1])
        for _ in range(4):
            nxt[draw.randrange(100)] = word()
        texts.append(nxt)
    texts += [[w if draw.random() > 0.055 else word() for w in base] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == linked(rows, 2)


def test_registers_estimate_jaccard():
    draw = np.random.default_rng(1)
    for n in (20, 500, 5000):
        pool = np.unique(draw.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2))
        a, b = pool[: int(1.6 * n)], pool[int(0.2 * n) :]
        a, b = np.sort(a), np.sort(b)
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        (fine,), (most,) = near_dup.fine_estimates(near_dup.fine_registers(a), [near_dup.fine_registers(b)], len(a), np.array([len(b)]))
        assert exact <= most + 1e-12 and (n > 100 or most < exact + 0.02)
        coarse = near_dup.estimated_jaccard(near_dup.registers(a), near_dup.registers(b), len(a), len(b))
        assert abs(fine - exact) < near_dup.FINE_MARGIN + near_dup.FINE_SHINGLES / n and abs(coarse - exact) < near_dup.MARGIN


def test_short_sequences_are_one_shingle():
    words = np.array([5, 6], np.uint64)
    assert len(shingle_hashes(words, 5)) == 1 and len(shingle_hashes(words[:0], 5)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (7, 99)] + [(200, k) for k in range(201, 230)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 99, 100]} | {i: 200 for i in range(200, 230)}


def test_equal_windows_are_grouped():
    draw = np.random.default_rng(2)
    windows = draw.integers(97, 99, (700, 9)).astype(np.uint8)
    for shard in (64, 1000):
        group = equal_windows(windows, shard)
        by = defaultdict(set)
        for g, w in zip(group, windows, strict=True):
            by[g].add(w.tobytes())
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({w.tobytes() for w in windows})
        sources = np.sort(draw.integers(0, 30, len(windows)))
        again = equal_windows(windows, shard, sources)
        assert len(set(zip(group.tolist(), again.tolist(), strict=True))) == len(by) == len(set(again.tolist()))


def test_shards_of_a_task_fall_into_few_buckets(spark):
    for buckets in (1, 3, 51):
        for task in (0, 7):
            numbers = list(islice(suffix_dedup.shard_numbers(task, buckets), 40))
            rows = spark.createDataFrame([(n,) for n in numbers], "n long").selectExpr("n", f"pmod(hash(n), {buckets}) as bucket").collect()
            assert len(set(numbers)) == 40 and {n >> 32 for n in numbers} == {task}
            assert {r.bucket for r in rows} == {(task * suffix_dedup.SPREAD + k) % buckets for k in range(suffix_dedup.SPREAD)}


def test_hash_ranges_are_dealt_evenly(spark):
    for n, partitions in ((1, 8), (108, 51), (40, 211), (7, 1)):
        parts = suffix_dedup.even_parts(n, partitions)
        rows = spark.createDataFrame([(int(x),) for x in parts], "n long").selectExpr(f"pmod(hash(n), {partitions}) as bucket").groupBy("bucket").count().collect()
        assert len(set(parts.tolist())) == n and max(r["count"] for r in rows) == -(-n // partitions)


def removed(rows, length=50):
    first: dict[bytes, int] = {}
    key = lambda i: -(1 << 62) if i is None else i
    encoded = [(key(i), i, (t or "").encode()) for i, t in rows]
    for k, _, b in encoded:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, k), k)
    out = Counter()
    for k, i, b in encoded:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < k:
                gone[p] += 1
                gone[p + length] -= 1
        off = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(off.astype(int), prepend=0) == 1).sum())
        out[(i, len(b), int(off.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~off].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_repeats_of_odd_rows(odd, odd_rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "MERGE_WINDOWS", 500)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 100)
    got = Counter(tuple(r) for r in suffix_dedup.repeats_report(odd, hot_contexts=hot).collect())
    assert got == removed(odd_rows)


def test_remaining_texts_keep_their_columns(odd, odd_rows):
    out = suffix_dedup.remaining_texts(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert all(r.rest == "rest" and r.source == "src" for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[8] == "" and texts[6] == "two WORDS" and len(texts[12]) < len(dict(odd_rows)[12])


def test_centers_meet_most_others(spark):
    """Class 7 shares a band with each of six others that share none among themselves; the least member was the center and met one other."""
    rows = [(band, c) for band, c in enumerate([1, 2, 3, 4, 5, 6])] + [(band, 7) for band in range(6)] + [(9, 8), (10, 1), (10, 2)]
    got = {r.band: (r.center, r["size"]) for r in near_dup.centers(spark.createDataFrame(rows, "band long, class_id long")).collect()}
    assert {b: x for b, x in got.items() if b < 6} == {b: (7, 2) for b in range(6)} and got[10][1] == 2 and 9 not in got
