from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from polycurate.llm import quality_rules, sharding


def measured(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures_of_odd_rows(odd, none, odd_rows):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    expected = Counter((i, *(m := measured(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in odd_rows)
    assert got == expected
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules.ledger(none).count() == 0


def test_kept_documents_keep_their_columns(odd):
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns
    verdicts = quality_rules.apply_policy(quality_rules.ledger(odd)).filter("kept").count()
    assert kept.count() == verdicts > 0
    assert kept.filter("band = 'band' and kept = 'kept'").count() == verdicts


def test_policies_and_ablations(spark, small):
    ledger = quality_rules.ledger(spark.read.parquet(f"{small}/documents.parquet"))
    rows = ledger.collect()
    for version, mask in quality_rules.POLICIES.items():
        assert quality_rules.apply_policy(ledger, version).filter("kept").count() == sum(not r.fail_bits & mask for r in rows)
        for a in quality_rules.ablations(ledger, version).collect():
            bit = quality_rules.BIT[a.rule]
            assert a.n_failed == sum(bool(r.fail_bits & bit) for r in rows)
            assert a.n_only == sum(r.fail_bits & mask == bit for r in rows)
            assert a.n_kept_without == sum(not r.fail_bits & mask & ~bit for r in rows)


def test_plan_has_no_python(odd):
    plan = quality_rules.kept_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_shards(rows, shards=8):
    size = Counter()
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
        size[s] = sum(r.size for r in rows if r.shard == s)
    assert max(size.values()) - min(size.values()) <= 2 * max((r.size for r in rows), default=0)


def test_shards_hold_equal_bytes(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.shard(documents).collect()
    check_shards(rows)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_shards_of_odd_rows(odd, none, odd_rows):
    rows = sharding.shard(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    check_shards(rows)
    assert sharding.shard(none).count() == 0


def test_hot_text_is_divided(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = sharding.shard(rows).collect()
    check_shards(out)
    assert len({r.shard for r in out if r.doc_id % 3 == 0}) >= 3


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLING", 1)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 40).cast("int")).alias("text"))
    check_shards(sharding.shard(rows).collect())


def test_packed_keys_sort_as_numbers():
    draw = np.random.default_rng(3)
    columns = [draw.integers(-3, 3, 500), draw.integers(-(2**63), 2**63 - 1, 500), draw.integers(0, 5, 500)]
    order = np.lexsort(columns[::-1])
    assert (np.argsort(sharding.packed(columns), kind="stable") == order).all()
    assert len(sharding.packed([np.zeros(0, np.int64)] * 3)) == 0


def test_ranges_hold_neighbouring_keys_and_no_more_than_their_share(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one row again and again")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    records = sharding.written(sharding.keyed(rows.repartition(4)), "keys")
    n, total = records.agg(F.count("*"), F.sum("size")).first()
    parted = sharding.ranged(records, sharding.splitters(records, n, total, 32))
    spans = parted.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct(*sharding.KEYS)).alias("low"), F.max(F.struct(*sharding.KEYS)).alias("high")).orderBy("part").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:], strict=False))
    assert max(r.n for r in spans) <= 4 * 6000 / 32
