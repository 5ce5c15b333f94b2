"""Literal cases, with the expected values derived by hand."""

from __future__ import annotations

import gzip
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polycurate.functions import overlap as O
from polycurate.functions import scores as S
from polycurate.functions import text as T
from polycurate.functions import udfs
from polycurate.operators import cascade, profile, sampling, similarity
from polycurate.plans import views
from polycurate.sources import io


def values(spark, items, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_tokens_and_space(spark):
    assert values(spark, ["", "a b", "a　b", None, " a\x1cb "], T.token_count) == [0, 2, 2, 0, 2]
    assert values(spark, ["x <b>y</b> http://a.b/c [[12]] z", "a\nb"], T.strip_noise) == ["x y z", "a\nb"]
    assert values(spark, [" a \t\n b\x00 ", None], T.clean_whitespace) == ["a b", ""]


def test_repetition_and_shingles(spark):
    assert values(spark, ["a b c d", "a b c d a b c d", ""], T.repetition_ratio) == [0.0, 0.19999999999999996, 0.0]
    assert [sorted(x) for x in values(spark, ["abc", "", "ABCDEF"], T.shingles)] == [["abc"], [], ["abcde", "bcdef"]]


def test_script_share(spark):
    texts = ["ሰሰሰሰሰሰabcd", "ሰሰሰሰሰabcd" + "e", "፡።", "abc"]
    assert values(spark, texts, lambda c: T.script_ok(c, F.lit("ETHIOPIC"))) == [True, False, False, False]
    assert values(spark, texts, T.dominant_script) == ["ETHIOPIC", "MIXED", "EMPTY", "LATIN"]


def test_flags_and_tags(spark):
    assert values(spark, ["+256 700 123456", "a@b.co", "Dr. Okello", "plain", None], T.contains_pii) == [True, True, True, False, False]
    assert values(spark, ["Take 10 tablets at once", "rest", None], T.flag_unsafe) == [True, False, False]
    assert values(spark, ["Swa_Ken", " twi ", "swa_ken", "Eng", None], T.normalise_tag) == ["Swa_Ken", "Aka_Gha", None, "Eng_Uga", None]


def test_hash_without_separator_collides(spark):
    row = spark.range(1).select(*[T.row_hash(F.lit(a), F.lit(b), separator=s).alias(f"{a}{len(s)}") for s in ("", "|||") for a, b in (("ab", "c"), ("a", "bc"))]).first()
    assert row[0] == row[1] and row[2] != row[3]


def test_missing_scores(spark):
    x = [0.1, 0.9, None, float("nan")]
    assert values(spark, x, lambda c: S.below(c, 0.5), "double") == [True, False, False, False]
    assert values(spark, x, lambda c: S.at_least(c, 0.5), "double") == [False, True, False, False]


def test_judge_and_composite(spark):
    replies = ['{"overall": 4.5}', '{"accuracy": 4, "completeness": 2}', "4.5 / 5", "n/a", None]
    assert values(spark, replies, S.judge_score) == [4.5, 3.0, 4.5, 3.0, 3.0]
    assert spark.range(1).select(S.composite(F.lit(0.5), F.lit(0.4), F.lit(3.0))).first()[0] == 0.463


def test_rouge(spark):
    amharic = "ሰላም ለዓለም"
    row = lambda kind: spark.range(1).select(*[f(T.rouge_tokens(F.lit(amharic), kind), T.rouge_tokens(F.lit(amharic), kind)) for f in (O.rouge1, O.rouge_l)]).first()
    assert tuple(row("unicode")) == (1.0, 1.0) and tuple(row("ascii")) == (0.0, 0.0)


def test_rouge_of_texts(spark):
    rows = [("ﬁve Sechs", "FIVE sechs"), ("", "a"), (None, None), ("b a", "a b"), ("ጤና x", "ጤና y")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string")
    scores = lambda **options: [(round(x.s.rouge1, 6), round(x.s.rougeL, 6)) for x in frame.select("i", O.rouge(F.col("p"), F.col("r"), **options).alias("s")).orderBy("i").collect()]
    assert scores() == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (1.0, 0.5), (0.5, 0.5)]
    assert scores(kind="ascii")[4] == (0.0, 0.0) and scores(kind="ascii")[3] == (1.0, 0.5)


def test_rouge_equals_counting(spark):
    draw = random.Random(6)
    pairs = [([draw.choice("abcdé") for _ in range(draw.randint(0, 25))], [draw.choice("abcdé") for _ in range(draw.randint(0, 25))]) for _ in range(80)] + [(None, ["a"]), (["a"], None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p array<string>, r array<string>").repartition(3)
    got = {x.i: (x.r1, x.rl) for x in rows.select("i", O.rouge1(F.col("p"), F.col("r")).alias("r1"), O.rouge_l(F.col("p"), F.col("r")).alias("rl")).collect()}
    for i, (p, r) in enumerate(pairs):
        p, r = p or [], r or []
        both = 2 * (Counter(p) & Counter(r)).total() / max(len(p) + len(r), 1)
        assert got[i] == pytest.approx((both, 2 * O.subsequence_length(p, r) / max(len(p) + len(r), 1)))


def test_common_subsequence_equals_the_table():
    draw = random.Random(0)
    for _ in range(50):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert O.subsequence_length(a, b) == table[-1][-1]


def test_gram_matches_equal_counting():
    draw = random.Random(1)
    a, b = (["".join(draw.choice("abcé漢") for _ in range(draw.randrange(40))) for _ in range(200)] for _ in range(2))
    got = O.gram_matches(a, b)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for n in range(1, 7):
            grams = lambda t: Counter(t[k : k + n] for k in range(len(t) - n + 1))  # noqa: B023, E731
            assert got[i, n - 1] == (grams(x) & grams(y)).total()


def test_shingle_hashes_tell_shingles_apart(spark):
    draw = random.Random(3)
    texts = ["", "a", "ab", "abcd", "abcde", "aaaaaaa", None, *["".join(draw.choice("ab é漢") for _ in range(draw.randrange(12))) for _ in range(200)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    found = {r.i: (set(r.x), r.y) for r in rows.select("i", T.shingles(F.col("t")).alias("x"), O.shingles(T.single_spaced(F.col("t")), 5).alias("y")).collect()}
    assert all(len(x) == len(y) == len(set(y)) for x, y in found.values())
    for i in range(len(texts)):
        x, y = found[draw.randrange(len(texts))], found[i]
        assert len(x[0] & y[0]) == len(set(x[1]) & set(y[1]))


def test_chrf_by_hand(spark):
    pairs = [("same text", "same text"), ("ab", "ba"), ("", "a"), ("abcd", "ab"), ("a b\tc", "abc"), (None, "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, p string")
    got = rows.select("i", O.chrf(F.col("r"), F.col("p")).alias("own"), O.sentence_chrf(F.col("r"), F.col("p")).alias("whole")).orderBy("i").collect()
    # ab against ba: order 1 has all, order 2 nothing; abcd against ab: precision 1, recall (1/2 + 1/3) / 2
    assert [round(r.own, 4) for r in got] == [1.0, 1.0, 0.0, round((5 * 2 / (4 * 4 + 2) + 5 / (4 * 3 + 1)) / 2, 4), round((5 * 3 / 19 + 5 / 14) / 2, 4), 0.0]
    assert [round(r.whole, 4) for r in got] == [1.0, 0.5, 0.0, 0.4717, 1.0, 0.0]


def dropped(spark, texts, threshold):
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "ord long, subset string, input string")
    return sorted(r.key for r in similarity.near_duplicates(rows, "ord", "subset", F.col("input"), threshold).filter("not kept").collect())


def test_greedy_chain_keeps_the_end(spark):
    a, b, c = "abcdefghijklmnop", "abcdefghijklmnopqrst", "cdefghijklmnopqrstuv"
    assert dropped(spark, [a, b, c], 0.7) == [1]
    assert dropped(spark, [b, a, c], 0.7) == [1, 2]


def test_greedy_empty_and_short(spark):
    assert dropped(spark, ["", " ", None, "abc", "abc", "abd"], 0.85) == [1, 2, 4]


@pytest.mark.parametrize("edges", [0, 500_000])
def test_greedy_equals_a_loop(spark, monkeypatch, edges):
    monkeypatch.setattr(similarity, "TASK_EDGES", edges)
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab ") for _ in range(draw.randint(0, 14))) for _ in range(120)]
    sets = []
    for t in texts:
        t = " ".join(t.split())
        sets.append({t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set())
    kept, gone = [], []
    for i, s in enumerate(sets):
        alike = any((not s and not k) or (s and k and len(s & k) / len(s | k) >= 0.5) for k in kept)
        (gone.append(i) if alike else kept.append(s))
    assert dropped(spark, texts, 0.5) == gone


def test_similar_across_pairs_empty_rows(spark):
    rows = lambda texts: similarity.shingle_rows(spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "key int, group string, t string"), "key", "group", F.col("t"), 5)
    found = similarity.similar_across(rows(["", "abcdefgh", "other words"]), rows([" ", "abcdefgh!", None]), 0.5)
    assert sorted((r.a, r.b, round(r.jaccard, 2)) for r in found.collect()) == [(0, 0, 1.0), (1, 1, 0.8)]


def test_places_and_ranks(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("g"), F.md5(F.col("id").cast("string")).alias("k")).withColumn("g", F.when(F.col("g") != "2", F.col("g")))
    placed = sampling.numbered(rows, [F.col("k")]).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 501)) and [r.k for r in placed] == sorted(r.k for r in placed)
    ranked = sampling.group_ranks(rows, "g", [F.col("k")], "rank").collect()
    for g in ("0", "1", None):
        own = sorted((r.rank, r.k) for r in ranked if r.g == g)
        assert [x for x, _ in own] == list(range(1, len(own) + 1)) and [k for _, k in own] == sorted(k for _, k in own)
    ids = sampling.fallback_ids(spark.createDataFrame([("a", 1), (None, 2), (" ", 3)], "id string, ord int"), "id", [F.col("ord")])
    assert sorted(r.id for r in ids.collect()) == ["a", "aug_00000000", "aug_00000001"]
    few = sampling.per_group(rows, "g", {"0": 2, "1": 0}, [F.col("k")]).collect()
    assert len(few) == 2 and {r.g for r in few} == {"0"}


def test_percentiles_and_agreement(spark):
    draw = random.Random(2)
    values = {g: [draw.random() for _ in range(n)] for g, n in (("a", 1), ("b", 10), ("c", 101))}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("b", float("nan"))], "g string, v double")
    got = {r.g: (r.p10, r.p50) for r in profile.percentiles(rows, "g", "v", {"p10": 0.1, "p50": 0.5}).collect()}
    for g, vs in values.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.1, 0.5])))
    # a published example: four raters, twelve units, alpha 0.743 (nominal) and 0.849 (interval)
    raters = ["1 2 3 3 2 1 4 1 2 . . .", "1 2 3 3 2 2 4 1 2 5 . 3", ". 3 3 3 2 3 4 2 2 5 1 .", "1 2 3 3 2 4 4 1 2 5 1 ."]
    ratings = spark.createDataFrame([(u, int(v)) for line in raters for u, v in enumerate(line.split()) if v != "."], "unit int, rating int")
    assert [round(profile.agreement(ratings, "unit", "rating", m).first().alpha, 3) for m in ("nominal", "interval")] == [0.743, 0.849]


def test_batches_by_memory(spark):
    rows = spark.createDataFrame([(80.0, "mt0-xxl"), (80.0, "mT0-XL"), (5.0, "base"), (10.0, "?")], "g double, m string")
    assert [r[0] for r in rows.select(S.batch_size(F.col("g"), S.model_size(F.col("m")))).collect()] == [6, 24, 1, 2]


def test_funnel_and_drops_account_for_every_row(spark):
    rows = spark.range(20).select("id", F.lit("en").alias("subset"), F.when(F.col("id") != 3, F.col("id")).alias("x"))
    funnel = cascade.gate_funnel(rows, [("a", F.col("x") > 5), ("b", F.col("x") % 2 == 0)]).orderBy("gate").collect()
    assert [(r.total, r.passing, r.failing) for r in funnel] == [(20, 14, 6), (14, 7, 7)]
    reasons = cascade.with_drop_reason(rows, [("low", F.col("x") < 5), ("odd", F.col("x") % 2 == 1)])
    report = {r.reason: (r["count"], r.per_language) for r in cascade.drop_report(reasons).collect()}
    assert report == {"low": (4, {"en": 4}), "odd": (8, {"en": 8})}


def test_sampling_sizes(spark):
    rows = spark.range(10).select("id", F.lit("en").alias("g"))
    assert sampling.mixed_by_ratio(rows, "g", {"en": 1.7}, "id", 1).count() == 17
    few = sampling.mixed_by_ratio(rows, "g", {"en": 0.5}, "id", 1)
    assert few.count() == few.select("id").distinct().count() == 5
    mixed = spark.createDataFrame([(i, "en", "original" if i > 3 else "added") for i in range(1, 7)], "id int, g string, source string")
    out = sampling.capped(mixed, "g", {"en": 4}, F.col("source") == "original", [F.col("id")]).collect()
    assert sorted(r.id for r in out) == [1, 4, 5, 6]


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text('input,output,subset\n"q, 1",a,en\n NA ,x,en\nNA,x,en\n')
    (tmp_path / "a.csv").write_text("input,output\n1,2\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"input,output,subset\n" + b"q,a,en\n" * 20_000)[:-40])
    rows, wrong = io.read_external(spark, str(tmp_path))
    assert sorted((r.input, r.source) for r in rows.collect()) == [("NA", "b"), ("q, 1", "b")]
    assert [(n.rsplit("/", 1)[-1], w.split(":")[0]) for n, w in wrong.items()] == [("a.csv", "lacks subset"), ("c.csv.gz", "cannot be read")]
    union, missing = io.read_present(spark, [f"{tmp_path}/b.csv", f"{tmp_path}/none.csv"])
    assert union.count() == 3 and missing == [f"{tmp_path}/none.csv"]
    with pytest.raises(ValueError):
        io.require_columns(union, ("ID",))
    made = spark.createDataFrame([(1, "de"), (2, "en")], "x int, subset string")
    assert io.write_missing_partitions(made.filter("x = 1"), f"{tmp_path}/parts") == []
    assert io.write_missing_partitions(made, f"{tmp_path}/parts") == ["de"]
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 2
    io.write_csv(made, f"{tmp_path}/csv")
    io.write_json_report(made, f"{tmp_path}/json")
    assert io.read_csv(spark, f"{tmp_path}/csv").count() == 2 and spark.read.json(f"{tmp_path}/json").count() == 2


def test_following_rows_of_long_groups(spark):
    rows = [(c, t, f"{c}-{t}") for c, n in ((1, 50), (2, 1), (3, 7)) for t in range(0, 3 * n, 3)]
    frame = spark.createDataFrame(rows, "c long, t long, x string").repartition(5)
    got = {r.x: r.following and r.following.x for r in views.with_following(frame, "c", "t", ["x"], chunk=8).collect()}
    assert got == {x: (f"{c}-{t + 3}" if (c, t + 3, f"{c}-{t + 3}") in rows else None) for c, t, x in rows}


def test_linked_classes_count_copies(spark):
    words = "the quick brown fox jumps over the lazy dog near the river bank today".split()
    near = [" ".join([*words[:-1], w]) for w in ("today", "today!", "todays")]
    texts = [near[0]] * 50 + [near[1]] * 3 + [near[2], "something else entirely, far away", "", " "]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(100, "de", near[0])]
    got = {r.key: (r.class_id, r.n_links) for r in similarity.linked_classes(spark.createDataFrame(rows, "id int, g string, t string"), "id", "g", F.col("t"), 0.85).collect()}
    assert got[7] == (0, 53) and got[51] == (50, 53) and got[53] == (53, 53) and got[54] == (54, 0) and got[100] == (100, 0) and got[56] == (55, 0)


def test_similar_rows_meet_by_parts(spark, monkeypatch):
    """Against brute force; unlike texts of one small vocabulary hardly meet, and no table holds sets (all pairs that shared a rare shingle were fetched with both sets)."""
    draw, tables, settled = random.Random(3), [], similarity.settled
    monkeypatch.setattr(similarity, "settled", lambda df, label: tables.append((label, settled(df, label))) or tables[-1][1])
    words = ["".join(draw.choice("abcdef") for _ in range(draw.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    for t in texts[:100]:
        at = draw.randrange(len(t))
        texts.append(t[:at] + draw.choice(["", " ", "x", "two words"]) + t[at + draw.randint(0, 3) :])
    rows = spark.createDataFrame([(i, "ab"[i % 2 if i < 400 else (i - 400) % 2], t) for i, t in enumerate(texts)], "id int, g string, t string")
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (" ".join(t.split()) for t in texts)]
    group = [r.g for r in rows.orderBy("id").collect()]
    near = [sum(j != i and group[i] == group[j] and len(s & o) / len(s | o) >= 0.85 for j, o in enumerate(sets)) for i, s in enumerate(sets)]
    got = {r.key: r.n_links for r in similarity.linked_classes(rows, "id", "g", F.col("t"), 0.85).collect()}
    assert sum(near) > 100 and [got[i] for i in range(len(texts))] == near
    assert not any("array" in t for _, df in tables for _, t in df.dtypes)
    assert sum(df.count() for label, df in tables if label == "near") <= sum(near)


def test_group_ranks_do_not_deal_rows_by_group(spark):
    """A join by a few groups brought each of them, whole, to one task where Spark had not broadcast the other side."""
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (sampling.group_ranks(rows, "g", [F.col("id")], "rank"), sampling.mixed_by_ratio(rows, "g", {}, "id", 1)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(g#\d+, \d+\)", plan) and made.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_changed_texts_come_back(spark, monkeypatch):
    """Texts in normal form already were built a second time in the worker and sent back."""
    seen = []
    monkeypatch.setattr(udfs.F, "arrow_udf", lambda f, kind: seen.append(f) or (lambda c: c))
    udfs.nfc("text")
    assert seen[0](pa.array(["é", "é", None, "ü"])).to_pylist() == [None, "é", None, None]
    monkeypatch.undo()
    texts = ["é", "é", None, "plain", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", udfs.nfc("text").alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["é", "é", None, "plain", ""]


def _near_copies(n, seed=5):
    """(id, language, text) of near copies of two long lines, other lines between them, some short, some equal, some blank."""
    draw, words = random.Random(seed), [f"w{i}ord{i * 7 % 11}" for i in range(300)]
    bases, rows = [[draw.choice(words) for _ in range(40)] for _ in range(2)], []
    for i in range(n):
        base = list(bases[draw.random() < 0.2]) if draw.random() < 0.8 else [draw.choice(words) for _ in range(draw.choice([1, 2, 3, 30]))]
        for _ in range(draw.choice([0, 1, 2, 3])):
            base[draw.randrange(len(base))] = draw.choice(words)
        rows.append((i, draw.choice(["en", "en", "en", "de", None]), draw.choice([" ".join(base)] * 20 + ["", None])))
    return rows


@pytest.mark.parametrize(("crowd", "block", "open_pairs"), [(4, 16, 0), (4, 16, 10**9), (8, 1024, 500), (10**9, 1024, 0)])
def test_families_of_near_copies(spark, monkeypatch, crowd, block, open_pairs):
    rows = _near_copies(260)
    grams = {i: {" ".join((t or "").split())[j : j + 5] for j in range(len(" ".join((t or "").split())) - 4)} for i, _, t in rows}
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) if grams[a] and grams[b] else 0
    links, gone = {i: [like(i, j) for j, h, _ in rows if j != i and h == g and g and like(i, j) >= 0.85] for i, g, _ in rows}, set()
    for b, g, _ in rows:
        if any(h == g and g and a < b and a not in gone and like(a, b) >= 0.85 for a, h, _ in rows):
            gone.add(b)
    tables, settled = [], similarity.settled
    monkeypatch.setattr(similarity, "settled", lambda df, label: tables.append((label, settled(df, label))) or tables[-1][1])
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("OPEN_PAIRS", open_pairs)):
        monkeypatch.setattr(similarity, name, value)
    frame = spark.createDataFrame(rows, "id int, g string, t string").repartition(3)
    found = {r.key: (r.n_links, r.nearest) for r in similarity.linked_classes(frame, "id", "g", F.col("t"), 0.85).collect()}
    with_grams = [i for i, g, _ in rows if grams[i] and g]
    assert {i: found[i][0] for i in with_grams} == {i: len(links[i]) for i in with_grams}
    other = {i: max((x for x in links[i] if x < 1), default=None) for i in with_grams}
    assert {i: found[i][1] for i in with_grams} == other
    if crowd < 10:  # pairs of a family are not written
        assert next(t for label, t in tables if label == "members").count() > 100
        assert next(t for label, t in tables if label == "near").count() < 100 < sum(map(len, links.values())) / 20
    blank = {i for i, g, _ in rows if not grams[i] or g is None}
    dropped = {r.key for r in similarity.near_duplicates(frame, "id", "g", F.col("t"), 0.85).filter("not kept").collect()}
    assert dropped - blank == gone - blank


def _shuffled(spark, kind="Bytes") -> int:
    """Bytes, or Records, that all stages up to now have written to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(getattr(stages.apply(i), f"shuffleWrite{kind}")() for i in range(stages.size()))


def test_texts_of_pairs_travel_once(spark, monkeypatch):
    """Each pair of near copies brought the sets of both its texts; now a text goes to its cells, about as often as there are rows."""
    draw, copies = random.Random(8), 30
    rows = []
    for g in range(6):
        base = "".join(draw.choice("abcdefghij klmnopq") for _ in range(600)).strip()
        for _ in range(copies):
            at = draw.randrange(600)
            rows.append((len(rows), "ab"[len(rows) % 7 == 0], base[:at] + draw.choice("rstuv") + base[at:]))
    frame = similarity.settled(spark.createDataFrame(rows, "key int, group string, text string"), "rows")
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if a // copies == b // copies or (a + b) % 50 == 0]
    met = similarity.settled(spark.createDataFrame(pairs, "a int, b int"), "pairs")
    monkeypatch.setattr(similarity, "BROADCAST_PAIRS", 0)
    before, limit = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.a, r.b): r.jaccard for r in similarity._scored(met, frame, frame, 0.85, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert _shuffled(spark) - before < 6 * sum(len(t) for _, _, t in rows)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (t for _, _, t in rows)]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs if rows[a][1] == rows[b][1]}
    assert got == {p: x for p, x in like.items() if x >= 0.85} and len(got) > 1500


def test_texts_of_a_large_family_travel_a_bounded_number_of_times(spark, monkeypatch):
    """A family's texts travelled once for each BLOCK of its rows, so that what was shuffled grew with the square of a family."""
    draw = random.Random(4)
    base = "".join(draw.choice("abcdefghij klmnopq") for _ in range(300))
    rows = [(i, "ab"[i % 9 == 0], base[:at] + draw.choice("rstuv") + base[at + draw.randrange(9) :]) for i in range(400) for at in [draw.randrange(290)]]
    frame = similarity.settled(spark.createDataFrame(rows, "key int, group string, text string").withColumns({"family": F.lit(1), "tag": F.lit(1)}), "rows")
    beside = spark.createDataFrame([(1, 1)], "family int, other int")
    monkeypatch.setattr(similarity, "BLOCK", 8)
    before = _shuffled(spark, "Records")
    got = {r.a: r.n for r in similarity._links_in_families(frame, beside, 0.85, 5).groupBy("a").agg(F.sum("others").alias("n")).collect()}
    assert _shuffled(spark, "Records") - before < 20 * len(rows)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, _, t in rows]
    links = {i: sum(j != i and rows[j][1] == rows[i][1] and len(s & o) / len(s | o) >= 0.85 for j, o in enumerate(sets)) for i, s in enumerate(sets)}
    assert got == {i: n for i, n in links.items() if n} and sum(links.values()) > 20_000
    later = {r.key for r in similarity._later_in_families(frame, beside, 0.85, 5).distinct().collect()}
    assert later == {i for i, s in enumerate(sets) if any(rows[j][1] == rows[i][1] and len(s & sets[j]) / len(s | sets[j]) >= 0.85 for j in range(i))}
