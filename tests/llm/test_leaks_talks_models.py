from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from polycurate.llm import conversations, decontamination, quality_crf, toxicity

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potent beer and nobody in the old harbour town ever asks why the lanterns glow so late"


def test_leaks_exact_edited_and_short(spark):
    words = ITEM.split()
    edited = [*words[:-1], "early"]
    broken = [w if i % 4 else "zzz" for i, w in enumerate(words)]
    rows = [(1, f"Intro here. {ITEM}! The end."), (2, "x " * 9 + " ".join(edited).upper()), (3, " ".join(broken)), (4, "two words"), (5, "two words more"), (6, None), (7, ""), (None, ITEM), (1, f"Intro here. {ITEM}! The end."), (8, " ".join(words[:15]))]
    documents = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, words string, shingle string")
    benchmark = spark.createDataFrame([(10, ITEM, 1), (11, "Two, words!", 1), (12, None, 1), (13, "?", 1)], "item_id long, text string, windows int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.start_word, r.n_words) for r in decontamination.leaks(documents, benchmark).collect()}
    n = len(words)
    assert got == {(1, 10): (1.0, 2, n), (2, 10): (round((n - 5) / (n - 3), 3), 8, n), (None, 10): (1.0, 0, n), (4, 11): (1.0, 0, 2)}
    assert decontamination.leaks(documents.limit(0), benchmark).count() == decontamination.leaks(documents, benchmark.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_the_radius(spark):
    draw = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for i in range(60):
        a = draw.getrandbits(128)
        b = a
        for bit in draw.sample(range(128), decontamination.RADIUS):
            b ^= 1 << bit
        pairs.append((i, *[(signed(x >> 64), signed(x & ((1 << 64) - 1))) for x in (a, b)]))
    rows = spark.createDataFrame(pairs, "i int, a struct<high:long,low:long>, b struct<high:long,low:long>")
    found = rows.select(F.size(F.array_intersect(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b")))).alias("n"), decontamination.distance(F.col("a"), F.col("b")).alias("d"))
    assert found.filter("n = 0").count() == 0 and found.filter(f"d <> {decontamination.RADIUS}").count() == 0


def test_bit_sliced_simhash_equals_counting(spark):
    draw = random.Random(8)
    rows = [(i, [draw.getrandbits(64) - (1 << 63) for _ in range(n)]) for i, n in enumerate((1, 2, 5, 8, 31, 32, 63))]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, words array<long>").select("i", decontamination.simhash(F.col("words"), 6).alias("h")).collect()}
    for i, words in rows:
        expected = sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))
        assert got[i] % (1 << 64) == expected


def similar_windows(rows, items):
    """{(doc_id, item_id): (similarity, start, words)} by comparing every window of every document with every item."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    out = {}
    for i, text in rows:
        words = split(text)
        for k, item in items:
            of = split(item)
            y = grams(of)
            for start in range(1 - len(of), len(words)) if of else ():
                window = words[max(start, 0) : start + len(of)]
                if (len(window) < 5) != (len(of) < 5) or (len(of) < 5 and len(words) > 4):
                    continue  # a text of fewer than five words is one shingle
                x = grams(window)
                best = (sum((x & y).values()) / sum((x | y).values()), -start, len(window))
                if best[0] >= 0.8 and best > out.get((i, k), (0,)):
                    out[i, k] = best
    return {key: (round(s, 9), max(-start, 0), n) for key, (s, start, n) in out.items()}


def test_leaks_equal_all_windows(spark):
    """Exact, edited, cut, turned-round and repeated items in longer texts: the index loses none."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmno") for _ in range(5))
    items = [(k, [word() for _ in range(draw.choice((14, 21, 33, 33, 47, 59)))]) for k in range(24)]
    items += [(90, ["la"] * 30), (91, ["one", "two", "three", "four", "five"] * 6), (92, [word() for _ in range(400)]), (93, ["a", "b", "c"]), (94, ["p", "q", "r", "s", "t"])]
    rows = [(0, " ".join(word() for _ in range(20_000)))]
    for i in range(1, 261):
        k, of = draw.choice(items)
        w = list(of)
        kind = i % 6
        if kind == 1:
            w[draw.randrange(len(w))] = word()
        elif kind == 2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        elif kind == 3:
            w = w[draw.randrange(4) : len(w) - draw.randrange(4)]
        elif kind == 4:
            at = draw.randrange(len(w))
            w = w[:at] + [word()] + w[at + draw.randrange(2) :]
        elif kind == 5:
            w = w + w[: len(w) // 2]
        before, after = draw.randrange(30) * (i % 4 > 0), draw.randrange(30) * (i % 5 > 0)
        rows.append((i, " ".join([*(word() for _ in range(before)), *w, *(word() for _ in range(after))])))
    names = ["window_id", "fingerprint", "n_words", "item_id", "start", "mark", "of"]
    documents = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w), "x", "y") for k, w in items], "item_id long, text string, doc_id string, n_words string")
    expected = similar_windows(rows, [(k, " ".join(w)) for k, w in items])
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in decontamination.leaks(documents, benchmark).collect()}
    assert got == expected and len(got) > 150
    turned = {(r.doc_id, r.similarity < 1) for r in decontamination.leaks(documents, benchmark).collect() if r.doc_id % 6 == 2}
    assert (any(less for _, less in turned))
    kept = decontamination.clean_documents(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_rows_without_doc_id_leak_by_their_text(spark):
    rows = [(None, f"so {ITEM}"), (None, "clean words here"), (1, ITEM), (1, "other text of the same id"), (2, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontamination.clean_documents(documents, spark.createDataFrame([(None, ITEM)], "item_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (rows[1], rows[3], rows[4])))


def test_threads(spark):
    rows = [
        (1, 0, "user", "Hello there, how do I fry an egg?\nThanks a lot friends"), (1, 1, "assistant", "Anna wrote:\n> Hello there, how do I fry an egg?\n\nUse some butter in the pan."),
        (1, 2, "user", "> > Hello there, how do I fry an egg?\n> Use some butter in the pan.\nAnd then what?"), (1, 3, "user", "Unrelated remark here now"),
        (1, 4, "user", "> hello THERE how do i fry an egg\nMe too!"), (1, 5, "x", None), (2, 0, "user", ">nothing known\nok"), (None, 1, "user", "> a b c"), (2, None, "u", "t"), (2, 0, "user", ">nothing known\nok"),
    ]
    messages = spark.createDataFrame([(*r, "p", "q") for r in rows], "conv_id long, turn int, role string, text string, path string, position string")
    got = sorted((r.conv_id or -1, -1 if r.turn is None else r.turn, r.content, r.parent_turn, r.depth, r.n_quoted, r.n_linked, r.position) for r in conversations.threads(messages).collect() if r.conv_id == 1)
    assert [g[1:] for g in got] == [
        (0, rows[0][3], None, 0, 0, 0, 0), (1, "Use some butter in the pan.", 0, 1, 1, 1, 1), (2, "And then what?", 1, 2, 2, 2, 2),
        (3, "Unrelated remark here now", None, 0, 0, 0, 4), (4, "Me too!", 0, 1, 1, 1, 3), (5, "", None, 0, 0, 0, 5),
    ]
    all_rows = conversations.threads(messages).collect()
    assert len(all_rows) == len(rows) and sum(r.position is None for r in all_rows) == 2
    assert sorted(r.position for r in all_rows if r.conv_id == 2 and r.turn == 0) == [0, 1]
    assert conversations.threads(messages.limit(0)).count() == 0


def test_deep_threads_by_pointer_doubling(spark):
    rows = [(1, 0, "u", "message number zero with words")] + [(1, k, "u", f"> message number {k - 1} with words\nmessage number {k} with words") for k in range(1, 12)]
    rows[1] = (1, 1, "u", "> message number zero with words\nmessage number 1 with words")
    got = {r.turn: (r.parent_turn, r.depth, r.position) for r in conversations.threads(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {0: (None, 0, 0)} | {k: (k - 1, k, k) for k in range(1, 12)}


def test_places_in_trees_equal_a_walk(spark, monkeypatch):
    """Random trees, a message with many replies, a long chain, repeated rows, messages without links; small chunks."""
    monkeypatch.setattr(conversations, "CHUNK", 7)
    draw = random.Random(9)
    parents, sizes = {}, {}
    for conv in range(4):
        for turn in range(120):
            sizes[conv, turn] = draw.choice((1, 1, 1, 3))
            if turn and draw.random() < 0.8:
                parents[conv, turn] = {0: draw.randrange(turn), 1: 0, 2: turn - 1, 3: max(0, turn - draw.randrange(1, 4))}[conv]
    kids = {}
    for (conv, turn), parent in sorted(parents.items()):
        kids.setdefault((conv, parent), []).append(turn)
    expected = {}
    for conv in range(4):
        at, stack = 0, [(t, 0) for t in reversed(range(120)) if (conv, t) not in parents]
        while stack:
            turn, depth = stack.pop()
            expected[conv, turn] = (at, depth)
            at += sizes[conv, turn]
            stack += [(k, depth + 1) for k in reversed(kids.get((conv, turn), []))]
    as_frame = lambda values, name: spark.createDataFrame([(*k, v) for k, v in values.items()], f"conv_id long, turn long, {name} long")
    got = conversations.placed(as_frame(parents, "parent_turn"), as_frame(sizes, "n")).collect()
    assert {(r.conv_id, r.turn): (r.first, r.depth) for r in got} == expected


def test_very_long_messages_are_linked(spark):
    draw = random.Random(5)
    long = "\n".join(" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(3000))
    quoted = "\n".join(f"> {line}" for line in long.split("\n"))
    rows = [(1, 0, "u", long, "x"), (1, 1, "v", "nothing of it", "x"), (1, 2, "v", f"{quoted}\nyes indeed", "x")]
    got = {r.turn: (r.parent_turn, r.content, r.position) for r in conversations.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, first string")).collect()}
    assert got[2] == (0, "yes indeed", 1) and got[1][2] == 2


def auc(score, label):
    """Equal scores share the mean of their ranks."""
    values, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    return (rank[label == 1].mean() - (label.sum() + 1) / 2) / (len(label) - label.sum())


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for module, column, least, recall, precision in ((quality_crf, "quality", 0.99, 0.97, 0.97), (toxicity, "toxic", 0.95, 0.9, 0.85)):
        rows = module.score(documents, module.train(documents, labels)).join(labels, "doc_id").filter("held_out").toPandas()
        label, predicted = rows[column].to_numpy(), rows["predicted"].to_numpy()
        assert auc(rows["score"].to_numpy(), label) > least
        assert predicted[label == 1].mean() > recall and label[predicted == 1].mean() > precision
        assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()


def test_classifiers_on_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality_crf, toxicity):
        model = module.train(odd, labels)
        assert module.score(odd, model).filter("score between 0 and 1").count() == len(odd_rows)
        assert module.score(none, module.train(none, labels.limit(0))).count() == 0


def test_marginals_equal_enumeration():
    from itertools import product

    draw = np.random.default_rng(3)
    odds, ties, first = draw.normal(size=7), draw.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    lines = quality_crf.Lines(first, np.ones(7, int), np.zeros((7, 1), int))
    good, partition, pairs = quality_crf.marginals(lines, odds, ties)
    for d, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        weights = {y: np.exp(sum(odds[a + i] * (k - 0.5) for i, k in enumerate(y)) + sum(ties[p, q] for p, q in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=b - a)}
        total = sum(weights.values())
        assert np.allclose([sum(w for y, w in weights.items() if y[i]) / total for i in range(b - a)], good[a:b])
        assert np.allclose(sum(w / total * np.array([[sum((p, q) == (i, j) for p, q in zip(y, y[1:], strict=False)) for j in (0, 1)] for i in (0, 1)]) for y, w in weights.items()), pairs[d])


def test_likelihood_and_gradient_of_the_field():
    """The loss by enumeration of all label sequences, its gradient by finite differences."""
    from itertools import product

    draw = np.random.default_rng(7)
    text = ["one line\nTWO LINES!!\nthird", "alone", "a\nb\n\nc c c c"]
    encoded = [t.encode() for t in text]
    lines = quality_crf.read_lines(np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64), np.frombuffer(b"".join(encoded), np.uint8))
    label = np.repeat([1, 0, 1], np.diff(lines.first))
    theta = draw.normal(size=quality_crf.FEATURES + 4) / 3

    def brute(theta):
        odds, ties, total = quality_crf.potentials(lines, theta[: quality_crf.FEATURES]), theta[quality_crf.FEATURES :].reshape(2, 2), 0.0
        for a, b, y in zip(lines.first, lines.first[1:], (1, 0, 1), strict=False):
            value = lambda seq: sum(odds[a + i] * (k - 0.5) for i, k in enumerate(seq)) + sum(ties[p, q] for p, q in zip(seq, seq[1:], strict=False))  # noqa: B023, E731
            total += value((y,) * (b - a)) - np.log(sum(np.exp(value(seq)) for seq in product((0, 1), repeat=b - a)))
        return -total / 3

    loss, gradient = quality_crf.loss_and_gradient(theta, lines, label)
    assert np.isclose(loss, brute(theta))
    for i in [*np.unique(lines.active)[:20], quality_crf.WIDTH + lines.active[1, 0], quality_crf.FEATURES - 1, *range(quality_crf.FEATURES, quality_crf.FEATURES + 4)]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert np.isclose((brute(theta + step) - brute(theta - step)) / 2e-5, gradient[i], atol=1e-7)


def test_a_score_is_the_weighted_mean_of_its_lines(spark):
    lines = quality_crf.read_lines(np.array([0, 11, 14]), np.frombuffer(b"ab cd\nefghixyz", np.uint8))
    model = quality_crf.Model(np.random.default_rng(1).normal(size=quality_crf.FEATURES), np.eye(2) / 2, 2.0, -0.3)
    good, _, _ = quality_crf.marginals(lines, quality_crf.potentials(lines, model.weights), model.ties)
    raw = np.array([(6 * good[0] + 6 * good[1]) / 12, good[2]])
    assert np.allclose(model.raw(lines), raw) and np.allclose(model.scores(lines), 1 / (1 + np.exp(-(2 * (2 * raw - 1) - 0.3))))
    by_line = quality_crf.line_labels(spark.createDataFrame([(1, "ab cd\nefghi"), (2, "xyz")], "doc_id long, text string"), model).orderBy("doc_id", "line").collect()
    assert np.allclose([r.good for r in by_line], good) and [(r.doc_id, r.line) for r in by_line] == [(1, 0), (1, 1), (2, 0)]


def test_risk_of_all_unlabelled_documents(spark):
    draw = np.random.default_rng(11)
    documents = [np.unique(draw.integers(0, 20, draw.integers(0, 9))).astype(np.int32) for _ in range(300)]
    positive = [np.unique(draw.integers(0, 6, 5)).astype(np.int32) for _ in range(30)]
    places = spark.createDataFrame([(d.tobytes(),) for d in documents], "places binary").repartition(5)
    theta = draw.normal(size=21)
    loss, gradient = toxicity.unlabelled_sums(places, theta)
    f = np.array([theta[d].sum() + theta[-1] for d in documents])
    p = 1 / (1 + np.exp(-f))
    expected = np.array([sum(x for x, d in zip(p, documents, strict=True) if k in d) for k in range(20)] + [p.sum()])
    assert np.isclose(loss, np.log1p(np.exp(f)).sum()) and np.allclose(gradient, expected)
    # the same steps over both sides at once
    both, is_positive, prior = toxicity.Presence([*positive, *documents]), np.arange(330) < 30, 0.3
    descent = toxicity.Descent(theta, toxicity.WHOLE_RATE)
    for _ in range(3):
        descent.take(both.gathered(toxicity.risk(both.log_odds(descent.theta), is_positive, prior)[2], 21))
    assert np.allclose(toxicity.whole_fit(theta, positive, places, 300, prior, steps=3), descent.theta)


def test_non_negative_risk_and_its_direction():
    draw = np.random.default_rng(4)
    is_positive = np.arange(12) < 4
    loss = lambda f: np.log1p(np.exp(f))

    def brute(f, prior):
        positive = prior * np.mean([loss(-x) for x in f[:4]])
        return positive, np.mean([loss(x) for x in f[4:]]) - prior * np.mean([loss(x) for x in f[:4]])

    seen = set()
    for prior, shift in ((0.2, 0.0), (0.7, 3.0), (0.9, 2.0), (0.4, -1.0)):
        f = draw.normal(size=12) + np.where(is_positive, shift, -shift)
        positive, negative, direction = toxicity.risk(f, is_positive, prior)
        assert np.allclose((positive, negative), brute(f, prior))
        seen.add(negative < 0)
        for i in range(12):
            step = np.zeros(12)
            step[i] = 1e-6
            (p1, n1), (p0, n0) = brute(f + step, prior), brute(f - step, prior)
            slope = (n0 - n1) / 2e-6 if negative < 0 else (p1 + n1 - p0 - n0) / 2e-6
            assert np.isclose(slope, direction[i], atol=1e-6)
    assert seen == {True, False}


def test_features_are_counted_over_all_documents(spark):
    rows = [(i, "bad word bad" if i % 3 == 0 else "fine text") for i in range(60)] + [(None, "bad"), (5, None)]
    counts = {r.feature: r.n for r in toxicity.feature_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    word = lambda w: toxicity.letter_runs(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8))[0][:1]
    signed = lambda h: int(h.astype(np.int64)[0])
    assert counts[signed(word("bad"))] == 21 and counts[signed(toxicity.twice(word("bad")))] == 20 and counts[signed(word("fine"))] == 40


def test_unlike_labels_and_texts_of_one_document(spark):
    rows = [(i, f"{'idiot scum ' * 3 if i % 4 == 0 else 'good plain words '}{i}") for i in range(80)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(80)]
    twice = [(0, "another text of document nought"), *rows]
    both = [(0, 0, 0), (1, 0, 1), *labels]
    frame = lambda r, kinds: spark.createDataFrame(r, kinds)
    for module, column in ((quality_crf, "quality"), (toxicity, "toxic")):
        documents = [frame(x, "doc_id long, text string") for x in (twice, twice[::-1])]
        known = [frame(x, "doc_id long, quality int, toxic int").select("doc_id", column) for x in (both, both[::-1])]
        scores = [sorted((r.doc_id, r.score) for r in module.score(documents[0], module.train(d, k)).collect()) for d, k in zip(documents, known, strict=True)]
        assert scores[0] == scores[1]
