from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polycurate.llm import fill_middle, line_dedup, prefix_trie

BLANK = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines


def key_of(line):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in line.strip(BLANK))


def deduplicated(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key_of(line)) >= 20:
                holders[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(holders[key_of(x)]) >= 3 and i < max(holders[key_of(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def lines_of(frame):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_lines(frame, line_dedup.keep_bitmaps(frame)).collect())


def test_lines_of_odd_rows(odd, odd_rows, none):
    assert lines_of(odd) == Counter(deduplicated(odd_rows))
    assert not lines_of(none)


def test_lines_shared_by_few_and_by_nearly_all(spark):
    draw = random.Random(5)
    common = "This line stands in NEARLY every document, Ärger"
    some = [f"a line number {k} that some documents have" for k in range(30)]
    rows = []
    for i in range(700):
        lines = [draw.choice([common, common.lower(), f"  {common}\r", *some, "short", "", f"only in document {i} and nowhere else", "Kelvin and kelvin are not alike", "kelvin and kelvin are not alike"]) for _ in range(draw.randint(1, 9))]
        rows.append((draw.choice([i, i, i, None, i // 2]), "\n".join([common] * (i % 3) + lines)))
    rows += rows[100:160]  # repeated rows
    rows += [(900, "two documents only share this one"), (901, "two documents only share this one"), (902, "x" * 19), (903, "x" * 19), (904, "x" * 19), (905, "y" * 20), (906, "Y" * 20), (907, f"\t{'y' * 20}\x0b")]
    rows += [(10_000, "\n".join(f"line {k % 5000} of a very long document" for k in range(30_000)))] + [(9_000 + k, "line 17 of a very long document\nline 18 of a very long document") for k in range(3)]
    got = lines_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert got == Counter(deduplicated(rows))


def test_a_key_may_fill_several_ranges(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same line in every document").alias("text"))
    hashes = line_dedup.line_hashes(frame)
    gone = line_dedup.dropped_lines(hashes)
    assert gone.count() == 4999 and gone.agg(F.max("doc")).first()[0] == 4998


def test_bitmaps_are_runs(spark):
    same = "a line that three documents have"
    rows = [(1, f"{same}\nb\n{same}\n{same}\nc\nd"), (2, same), (3, f"x\n{same}")]
    got = {r.doc_id: [tuple(x) for x in r.kept_runs] for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(1, 1), (4, 2)], 2: []}


def test_line_plans_have_no_python(odd):
    bitmaps = line_dedup.keep_bitmaps(odd)
    hashes = line_dedup.line_hashes(odd)
    for frame in (hashes, line_dedup.dropped_lines(hashes), bitmaps, line_dedup.without_lines(odd, bitmaps)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- tries


def talks_of(rows):
    """conv_id -> [(role, text)] in order."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes_of(talks):
    members = defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        weight = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += weight
            leaves[k[:d]] += not children[k]
    ends = defaultdict(list)
    for c in sorted(talks):
        ends[tuple(talks[c])].append(str(c))
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(ends[k]))) for k, m in members.items())


def trie_of(frame, **options):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r[n] for n in names) for r in prefix_trie.prefix_trie(frame, **options).collect())


TURNS = "conv_id long, turn long, role string, text string"


def some_talks(seed, n, words):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(draw.randint(0, 9)):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "bot", None]), draw.choice([*words, None, ""])))
    rows += rows[: n // 4]  # repeated rows
    rows += [(None, 1, "user", "left out"), (10**12, 0, "user", "far"), (10**12 + 1, 5, "user", "far"), (3, 2, "u", "ser"), (3, 2, "us", "er")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = some_talks(1, 120, ["a", "b", "é"])
    frame = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "fp": F.lit(1), "place": F.lit("p"), "digest": F.lit("d")}).repartition(5)
    talks = talks_of(rows)
    assert trie_of(frame) == nodes_of(talks)
    assert trie_of(frame, prepared=prefix_trie.rebuilt) == nodes_of(rebuilt(talks))
    assert not trie_of(frame.limit(0))
    assert not trie_of(frame.limit(0), prepared=prefix_trie.rebuilt)


@pytest.mark.parametrize("bits", [1, 5])
def test_colliding_fingerprints_are_split(spark, bits):
    rows = some_talks(2, 40, ["a", "b"])
    assert trie_of(spark.createDataFrame(rows, TURNS), bits=bits) == nodes_of(talks_of(rows))


def test_conversations_longer_than_a_chunk(spark):
    long = [(c, t, "user", f"turn {t if t != 4500 or c != 2 else 0}") for c in (1, 2, 4) for t in range(9000 if c != 4 else 4100)]
    got = trie_of(spark.createDataFrame(long, TURNS).repartition(6))
    # brute force by arithmetic: 1 and 2 part at turn 4500, and 4 ends at 4100
    size = lambda t: len(f"turn {t}")
    shared = sum(2 * size(t) for t in range(4100)) + sum(size(t) for t in range(4100, 4500))
    assert len(got) == 1 + 9000 + 4500
    root = next(x for x in got if x[1] == 0)
    assert root == (1, 0, None, 3, 1, 2, shared, sha(""))
    assert (2, 4501, 1, 1, 1, 1, 0, sha("")) in got and (1, 4500, 1, 2, 2, 2, size(4499), sha("")) in got
    assert (1, 4100, 1, 3, 1, 2, 2 * size(4099) + sum(size(t) for t in range(4100, 4500)), sha("4")) in got


def test_conversation_that_is_left_without_turns(spark):
    rows = [(7, 0, "user", "only turn"), (12, 0, "user", "only turn")]  # their families' first conversations are absent
    assert trie_of(spark.createDataFrame(rows, TURNS), prepared=prefix_trie.rebuilt) == nodes_of(rebuilt(talks_of(rows)))


# --- fill in middle


def arranged(doc_id, text):
    """By the definition, with a regular expression."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    first = h[3] % 100 < 20
    return n, "spm" if first else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if first else f"<P>{p}<S>{s}<M>{m}"


SPECIAL = ["<", ">", "P", "S", "M", "<P>", "<S>", "<M>", "a", "Z", " ", "\n", "é", "漢", "😀", "\x00", "1", "word", "--"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SPECIAL), max_size=40).map("".join), st.integers(0, 10**6))
def test_arranged_equals_the_definition(text, doc_id):
    assert fill_middle.arranged(doc_id, text) == arranged(doc_id, text)
    units, found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), fill_middle.Units(text.encode())
    assert [found.character(k) for k in range(found.count + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_long_texts_are_read_in_pieces():
    draw = random.Random(6)
    text = "".join(draw.choice(SPECIAL) for _ in range(200_000)) + "x" * (fill_middle.SCAN_SYMBOLS + 5) + " <" + "P> tail" + "y" * 70
    found = fill_middle.Units(text.encode())
    assert found.count == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and found.marked
    assert len(text) > fill_middle.SCAN_SYMBOLS
    edge = "a" * (fill_middle.SCAN_SYMBOLS - 4) + "<P>" + "b"  # a sentinel across two pieces
    assert fill_middle.Units(edge.encode()).marked and fill_middle.Units(edge.encode()).count == 5


def test_outputs_of_odd_rows(spark, odd, odd_rows, none):
    rows = [*odd_rows, *[(100 + i, f"Some words, číslo {i}; and\n\nmore < words > here {i}.") for i in range(300)], (500, "has <P> in it"), (501, "<M>")]
    frame = odd.select("doc_id", "text", "form", "output") if "form" in odd.columns else odd.withColumns({"form": F.lit("f"), "output": F.lit("o"), "n": F.lit("n")})
    names = frame.columns
    frame = frame.unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"), allowMissingColumns=True)
    out = fill_middle.fill_in_middle(frame)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(names) > 2 and Counter(tuple(r)[:6] for r in got) == Counter((i, *arranged(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(none).count() == 0


def test_other_sentinels(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(i, f"abc <P> def {i} <|pre| > <|su") for i in range(60)] + [(99, "with <|mid|> inside")]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=marks)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == dict(rows)[r.doc_id] for r in got) and any(r.form == "spm" for r in got)
    assert next(r for r in got if r.doc_id == 99).form == "plain"
    with pytest.raises(ValueError):
        fill_middle.arranged(1, "text", sentinels=("aba", "b", "c"))
    with pytest.raises(ValueError):
        fill_middle.arranged(1, "text", sentinels=("é", "b", "c"))
