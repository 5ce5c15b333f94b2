"""Quotes that are not whole messages or lines: trimmed, wrapped anew, short lines, elided, and random cuts against brute force."""

from __future__ import annotations

import random
import re

from polycurate.llm import conversations

LONG = "Melt the butter slowly in a heavy pan. Break two fresh eggs into it! Cover them and wait for three minutes, then serve"


def threads(spark, rows):
    messages = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return {(r.conv_id, r.turn): r for r in conversations.threads(messages).collect()}


def test_trimmed_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "u", LONG), (1, 1, "u", "Something else entirely\nYes indeed\nand a last line here"),
        (1, 2, "u", "> Break two fresh eggs into it!\nHow fresh?"),  # a sentence out of a line
        (1, 3, "u", "> slowly in a heavy pan. Break two\n> fresh eggs into\nok"),  # a cut, wrapped anew
        (1, 4, "u", "> Yes indeed\nwhat?"),  # a line of two words
        (1, 5, "u", "> Melt the butter slowly [...] wait for three minutes\nGot it"),  # an elision: both sides of it
        (1, 6, "u", "> else entirely Yes indeed and a\nok"),  # lines joined by a quote
        (1, 7, "u", "> heavy eggs into a pan\nno"), (1, 8, "u", "> butter slowl\nno"), (2, 0, "u", "> Break two fresh eggs into it!\nno"),  # not in any message of the conversation
        (1, 9, "u", "> tomorrow we shall all meet\nno"), (1, 10, "u", "As said, tomorrow we shall all meet again"),  # only in a later message
    ]
    got = {k: (r.parent_turn, r.n_linked) for k, r in threads(spark, rows).items()}
    parents = {k: p for k, (p, _) in got.items()}
    assert parents == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 0, (1, 6): 1, (1, 7): None, (1, 8): None, (2, 0): None, (1, 9): None, (1, 10): None}
    assert got[1, 2] == (0, 1) and got[1, 3] == (0, 5) and got[1, 4] == (1, 1) and got[1, 5] == (0, 2) and got[1, 6] == (1, 1)


def test_random_cuts_link_to_the_first_message_that_has_them(spark):
    draw = random.Random(8)
    rows, cuts = [], {}
    for conv in range(6):
        texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(4, 40))) for _ in range(8)]
        rows += [(conv, t, "u", x) for t, x in enumerate(texts)]
        for t in range(8, 20):
            words = draw.choice(texts).split()
            a = draw.randrange(len(words))
            cut = " ".join(words[a : a + draw.randint(1, 12)]) if draw.random() < 0.8 else " ".join(draw.choice("abcd") for _ in range(6))
            cuts[conv, t] = next((i for i, x in enumerate(texts) if f" {cut} " in f" {x} "), None)
            equal = next((i for i, x in enumerate(texts) if cut == x), None)
            cuts[conv, t] = cuts[conv, t] if equal is None else equal
            rows.append((conv, t, "u", f"> {cut}\nreply number {t}"))
    got = threads(spark, rows)
    assert {k: got[k].parent_turn for k in cuts} == cuts and sum(v is None for v in cuts.values()) > 3
    assert not any(re.search("^>", got[k].content) for k in cuts)


# --- the whole operator against brute force: parse, link, order


ENDS = r"…|\.{2,}|[.!?]+(?=[^a-z0-9A-Z]|$)"
plain = lambda text: re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def units_of(text, lines, least):
    parts = [plain(x) for x in [*lines, *re.split(ENDS, text)]]
    return {x for x in [plain(text), *[p for p in parts if len(p.split(" ")) >= least]] if x}


def parsed(text):
    """(content, [(level, texts)]) of one message."""
    lines = []
    for line in text.split("\n"):
        marks = re.match(r"[ \t]*(?:>[ \t]?)+", line)
        lines.append((marks.group().count(">"), line[marks.end() :]) if marks else (0, line))
    if not any(level for level, _ in lines):
        return text, []
    following = [level for level, _ in lines[1:]] + [0]
    own = [x for (level, x), after in zip(lines, following, strict=True) if not level and not (after and x.rstrip().endswith("wrote:"))]
    runs = []
    for level, x in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(x)
        else:
            runs.append((level, [x]))
    return "\n".join(own).strip(), [r for r in runs if r[0]]


def by_hand(talk):
    """turn -> (content, parent, depth, quoted, linked, position) of one conversation {turn: text}."""
    read = {t: parsed(x) for t, x in talk.items()}
    first, out, kids = {}, {}, {}
    for t in sorted(talk):
        for unit in units_of(read[t][0].replace("\n", " "), read[t][0].split("\n"), 1):
            first.setdefault(unit, t)
    texts = {t: f" {plain(c)} " for t, (c, _) in read.items()}
    for t in sorted(talk):
        quoted = {(level, u) for level, lines in read[t][1] for u in units_of(" ".join(lines), lines, 3)}
        votes, linked = {}, 0
        for level, u in quoted:
            origin = first.get(u, t)
            if origin >= t:
                origin = next((k for k in sorted(talk) if f" {u} " in texts[k]), t)
            if origin < t:
                linked += 1
                votes[level, origin] = votes.get((level, origin), 0) + 1
        parent = max(((-level, n, origin) for (level, origin), n in votes.items()), default=(None,) * 3)[2]
        kids.setdefault(parent, []).append(t)
        out[t] = [read[t][0], parent, 0 if parent is None else out[parent][2] + 1, len(quoted), linked, None]
    open_turns, place = sorted(kids.get(None, []), reverse=True), 0
    while open_turns:
        t = open_turns.pop()
        out[t][5], place = place, place + 1
        open_turns += sorted(kids.get(t, []), reverse=True)
    return {t: tuple(x) for t, x in out.items()}


def a_talk(draw, n):
    """n messages, of which most quote an earlier one: whole, trimmed, wrapped anew, nested, announced, or nothing that was said."""
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "ol", "ir")]
    sentence = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 9))).capitalize() + draw.choice([".", "!", "?", "..."])
    said, talk = [], {}
    for t in range(n):
        body = "\n".join(" ".join(sentence() for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 3)))
        lines = []
        if said and draw.random() < 0.7:
            origin, quote = draw.choice(said[-12:]), ""
            source = talk[origin]
            kind = draw.randrange(5)
            own = parsed(source)[0]
            if kind == 0:
                quote = source  # with its own quotes, one level deeper
            elif kind == 1:
                pieces = own.split()
                at = draw.randrange(max(1, len(pieces)))
                quote = " ".join(pieces[at : at + draw.randint(1, 8)])
            elif kind == 2:
                pieces = own.split()
                quote = "\n".join(" ".join(pieces[i : i + 4]) for i in range(0, len(pieces), 4))
            elif kind == 3:
                quote = draw.choice(own.split("\n"))
            else:
                quote = sentence()
            lines = ["Someone wrote:"] * (draw.random() < 0.3) + ["> " + x for x in quote.split("\n")]
        talk[t] = "\n".join([*lines, body] if draw.random() < 0.8 else [body, *lines])
        said.append(t)
    return talk


def test_generated_conversations_equal_brute_force(spark):
    draw = random.Random(12)
    talks = {c: a_talk(draw, 1500 if c == 0 else draw.randint(1, 25)) for c in range(120)}
    rows = [(c, t, "u", x) for c, talk in talks.items() for t, x in talk.items()]
    draw.shuffle(rows)
    got = {k: (r.content, r.parent_turn, r.depth, r.n_quoted, r.n_linked, r.position) for k, r in threads(spark, rows).items()}
    expected = {(c, t): x for c, talk in talks.items() for t, x in by_hand(talk).items()}
    assert sum(x[1] is not None for x in expected.values()) > 1000 and max(x[2] for x in expected.values()) > 5
    assert {k: (got[k], x) for k, x in expected.items() if got[k] != x} == {}
