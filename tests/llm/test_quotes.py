"""Quotation linking against a plain version that compares every message with every other."""

import random
import re

import pytest

from loomline.llm import quote_links

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_words(text):
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def plain_runs(words):
    return {words[i : i + 5] for i in range(len(words) - 4)}


def holds(body):
    """What a body can be quoted by, as tuples of words."""
    paragraphs = re.split(r"\n\s*\n", body)
    units = [body, *body.split("\n"), *paragraphs, *(s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p))]
    return {plain_words(u) for u in units} | plain_runs(plain_words(body))


def plain_parse(text):
    """(body, deepest, passages) by grouping marked lines."""
    marked = []
    for line in text.split("\n"):
        signs = re.match(r"[ \t]*((?:>[ \t]?)*)", line)[1]
        marked.append((signs.count(">"), re.sub(r"^[ \t]*(?:>[ \t]?)+", "", line), line))
    if not any(level in (1, 2) for level, *_ in marked):
        marked = [(0, line, line) if re.match(r">>>( |$)", line) else (level, rest, line) for level, rest, line in marked]
    groups = []
    for level, rest, line in marked:
        blank = level > 0 and not rest.strip()
        if groups and groups[-1][0] == (level if not blank else -level) and not blank:
            groups[-1][1].append(rest)
        else:
            groups.append((-level if blank else level, [line if level == 0 else rest]))
    for (level, lines), (next_level, _) in zip(groups, groups[1:], strict=False):
        if 0 <= level < abs(next_level) and lines and re.search(r"(?i)(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", lines[-1]):
            last = lines.pop()
            opening = r"\s*(On|Am|El|Le|Den)\b[^.!?]*$"
            if lines and not re.match(opening, last) and re.match(opening, lines[-1]):
                lines.pop()
    body = "\n".join(line for level, lines in groups if level == 0 for line in lines).strip()
    return body, max([0, *(abs(level) for level, _ in groups)]), [(level, "\n".join(lines)) for level, lines in groups if level > 0 and lines]


@pytest.mark.parametrize("seed", range(5))
def test_parser_against_grouped_lines(seed):
    rnd = random.Random(seed)
    parts = ["> a", ">b c", ">> d", "> > e", ">", "> ", ">>>", ">>> print(1)", "text", "", "On Tue, Bob", " wrote:", "On Tue Bob wrote:", "> On Tue Bob wrote:", "> Ann writes:", "He said:", " > f", "On the way. Bob wrote:"]
    for _ in range(600):
        text = "\n".join(rnd.choices(parts, k=rnd.randrange(9)))
        assert quote_links.parse(text) == plain_parse(text), text


def test_attributions_and_prompts():
    assert quote_links.parse("On Tue, 5 May, Bob\n wrote:\n> On Mon Ann wrote:\n>> hi\n> yes\nok") == ("ok", 2, [(2, "hi"), (1, "yes")])
    assert quote_links.parse("try\n>>> print(1)\n1") == ("try\n>>> print(1)\n1", 0, [])


def test_one_message_that_a_hundred_thousand_quote(spark):
    """A root, its replies in conversations of their own, a chain of replies to replies, and a quote that nobody wrote."""
    from pyspark.sql import functions as F

    n, quote = 100_000, "the very first words of all this"
    replies = spark.range(1, n + 1).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(f"> {quote}\n\nanswer number "), "id", F.lit(" with its own words"))).otherwise(F.concat(F.lit("> words that nobody ever wrote here\n\nlonely "), "id")).alias("text"))
    chain = [(0, 0, "user", f"{quote} that begins")] + [(200_000 + i, 0, "user", f"> answer number {1 if i == 0 else 0} with its own words\n\nx" if i == 0 else f"> step {i - 1} of a long chain here\n\nstep {i} of a long chain here") for i in range(1, 40)]
    chain[1] = (200_001, 0, "user", "> answer number 1 with its own words\n\nstep 1 of a long chain here")
    rows = replies.unionByName(spark.createDataFrame(chain, SCHEMA)).repartition(8)
    found = quote_links.conversations(rows)
    got = found.groupBy("thread_conv").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max("position").alias("p")).filter("n > 1 or thread_conv = 0").collect()
    assert [(r.thread_conv, r.n, r.d, r.p) for r in got] == [(0, 1 + 66_667 + 39, 40, 66_707)]
    assert found.filter("not by_quote").count() == 33_333 + 1


def plain_links(rows):
    """{(conversation, turn): (parent, by quote)} by comparing all passages with all bodies."""
    parsed = {(c, t): plain_parse(text) for c, t, _, text in rows}
    held = {key: holds(body) for key, (body, *_) in parsed.items()}
    out = {}
    for (conv, turn), (_, _, passages) in parsed.items():
        scores = {}
        for level, passage in passages:
            words = plain_words(passage)
            if not words:
                continue
            lines = {plain_words(line) for line in passage.split("\n")} - {()}
            kinds = [{words: 1.0}, {line: len(line) / len(words) for line in lines}, {run: 1 / len(plain_runs(words)) for run in plain_runs(words)}]
            share = {}
            for kind, units in enumerate(kinds):
                for unit, part in units.items():
                    own = [key for key in held if key[0] == conv and key[1] < turn and unit in held[key]]
                    other = [key for key in held if unit in held[key]]
                    target = max(own) if own else min(other) if other and min(other)[0] < conv and len(words) >= 3 else None
                    if target:
                        share[target, kind] = share.get((target, kind), 0) + part
            for target in {t for t, _ in share}:
                best = max(share.get((target, kind), 0) for kind in range(3))
                if best >= 0.5 - 1e-9:
                    scores[level, target] = scores.get((level, target), 0) + round(best * len(words), 6)
        earlier = [key for key in parsed if key[0] == conv and key[1] < turn]
        if scores:
            out[conv, turn] = (min(scores, key=lambda k: (k[0], -scores[k], k[1]))[1], True)
        else:
            out[conv, turn] = (max(earlier) if earlier else None, False)
    return out


def table(seed, conversations=40):
    """Messages with planted quotes: wholes, lines, joined paragraphs, re-wrapped parts, sentences, short and nested ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bodies, planted = [], {}, {}

    def line(n):
        return " ".join(rnd.choices(vocabulary, k=n))

    for conv in range(conversations):
        for turn in range(rnd.randint(3, 8)):
            body = "\n\n".join("\n".join(line(rnd.randint(6, 12)) + "." for _ in range(3)) for _ in range(2))
            if rnd.random() < 0.3:
                body += "\n\nSounds good"
            text = body
            own = [key for key in bodies if key[0] == conv]
            others = [key for key in bodies if key[0] < conv]
            if rnd.random() < 0.6 and (own or others):
                target = rnd.choice(own if own and (rnd.random() < 0.7 or not others) else others)
                old = bodies[target]
                lines = [x for x in old.split("\n") if x]
                i = rnd.randrange(len(lines) - 1)
                flat = " ".join(lines)
                way = rnd.randrange(6)
                quote = [old, lines[i], "\n".join(lines[i : i + 2]), re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+) ", r"\1\n", " ".join(flat.split()[4:30])), lines[0].upper() + " !", "Sounds good"][way]
                level = rnd.choice([1, 1, 2])
                text = "Ann wrote:\n" + "\n".join(">" * level + (" " + x if x else "") for x in quote.split("\n")) + "\n\n" + body
                if way < 5 and "Sounds good" not in quote:
                    planted[conv, turn] = target
            bodies[conv, turn] = body
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), text))
    rnd.shuffle(rows)
    return rows, planted


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_threads_against_plain_comparison(spark, seed):
    rows, planted = table(seed)
    want = plain_links(rows)
    got = quote_links.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    links = {(r.conv_id, r.turn): ((r.parent_conv, r.parent_turn) if r.parent_conv is not None else None, r.by_quote) for r in got}
    assert links == want
    found = sum(links[key] == (target, True) for key, target in planted.items())
    assert len(planted) > 50 and found >= 0.97 * len(planted)

    def climb(key):
        depth = 0
        while want[key][0]:
            key, depth = want[key][0], depth + 1
        return (*key, depth)

    assert all((r.thread_conv, r.thread_turn, r.depth) == climb((r.conv_id, r.turn)) for r in got)
    place = {(r.conv_id, r.turn): (r.thread_conv, r.thread_turn, r.position) for r in got}
    assert len(set(place.values())) == len(rows)
    assert all(place[key][2] > place[parent][2] for key, (parent, _) in want.items() if parent)


def test_short_quotes_stay_within_their_conversation(spark):
    rows = [(0, 0, "user", "Sounds good"), (1, 0, "user", "Shall we?"), (1, 1, "user", "Sounds good"), (1, 2, "user", "Something else"), (1, 3, "user", "> Sounds good\ngreat"), (2, 0, "user", "> Sounds good\nwhat does?"), (3, 0, "user", "> ...\n> --\nonly marks")]
    got = {(r.conv_id, r.turn): r for r in quote_links.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1, 3].parent_turn, got[1, 3].by_quote) == (1, True)
    assert got[2, 0].parent_conv is None and got[3, 0].parent_conv is None


def test_no_messages_and_ties(spark):
    assert quote_links.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "the very same words here"), (1, 0, "user", "the very same words here"), (1, 1, None, None), (1, 2, "user", "the very same words here"), (1, 3, "user", "> the very same words here"), (None, 1, "user", "x"), (4, None, "user", "x")]
    got = {(r.conv_id, r.turn): r for r in quote_links.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3)] and got[1, 3].parent_turn == 2 and got[1, 1].body == ""
