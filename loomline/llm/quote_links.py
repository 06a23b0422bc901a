"""Chat formatting by quotation linking.

1. Lines that begin with ``>`` signs are quotes; the number of signs is the
   level.  Consecutive lines of a level are a passage, ended by a blank line or by
   another level.  What is left of a message is its body; an attribution
   ("... wrote:", on one line or two) right before a quote, or within one right before
   a deeper level, goes with the quote.
2. Passages are normalised (lower case, letters and digits only, single spaces)
   and hashed as a whole, by line and by windows of ``WINDOW`` words.  Bodies are
   hashed as a whole, by paragraph, line and sentence and by the same windows, so
   that trimmed, joined and re-wrapped quotes meet their originals too.
3. Each hash of a passage votes for the nearest earlier message of the same
   conversation whose body has it, else, if the passage has ``MIN_WORDS`` words,
   for the first message anywhere (smallest conversation, then turn) that has it:
   shorter passages, such as "Sounds good", say which message they mean only
   within their conversation.  A message that gets ``SHARE`` of a
   passage's words, by its whole, its lines or its windows, is linked.  Of a
   message's links those of the smallest level win (deeper levels, which quote an
   ancestor, count only without others), then the message with the most words,
   then the smallest conversation and turn.  A message without a link replies to
   the turn before it.
4. Replies form a forest.  A message without a quote link follows the nearest root
   or linked message before it in its conversation, its head.  Pointer doubling among
   the heads finds each one's root and depth; a thread is a root's messages, in order of depth, conversation and turn:
   every message comes after the one that it replies to.

A link may not lead to the same or a later turn of its own conversation, nor to
a conversation with a larger id, so that no cycle arises.  Common passages
never meet all pairs: originals are reduced to one message a hash, and within a
conversation a running window carries the nearest original.  Bodies are hashed
after the quotes, and only hashes that a quote has are kept; which ones is
broadcast if they number ``MAX_BROADCAST`` at most, else shuffled.

Rows with a null conversation or turn are left out.  Rows that repeat a
conversation and turn are one message, the one with the smallest role and text.
A null text counts as empty, a null role as user.  Whole texts are parsed, however
long.  Columns of any other name are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouping import attach_groups, prefix_sums
from .scratch import materialise

#: Normalised passages with fewer words link within their own conversation only.
MIN_WORDS = 3
#: Words in a window.  Parts of a line or sentence with fewer words link nothing.
WINDOW = 5
#: Share of a passage's words, or of its windows, that one message must hold.
SHARE = 0.5
#: Quoted hashes (8 bytes each) that are broadcast, at most.
MAX_BROADCAST = 1 << 20

_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
_PROMPT = re.compile(r"^>>>(?: |$)")
_OPENING = re.compile(r"^\s*(?:On|Am|El|Le|Den)\b[^.!?]*$")
_ATTRIBUTION = re.compile(r"(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)

PARSED = "conv_id long, turn long, role string, body string, quote_levels int, passages array<struct<passage:int,level:int,words:int,kind:int,hash:long,part:double>>"


def normalised(passage: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", passage.lower()))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_word = lru_cache(1 << 16)(_hash)


def passage_hash(passage: str) -> tuple[int, int] | None:
    text = normalised(passage)
    return (_hash(text), text.count(" ") + 1) if text else None


def windows(passage: str) -> np.ndarray:
    """Hashes of all runs of ``WINDOW`` words, repeated ones once."""
    words = np.array([_word(w) for w in normalised(passage).split()], dtype=np.int64).view(np.uint64)
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(out.view(np.int64))


def quoted(passage: str) -> tuple[int, list[tuple[int, int, float]]]:
    """A passage's words and the (kind, hash, part of the passage) of its whole (0), its lines (1) and its windows (2)."""
    whole = passage_hash(passage)
    if not whole:
        return 0, []
    lines = {h for line in passage.split("\n") if (h := passage_hash(line))}
    runs = windows(passage).tolist()
    return whole[1], [(0, whole[0], 1.0), *((1, h, n / whole[1]) for h, n in sorted(lines)), *((2, h, 1 / len(runs)) for h in runs)]


def originals(body: str) -> np.ndarray:
    """All hashes by which a body can be quoted."""
    paragraphs = re.split(r"\n\s*\n", body)
    units = {body, *body.split("\n"), *paragraphs, *(s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p))}
    return np.unique(np.concatenate([np.array([h[0] for u in units if (h := passage_hash(u))], dtype=np.int64), windows(body)]))


def _without_attribution(lines: list[str], together: int) -> None:
    """Takes a closing attribution off; one that begins a line earlier goes whole, if that is among the last lines that stand ``together``."""
    if together and _ATTRIBUTION.search(lines[-1]):
        last = lines.pop()
        if together > 1 and not _OPENING.match(last) and _OPENING.match(lines[-1]):
            lines.pop()


def parse(text: str) -> tuple[str, int, list[tuple[int, str]]]:
    """(body, deepest quote level, [(level, passage)])

    Three signs and a blank are a prompt, and no quote, in a message without quotes of a lower level.
    """
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    deepest, at, together = 0, 0, 0
    quotes = [(line, _QUOTE.match(line)) for line in text.split("\n")]
    low = any(q and q[1].count(">") < 3 for _, q in quotes)
    for line, quote in quotes:
        if quote and (low or not _PROMPT.match(line)):
            level = quote[1].count(">")
            if not at:
                _without_attribution(body, together)
            elif 0 < at < level:
                _without_attribution(passages[-1][1], len(passages[-1][1]))
            together = 0
            deepest = max(deepest, level)
            if not quote[2].strip():
                at = -1  # a blank line within a quote ends the passage
            elif level == at:
                passages[-1][1].append(quote[2])
            else:
                passages.append((level, [quote[2]]))
                at = level
        else:
            body.append(line)
            at, together = 0, together + 1
    return "\n".join(body).strip(), deepest, [(level, "\n".join(lines)) for level, lines in passages if lines]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("passage", pa.int32()), ("level", pa.int32()), ("words", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64()), ("part", pa.float64())]
    kinds = [pa.string(), pa.int32(), pa.list_(pa.struct(fields))]
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            body, deepest, passages = parse(text)
            found = []
            for i, (level, passage) in enumerate(passages):
                words, units = quoted(passage)
                found += [{"passage": i, "level": level, "words": words, "kind": kind, "hash": h, "part": part} for kind, h, part in units]
            out.append((body, deepest, found))
        cols = list(zip(*out, strict=True)) or [()] * 3
        names = ["conv_id", "turn", "role", "body", "quote_levels", "passages"]
        yield pa.record_batch([*(batch.column(c) for c in names[:3]), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def _originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [originals(body) for body in batch.column("body").to_pylist()]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        hashes = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
        yield pa.record_batch([batch.column("conv_id").take(row), batch.column("turn").take(row), hashes], names=["conv_id", "turn", "hash"])


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.filter("conv_id is not null and turn is not null")
    one = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    return one.mapInArrow(_parse, PARSED)


def _attached(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows``, which are written, with what is ``known`` of their key (a row a key); a passage or message that many rows share is dealt."""
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_members"))
    groups = sizes.join(known, F.col(key) == F.col("_key"), "left").drop(key).withColumnRenamed("_key", key)  # keys that nobody knows may be hot, too
    groups = materialise(groups, "shared-keys")
    return attach_groups(rows, groups, key, "_members", rows.count(), F.struct("conv_id", "turn")).drop("_members")


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, by_quote) of every message; roots have null parents."""
    quotes = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    wanted = materialise(quotes.select("hash").distinct(), "quoted-hashes")
    n_wanted = wanted.count()
    held = parsed.select("conv_id", "turn", "body").filter(F.lit(n_wanted > 0)).mapInArrow(_originals, "conv_id long, turn long, hash long")
    held = materialise(held.join(F.broadcast(wanted) if n_wanted <= MAX_BROADCAST else wanted, "hash", "left_semi"), "quoted-originals")
    # the nearest earlier turn of the conversation that holds the hash
    events = held.select("conv_id", "hash", "turn", F.lit(True).alias("own"))
    events = events.unionByName(quotes.select("conv_id", "hash", "turn").distinct().withColumn("own", F.lit(False)))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max(F.when(F.col("own"), F.col("turn"))).over(before)).filter(~F.col("own")).drop("own")
    # else the first message anywhere
    first = held.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))).alias("first"))
    near = _attached(materialise(near, "quotes-near"), first, "hash")
    target = F.when(F.col("near").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("near").alias("t"))).when(F.col("first.c") < F.col("conv_id"), F.col("first"))
    votes = quotes.join(near.select("conv_id", "turn", "hash", target.alias("target")).filter("target is not null"), ["conv_id", "turn", "hash"])
    votes = votes.filter((F.col("words") >= MIN_WORDS) | (F.col("target.c") == F.col("conv_id")))
    message = ["conv_id", "turn", "level", "target"]
    parts = votes.groupBy(*message, "passage", "words", "kind").agg(F.sum("part").alias("part")).groupBy(*message, "passage", "words").agg(F.max("part").alias("part"))
    links = parts.filter(F.col("part") >= SHARE - 1e-9).groupBy(*message).agg(F.sum(F.round(F.col("part") * F.col("words"), 6)).alias("words"))
    best = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("words")).alias("w"), "target"))["target"].alias("target"))
    turns = Window.partitionBy("conv_id").orderBy("turn")
    chain = parsed.select("conv_id", "turn", F.lag("turn").over(turns).alias("previous"))
    linked = chain.join(best, ["conv_id", "turn"], "left")
    default = F.when(F.col("previous").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("previous").alias("t")))
    parent = F.coalesce("target", default)
    return linked.select("conv_id", "turn", parent["c"].alias("parent_conv"), parent["t"].alias("parent_turn"), F.col("target").isNotNull().alias("by_quote"))


def roots(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` with thread_conv, thread_turn and depth, by pointer doubling among the heads."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    head = F.col("by_quote") | F.col("parent_conv").isNull()
    placed = links.withColumn("nth", F.row_number().over(order).cast("long"))
    at = F.last(F.when(head, F.struct("turn", "nth", F.col("parent_conv").isNull().alias("root"))), ignorenulls=True).over(order)
    placed = placed.withColumn("at", at).select(*links.columns, F.col("at.turn").alias("head"), F.col("at.root").alias("at_root"), (F.col("nth") - F.col("at.nth")).alias("after"))
    placed = materialise(placed, "threads-placed")
    key = lambda c, t: F.struct(F.col(c).alias("c"), F.col(t).alias("t"))
    targets = placed.select(key("conv_id", "turn").alias("parent"), F.col("head").alias("_head"), F.col("after").alias("_after"), F.col("at_root").alias("_root"))
    linked = materialise(placed.filter("by_quote").select("conv_id", "turn", key("parent_conv", "parent_turn").alias("parent")), "threads-linked")
    linked = _attached(linked, targets, "parent")
    now = linked.select("conv_id", "turn", F.struct(F.col("parent.c").alias("c"), F.col("_head").alias("t")).alias("up"), (F.col("_after") + 1).alias("depth"), F.col("_root").alias("settled"))
    top = placed.filter("parent_conv is null").select("conv_id", "turn", key("conv_id", "turn").alias("up"), F.lit(0).cast("long").alias("depth"))
    now = materialise(now, "threads-0")
    done = now.filter("settled")
    for step in range(1, max_rounds + 1):
        going = now.filter("not settled")  # who has found its root leaves the rounds
        if going.isEmpty():
            break
        above = done.unionByName(going).select(key("conv_id", "turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("settled").alias("_settled"))
        joined = _attached(going, above, "up")
        now = materialise(joined.select("conv_id", "turn", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("_settled").alias("settled")), f"threads-{step}")
        done = done.unionByName(now.filter("settled"))
    else:
        raise RuntimeError(f"threads deeper than 2**{max_rounds}")
    now = done.drop("settled")
    heads = now.unionByName(top).select("conv_id", F.col("turn").alias("head"), "up", F.col("depth").alias("above"))
    found = placed.join(heads, ["conv_id", "head"])
    return found.select(*links.columns, F.col("up.c").alias("thread_conv"), F.col("up.t").alias("thread_turn"), (F.col("above") + F.col("after")).alias("depth"))


def conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """A row a message, in reply order by ``position`` within its thread.

    thread_conv, thread_turn, position, conv_id, turn, parent_conv, parent_turn,
    by_quote, depth, quote_levels, role, body (without quotes) and formatted, the
    body with the role marks of ``<|role|>`` chat formatting.
    """
    parsed = materialise(parse_messages(messages, **columns), "messages")
    threads = roots(link(parsed.select("conv_id", "turn", "passages", "body")))
    counted = threads.withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sums(counted, ["thread_conv", "thread_turn"], "depth", ["conv_id", "turn"], "_one", "position").drop("_one")
    out = ranked.join(parsed.select("conv_id", "turn", "role", "body", "quote_levels"), ["conv_id", "turn"])
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    names = ["thread_conv", "thread_turn", "position", "conv_id", "turn", "parent_conv", "parent_turn", "by_quote", "depth", "quote_levels", "role", "body"]
    return out.select(*names, formatted.alias("formatted"))
